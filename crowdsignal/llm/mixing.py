"""Mixing sources to target weights: hash-random order, distributed prefix sums of words, exact budgets, epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, small, table

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
_ROWS_A_SLICE = 2_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes(source, source_size)`` -> with ``target``: all words shared by weight, none above ``max_epochs`` times its size.

    The excess of a capped source goes to the others by weight until none is above. In closed form: order sources by
    cap over weight; the first k are capped, where k is the least number that leaves a level (what is left over the
    weights left) below the next source's ratio. One row per source, so a single window orders them.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", pick).withColumns({"cap": F.col("source_size") * F.lit(float(max_epochs)), "ratio": F.col("source_size") * F.lit(float(max_epochs)) / F.col("weight")})
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(rest))
    level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(Window.partitionBy())  # levels fall from there on
    return levels.withColumn("common", level).select("source", "source_size", F.when(F.col("common").isNull() | (F.col("ratio") < F.col("common")), F.col("cap")).otherwise(F.col("common") * F.col("weight")).alias("target"))


def _keyed(docs: DataFrame, seed: str) -> DataFrame:
    """``docs`` as ``(row, source, size, key)``, ``row`` a struct of all columns, so that no name of the table clashes."""
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))))
    return docs.select(F.struct("*").alias("row"), "source", n_words(F.col("text")).alias("size"), key.alias("key"))


def _cuts(slim: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Where each source's budget ends: ``(of, source_size, target, whole, cut_key, cut_size, copies, left)``.

    ``slim(source, size, key)`` has a row per document. Keys are cut into slices of the key space, as many for each source
    as give about 20,000 rows; sums by slice and their prefix sums tell the slice in which the budget ends, and only that
    slice's documents are sorted by key and summed up. Repeated rows share a key and count as one group of ``copies``;
    ``left`` is what the group at the cut may take beyond whole epochs. No cut (null) where whole epochs meet the budget.
    """
    same = F.col("source").eqNullSafe(F.col("of"))
    rows = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    targets = source_targets(rows.select("source", "source_size"), weights, max_epochs)
    per = rows.select(F.col("source").alias("of"), F.ceil(F.col("rows") / F.lit(_ROWS_A_SLICE)).alias("slices"))
    plan = targets.withColumnRenamed("source", "of").join(per.withColumnRenamed("of", "_of"), F.col("of").eqNullSafe(F.col("_of"))).drop("_of")
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(0)
    plan = plan.withColumn("whole", whole).withColumn("rest", F.floor("target") - F.col("whole") * F.col("source_size"))
    plan = materialize(plan, "targets")

    share = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    dealt = slim.join(small(plan.select("of", "slices", "rest")), same).where("size > 0").withColumn("slice", F.floor(share * F.col("slices") / F.lit(2**32)))
    groups = dealt.groupBy("source", "slice", "rest", "key", "size").agg(F.count("*").alias("copies"))
    sums = materialize(dealt.groupBy("source", "slice", "rest").agg(F.sum("size").alias("words")), "slices")
    before = lambda c, *by: F.coalesce(F.sum(c).over(Window.partitionBy("source").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = sums.withColumn("offset", before("words", "slice")).where("offset <= rest and rest < offset + words")
    at = at.select(F.col("source").alias("of"), F.col("slice").alias("at"), "offset")
    inside = groups.join(small(at), same & (F.col("slice") == F.col("at")))
    start = F.col("offset") + before(F.col("size") * F.col("copies"), "key", "size")
    cut = inside.withColumn("left", F.col("rest") - start).where("left >= 0 and left < size * copies")
    cut = cut.select(F.col("of").alias("_of"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), "copies", "left")
    return materialize(plan.join(cut, F.col("of").eqNullSafe(F.col("_of")), "left").drop("_of", "slices", "rest"), "cuts")


def _taken(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """``keyed(row, source, size, key)`` with source_size, target and taken, by the cuts of its sources.

    Every row is decided by its key alone, so nothing shuffles. Only where the group at a cut holds repeated rows are
    these told apart: numbered by task, the first ones take what is left.
    """
    joined = keyed.join(small(cuts), F.col("source").eqNullSafe(F.col("of")))
    here = (F.col("key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size"))
    part = F.when(F.col("cut_key").isNull(), 0).when(here, F.col("left")).when(F.struct("key", "size") < F.struct("cut_key", "cut_size"), F.col("size")).otherwise(0)
    out = lambda df, part: df.select("row", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))
    if cuts.where("copies > 1").isEmpty():
        return out(joined, part)
    tied = here & (F.col("copies") > 1)
    numbered = materialize(joined.where(tied).withColumn("no", F.monotonically_increasing_id()), "tied")
    task = F.shiftright("no", 33)
    counts = numbered.groupBy("of", task.alias("task")).agg(F.count("*").alias("n"))
    by_task = Window.partitionBy("of").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("of").alias("_of"), F.col("task").alias("_task"), F.coalesce(F.sum("n").over(by_task), F.lit(0)).alias("before"))
    placed = numbered.join(small(offsets), F.col("of").eqNullSafe(F.col("_of")) & (task == F.col("_task")))
    place = F.col("before") + F.row_number().over(Window.partitionBy("of", "_task").orderBy("no")) - 1
    first = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - place * F.col("size")))
    return out(joined.where(~F.coalesce(tied, F.lit(False))), part).union(out(placed, first))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """How many words the mix takes of each document -> ``(doc_id, size, source_size, target, taken)``.

    Every document gets a random key, the MD5 of the seed, its id and its text. Within a source, whole epochs are taken
    in full; the rest of the budget takes documents in key order until their words fill it, cutting the last one at the
    exact word. So a source takes the whole part of its target, and no document more than ``max_epochs`` times its size.

    Texts are read once, for sizes and keys; what follows works on those. No source is ever in one task (``_cuts``), and
    neither is a row that is repeated many times. Results do not depend on partitioning, and reruns agree; only which of
    several repeated rows are at the cut may differ, what they take together is fixed.

    Cases: null and blank texts have size 0 and take 0; a null source is a source of its own, the last; null ids are
    kept; if no document has words, all targets are 0; an empty table gives no rows; other columns are not read.
    """
    keyed = _keyed(docs.select("doc_id", "text", "source"), seed)
    slim = materialize(keyed.select(F.col("row.doc_id").cast("long").alias("row"), "source", "size", "key"), "sizes")
    return _taken(slim, _cuts(slim, weights, max_epochs)).select(F.col("row").alias("doc_id"), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself, with the columns of ``docs``: each document once for every epoch it is taken in.

    The document at a source's budget is cut after its last word taken; ``n_chars``, where the table has it, follows the
    text. Documents without words take nothing from any budget and are kept once. Texts are read twice and do not shuffle.
    """
    keyed = _keyed(docs, seed)
    taken = _taken(keyed, _cuts(materialize(keyed.select("source", "size", "key"), "sizes"), weights, max_epochs))
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0).cast("int")
    copies = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = taken.select("row", F.explode(copies).alias("words"))
    text = F.when(F.col("words") < 0, F.col("row.text")).otherwise(_first_words(F.col("row.text"), F.col("words")))
    columns = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": text}
    if "n_chars" in docs.columns:
        columns["n_chars"] = F.when(F.col("words") < 0, F.col("row.n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[columns[c].alias(c) for c in docs.columns])


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word: the words and the white space between them, pieced together again."""
    pieces = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(pieces, 1, F.greatest(n, F.lit(0))), "")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by the weights 5, 2, 1, up to three epochs."""
    return mix(table(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix' || coalesce('|' || CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r
), c AS (
  SELECT *, first_value(CASE WHEN ratio >= level THEN level END) OVER (ORDER BY ratio >= level DESC, ratio, source NULLS LAST) AS common FROM l
), t AS (
  SELECT source, source_size, CASE WHEN common IS NULL OR ratio < common THEN cap ELSE common * weight END AS target FROM c
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
         CASE WHEN t.source_size > 0 THEN floor(floor(t.target) / t.source_size) ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, floor(target) - whole * source_size - start)) AS BIGINT) AS taken
FROM p
"""
