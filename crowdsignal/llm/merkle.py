"""Merkle manifest of a dataset: a digest for each row, a tree for each group of rows, one root over all, and proofs.

A level is built by self-joins on computed sibling indices: the nodes of each other slot, shifted back by their slot, meet
the node in slot zero by an equal key, and slot-zero rows emit the parents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, partitions_for, small, table

#: The fields of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 8
_ROWS_A_PART = 200_000
_PATH = "array<struct<slot: int, kids: array<string>>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """A value as it is hashed: "-" for null, else its UTF-8 byte count, ":" and itself, so that no two rows read alike."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, fields)), 256)


def joined_digest(digests: Column) -> Column:
    return F.sha2(F.array_join(digests, ""), 256)


def numbered(rows: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 within ``by`` in ``order``, and ``n``, the number of rows with their ``by``.

    Nulls come first. Rows are range-sorted and written once with their task and place; what each task holds of each group
    is a row or two, and prefix sums of these tell where a task's rows begin. So no task holds a group, however large.
    ``order`` should end with a column that tells repeated rows apart, else these all meet in one task.
    """
    ranged = rows.repartitionByRange(partitions_for(rows.count(), _ROWS_A_PART, 1), *by, *order).sortWithinPartitions(*by, *order)
    placed = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), label)
    placed = placed.withColumns({"_task": F.shiftright("_at", 33), "_no": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = placed.groupBy("_task", *by).agg(F.count("*").alias("_rows"), F.min("_no").alias("_first"))
    whole = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("_task").alias("_of"), *[F.col(c).alias(f"_by_{c}") for c in by], (before - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], F.col("_task") == F.col("_of"))
    return placed.join(small(materialize(starts, f"{label}-starts")), same).select(*rows.columns, (F.col("_no") + F.col("_shift")).alias("idx"), "n")


def _families(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes(tree, idx, n, digest)`` -> a row for each run of ``arity`` siblings, with the parent's idx, n and digest, and ``kids``.

    One self-join for each slot: its rows carry the index of their run's first node, so all sides are dealt by one key.
    """
    slot = F.pmod("idx", F.lit(arity))
    runs = nodes.where(slot == 0).select("tree", "idx", "n", F.col("digest").alias("d0"))
    for k in range(1, arity):
        runs = runs.join(nodes.where(slot == k).select("tree", (F.col("idx") - k).alias("idx"), F.col("digest").alias(f"d{k}")), ["tree", "idx"], "left")
    kids = F.array_compact(F.array(*[f"d{k}" for k in range(arity)]))
    return runs.select("tree", (F.col("idx") / arity).cast("long").alias("idx"), F.ceil(F.col("n") / arity).alias("n"), kids.alias("kids"), joined_digest(kids).alias("digest"))


def build_trees(leaves: DataFrame, arity: int, label: str) -> tuple[DataFrame, DataFrame | None]:
    """``leaves(tree, idx, n, digest)`` -> the roots ``(tree, digest)`` and the ways up ``(tree, idx, kids, above)``.

    A way starts at a parent of leaves: its children's digests, then for each level above the slot taken and the digests
    of that run, up to the tree's root. ``n`` is a tree's number of leaves; a lone leaf is its own root and has no way.
    Levels are written one after the other, as many as the largest tree has, each an ``arity``-th of the one below.
    """
    nodes = leaves.select("tree", "idx", "n", "digest")
    most = leaves.agg(F.max("n")).first()[0] or 0
    roots, levels = nodes.where("n = 1").select("tree", "digest"), []
    while most > 1:
        levels.append(materialize(_families(nodes.where("n > 1"), arity), f"{label}-{len(levels)}"))
        nodes, most = levels[-1].select("tree", "idx", "n", "digest"), -(-most // arity)
        roots = roots.union(nodes.where("n = 1").select("tree", "digest"))
    way = None
    for level in reversed(levels):
        here = level.select("tree", "idx", "kids", F.floor(F.col("idx") / arity).alias("up"))
        if way is None:
            way = here.withColumn("above", F.array().cast(_PATH))
            continue
        over = way.select("tree", F.col("idx").alias("up"), F.col("kids").alias("up_kids"), F.col("above").alias("up_above"))
        step = _steps("idx", "up_kids", "up_above", arity)
        way = here.join(over, ["tree", "up"], "left").withColumn("above", step)
        way = way.select("tree", "idx", "kids", "above")
    return roots, way


def _steps(idx: str, kids: str, above: str, arity: int) -> Column:
    """The way of node ``idx`` through its run ``kids`` and on; none where it has no run."""
    first = F.array(F.struct(F.pmod(idx, F.lit(arity)).cast("int").alias("slot"), F.col(kids).alias("kids")))
    return F.when(F.col(kids).isNull(), F.array().cast(_PATH)).otherwise(F.concat(first, F.col(above)))


def _with_paths(leaves: DataFrame, way: DataFrame | None, arity: int) -> DataFrame:
    if way is None:
        return leaves.withColumn("path", F.array().cast(_PATH))
    over = way.select("tree", F.col("idx").alias("up"), "kids", "above")
    return leaves.withColumn("up", F.floor(F.col("idx") / arity)).join(over, ["tree", "up"], "left").withColumn("path", _steps("idx", "kids", "above", arity)).drop("up", "kids", "above")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", order_col: str = "doc_id", arity: int = ARITY, carry: dict[str, Column] | None = None) -> DataFrame:
    """The manifest of ``docs``: for each row ``carry`` (by default ``order_col``), ``leaf``, ``subroot``, ``root`` and ``path``.

    A row's leaf is the SHA-256 of its framed ``fields``. The leaves of one ``tree_col`` ascend by ``order_col``; while
    several nodes are left, every ``arity`` consecutive ones become one, and what remains is the tree's subroot. The
    subroots, by ``tree_col``, give the root in the same way. ``path`` has, for each level up to the root, the row's slot
    and all digests of the run: ``proof`` takes the siblings from it, ``fold`` recomputes the root.

    Texts are read once. Neither a tree nor a row that is repeated many times is ever in one task (``numbered``); the
    joins of a level have unique keys. The number of trees and of levels is counted on the driver, no digest passes it.

    Cases: null fields are hashed as "-"; null ``tree_col`` values are one tree, the first; null ``order_col`` values come
    first; rows of one id are ordered by leaf; repeated rows are a leaf each; empty texts have length 0; an empty table
    gives no rows; other columns are not read.
    """
    carried = F.struct(*[c.alias(n) for n, c in (carry or {order_col: F.col(order_col)}).items()])
    rows = docs.select(carried.alias("row"), F.col(tree_col).alias("key"), F.col(order_col).alias("at"), leaf_digest([F.col(f) for f in fields]).alias("digest"), F.monotonically_increasing_id().alias("no"))
    placed = numbered(materialize(rows, "leaves"), ["key"], ["at", "digest", "no"], "placed")
    trees = materialize(placed.where("idx = 0").select("key"), "trees")
    trees = materialize(numbered(trees, [], ["key"], "trees-placed").select(F.col("key").alias("_key"), F.col("idx").alias("tree"), F.col("n").alias("n_trees")), "trees-numbered")
    leaves = placed.join(small(trees), F.col("key").eqNullSafe(F.col("_key"))).select("row", "tree", "idx", "n", "digest")

    roots, way = build_trees(leaves, arity, "level")
    subroots = materialize(roots.join(trees, "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("n_trees").alias("n"), "digest"), "subroots")
    top, top_way = build_trees(subroots, arity, "top")
    ends = _with_paths(subroots, top_way, arity).join(top.withColumnRenamed("digest", "root"), "tree").select(F.col("idx").alias("tree"), F.col("digest").alias("subroot"), "root", F.col("path").alias("rest"))
    whole = _with_paths(leaves, way, arity).join(small(materialize(ends, "ends")), "tree")
    return whole.select("row.*", F.col("digest").alias("leaf"), "subroot", "root", F.concat("path", "rest").alias("path"))


def proof(path: Column) -> Column:
    """The siblings on a path, level by level to the root, left to right."""
    return F.flatten(F.transform(path, lambda p: F.filter(p["kids"], lambda _, i: i != p["slot"])))


def fold(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to with the siblings on its path; the manifest's root only if the leaf is unchanged."""
    return F.aggregate(path, leaf, lambda acc, p: joined_digest(F.transform(p["kids"], lambda x, i: F.when(i == p["slot"], acc).otherwise(x))))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, every third of them (by a hash of the id) verified with its text in lower case."""
    docs = table(spark, sf_dir, "documents")
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    changed = F.when(third, F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text"))
    tampered = leaf_digest([changed if f == "text" else F.col(f) for f in FIELDS])
    rows = manifest(docs, carry={"doc_id": F.col("doc_id"), "tampered": tampered}).withColumn("folded_root", fold(F.col("tampered"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", joined_digest(proof(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: CRC-32 of the id's digits, one bit at a time.
_CRC = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1))))"
_FRAMED = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
_LEAF = lambda text: f"sha256({' || '.join(_FRAMED(c) for c in FIELDS[:-1])} || {_FRAMED(text)})"


def _tree_sql(name: str, rows: str) -> str:
    """Levels, runs and walks of the trees over ``rows(doc, tree, idx, n, digest, folded, proof)``; ``{name}_end`` has the last step."""
    return f"""{name}_nodes AS (SELECT tree, 0 AS level, idx, n, digest FROM {rows}
  UNION ALL SELECT tree, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY idx)) FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, idx // 8, n),
 {name}_runs AS (SELECT tree, level, idx // 8 AS up, list(digest ORDER BY idx) AS d FROM {name}_nodes WHERE n > 1 GROUP BY tree, level, idx // 8),
 {name}_walk AS (SELECT doc, tree, 0 AS level, idx, folded, proof FROM {name}_start
  UNION ALL SELECT doc, w.tree, w.level + 1, w.idx // 8, sha256(array_to_string(d[1:w.idx % 8] || [folded] || d[w.idx % 8 + 2:], '')), proof || array_to_string(d[1:w.idx % 8] || d[w.idx % 8 + 2:], '')
  FROM {name}_walk w JOIN {name}_runs r ON r.tree = w.tree AND r.level = w.level AND r.up = w.idx // 8),
 {name}_end AS (SELECT doc, arg_max(folded, level) AS folded, arg_max(proof, level) AS proof FROM {name}_walk GROUP BY doc)"""


OP13_SQL = f"""
WITH RECURSIVE crc AS (SELECT *, xor({_CRC}, 4294967295::BIGINT) % 3 = 0 AS third FROM documents),
 l AS (SELECT doc_id, lang, {_LEAF('text')} AS digest, CASE WHEN third THEN {_LEAF("translate(text, '" + _UPPER + "', '" + _LOWER + "')")} ELSE {_LEAF('text')} END AS folded FROM crc),
 t AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, count(*) OVER () AS n_trees FROM (SELECT DISTINCT lang FROM l)),
 b AS (SELECT row_number() OVER () AS doc, doc_id, tree, n_trees, digest, folded, '' AS proof, count(*) OVER (PARTITION BY tree) AS n, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang),
 a_start AS (SELECT * FROM b), {_tree_sql('a', 'b')},
 s AS (SELECT 0 AS tree, a_nodes.tree AS idx, digest, n_trees AS n FROM a_nodes JOIN t ON a_nodes.tree = t.tree WHERE a_nodes.n = 1),
 z_start AS (SELECT b.doc, 0 AS tree, b.tree AS idx, a_end.folded, a_end.proof FROM b JOIN a_end USING (doc)), {_tree_sql('z', 's')},
 root AS (SELECT digest AS root FROM z_nodes WHERE n = 1)
SELECT doc_id, b.digest AS leaf, s.digest AS subroot, root, sha256(z_end.proof) AS proof_sha256, z_end.folded AS folded_root, z_end.folded = root AS verified
FROM b JOIN z_end USING (doc) JOIN s ON s.idx = b.tree, root
"""
