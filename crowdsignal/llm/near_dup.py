"""MinHash near-duplicate groups: universal hash minima, banding, exact verification, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop, materialize, table
from .components import connected_components

#: With 32 bands of 5 minima, a pair at the threshold of 0.8 misses every band with probability 3e-6.
BANDS, ROWS = 32, 5
#: A pair is ruled out where its signatures' estimate is so far below the threshold: with 160 minima the estimate for a
#: pair at 0.8 has a standard deviation of 0.032, so this is five of them (one such pair in three million).
SLACK = 0.16
#: What is left after the pivots is also compared by 1,024 bytes, with a deviation of 0.0125; again five of them.
FINE, FINE_SLACK = 1024, 0.0625
#: Rows of a side that meet in one group; members of a bucket that stay together in a join.
BLOCK_ROWS, PART_ROWS = 1024, 1000
_BLOCK, _PAIRS = 1024, 4096


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, n_words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles; one for a shorter text; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(n_words, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out)


@lru_cache(4)
def _family(size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers (odd) and increments of ``size`` universal hash functions of 32 bits."""
    rng = np.random.Generator(np.random.PCG64(seed))
    a, b = rng.integers(0, 2**32, (2, size, 1), dtype=np.uint32)
    return a | np.uint32(1), b


def minima(hashes: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The minima of ``size`` universal hashes a*x+b (mod 2^32) over a set's mixed hashes, in blocks of bounded memory."""
    a, b = _family(size, seed)
    low, x = np.full(size, 2**32 - 1, np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    space = np.empty((size, min(_BLOCK, len(x))), np.uint32)
    for at in range(0, len(x), _BLOCK):
        part = x[at : at + _BLOCK]
        values = np.multiply(a, part, out=space[:, : len(part)])
        np.add(values, b, out=values)
        np.minimum(low, values.min(axis=1), out=low)
    return low


def _signs(fine: np.ndarray) -> np.ndarray:
    """The lowest bit of each byte as a sign: a product of two such rows is the number of equal minima, give or take the root
    of the number of others, as their bits agree by chance."""
    return (fine & 1).astype(np.float32) * 2 - 1


def signatures(docs: DataFrame, text_col: str, n_words: int, bands: int, rows: int, seed: int) -> DataFrame:
    """Per row of ``docs`` (its own columns stay, the text goes): n_shingles, set_key (of the shingle set), minima."""
    keep = [c for c in docs.columns if c != text_col]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, keys, sigs = [], [], []
            for text in pdf[text_col]:
                h = shingle_hashes(text, n_words)
                n.append(len(h))
                keys.append(xxhash.xxh3_128_digest(h.tobytes()))
                sigs.append(minima(h, bands * rows, seed).view(np.int32) if len(h) else None)
            yield pdf[keep].assign(n_shingles=np.array(n, np.int64), set_key=keys, minima=sigs)

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text_col)
    return docs.mapInPandas(sign, f"{schema}, n_shingles long, set_key binary, minima array<int>")


def _keys_of(bands: int, rows: int) -> list:
    """A hash of each band's number and minima."""
    return [F.xxhash64(F.lit(i), *(F.get("minima", F.lit(i * rows + j)) for j in range(rows))) for i in range(bands)]


def _band_keys(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(class, number, band): one row per class and band, with the band's number and the key of its minima."""
    return classes.select("class", F.posexplode(F.array(*_keys_of(bands, rows))).alias("number", "band"))


def _by_bucket(members: DataFrame, facts: DataFrame) -> DataFrame:
    """``members(band, class, n, ...)`` joined with one row of facts for each band, without gathering a large bucket.

    ``n`` is the number of a bucket's members, in both. A bucket is dealt out by class in parts of about ``PART_ROWS``
    rows, and its facts are repeated for each part.
    """
    parts = F.ceil(F.col("n") / F.lit(PART_ROWS)).cast("int")
    one = facts.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return members.withColumn("part", F.pmod(F.xxhash64("class"), parts).cast("int")).join(one, ["band", "part"]).drop("part")


def _confirmed(pairs: DataFrame, sides: DataFrame, n_words: int, percent: int, slack: float = SLACK) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    ``sides(class, n_shingles, minima, text)`` has one row per class. The member joins first, then the pivot: the pivot
    may be one hot key, which the skewed join splits; its set is computed once per run of rows. Sizes and signatures rule
    pairs out before their sets are made.
    """
    of = lambda x: sides.select(F.col("class").alias(x), F.struct("n_shingles", "minima", "text").alias(f"of_{x}"))
    rows = pairs.join(of("b"), "b").join(of("a"), "a")
    rows = rows.where(F.least("of_a.n_shingles", "of_b.n_shingles") * 100 >= F.greatest("of_a.n_shingles", "of_b.n_shingles") * percent)
    rows = rows.select("a", "b", F.col("of_a.minima").alias("m_a"), F.col("of_b.minima").alias("m_b"), F.col("of_a.text").alias("text_a"), F.col("of_b.text").alias("text_b"))

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, pivot = None, None
        for pdf in batches:
            hit = []
            for a, ma, mb, ta, tb in zip(pdf["a"], pdf["m_a"], pdf["m_b"], pdf["text_a"], pdf["text_b"], strict=True):
                if np.mean(ma == mb) < percent / 100 - slack:
                    hit.append(False)
                    continue
                if a != last:
                    last, pivot = a, shingle_hashes(ta, n_words)
                other = shingle_hashes(tb, n_words)
                both = len(np.intersect1d(pivot, other, assume_unique=True))
                hit.append(100 * both >= percent * (len(pivot) + len(other) - both))
            yield pdf.loc[np.array(hit, bool), ["a", "b"]]

    return rows.mapInPandas(check, "a long, b long")


def _lonely(sides: DataFrame, n_words: int) -> DataFrame:
    """(class, lonely): how many shingles of a class no other class of ``sides`` has; classes without such are left out."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, text in zip(pdf["class"], pdf["text"], strict=True):
                h = shingle_hashes(text, n_words).view(np.int64)
                yield pd.DataFrame({"class": np.full(len(h), name, np.int64), "h": h})

    rows = sides.select("class", "text").mapInPandas(spread, "class long, h long")
    alone = rows.groupBy("h").agg(F.count("*").alias("n"), F.min("class").alias("class")).where("n = 1")
    return alone.groupBy("class").agg(F.count("*").alias("lonely"))


def near_duplicates(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """Group documents whose word-shingle sets overlap by ``percent`` or more -> ``(doc_id, n_shingles, component_id, kept)``.

    1. One pass over the texts gives each document its shingle count, a 128-bit key of its shingle set, and its minima.
       Documents with one set form a class, which gets a number; copies cost nothing beyond this point.
    2. Classes meet in buckets by band. A bucket never makes all its pairs. First every class is tried with one other,
       the one of its buckets' pivots that shares most rows with others, as a family's original does. Then, where a
       bucket is in several components, members outside its main component are tried with one member of that.
    3. What is still apart within a bucket is settled exactly, so no link is lost, however a bucket is made up: members
       outside the bucket's main component are tried with all members of other components that a bound allows. The
       bound: shingles that no other class of these buckets has cannot be shared, so what is left of the smaller side
       must reach the intersection that the two sizes ask for. In a family of copies edited independently it excludes
       nearly all pairs where edits differ; the signatures, compared in blocks of a bucket, exclude most of the others.
       Pairs within one component cannot change the result.
    4. Alternating large-star and small-star gives the components.

    Cases: null, empty and blank texts have no shingles and stay alone; a text of fewer than ``n_words`` words is one
    shingle. Repeated rows keep one row each. A null id stays in the result with a null component and ``kept`` true.
    Other columns of ``docs`` are not read, so their names cannot clash. An empty table gives an empty result.
    """
    signed, classes, component = _groups(docs, n_words, percent, id_col, text_col, bands, rows, seed)
    return _assemble(signed, classes, component)


def row_key(doc_id: Column, text: Column) -> list[Column]:
    """What tells rows apart in ``kept_rows``: the id and two hashes of the text. Copies of a row share it."""
    return [doc_id.cast("long").alias("doc_id"), F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("h")).alias("text_key")]


def kept_rows(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """The one row of each near-duplicate group that stays -> ``(doc_id, text_key, copies)``, the columns of ``row_key``.

    It has the smallest id, a null one only if the group has no other, then the smallest hash. ``copies`` counts the rows
    of ``docs`` with its id and text. Texts without shingles are groups of their own, once for each id and text.
    """
    signed, classes, component = _groups(docs, n_words, percent, id_col, text_col, bands, rows, seed)
    reach = classes.join(component.withColumnRenamed("node", "class"), "class", "left")
    best = reach.groupBy(F.coalesce("component", "class").alias("component")).agg(F.min("best").alias("best")).select("best.doc_id", "best.text_key")
    copies = signed.groupBy("doc_id", "text_key").agg(F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    bare = copies.where("n_shingles = 0").select("doc_id", "text_key", "copies")
    mine = copies.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "copies")
    kept = best.join(mine, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))).select("doc_id", "text_key", "copies").union(bare)
    kept = materialize(kept, "kept")
    drop(signed, classes, component)
    return kept


def _groups(docs: DataFrame, n_words: int, percent: int, id_col: str, text_col: str, bands: int, rows: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, the classes of equal shingle sets, and the component of each class that is linked."""
    text = F.col(text_col)
    base = docs.select(*row_key(F.col(id_col), text), text.alias("text"))
    # ids travel through pandas as text: it has no null among 64-bit integers
    signed = signatures(base.withColumn("doc_id", F.col("doc_id").cast("string")), "text", n_words, bands, rows, seed).withColumn("doc_id", F.col("doc_id").cast("long"))
    signed = materialize(signed, "signatures")
    classes = signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_key")).alias("at"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("best"), F.first("n_shingles").alias("n_shingles"), F.first("minima").alias("minima"))
    classes = materialize(classes.withColumn("class", F.monotonically_increasing_id()), "classes")

    buckets = _band_keys(classes, bands, rows)
    shared = buckets.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(buckets.join(shared, "band").select("band", "number", "class", "n"), "buckets")
    popular = members.groupBy("class").agg(F.sum("n").alias("weight"))
    pivots = members.join(popular, "class").groupBy("band").agg(F.max(F.struct("weight", "class")).alias("pivot"), F.max("n").alias("n"))
    best = _by_bucket(members, pivots).where("class <> pivot.class").groupBy("class").agg(F.max("pivot")["class"].alias("pivot"))
    at = classes.join(members.select("class").distinct(), "class", "left_semi").drop("first_id", "best", "set_key")
    found = at.join(base, F.col("at.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at.text_key") == F.col("text_key")))
    sides = materialize(found.groupBy("class").agg(*(F.first(c).alias(c) for c in ("n_shingles", "minima", "text"))), "sides")

    def confirmed(tries: DataFrame) -> DataFrame:
        tries = tries.select(F.least("class", "pivot").alias("a"), F.greatest("class", "pivot").alias("b")).distinct()
        return materialize(_confirmed(tries, sides, n_words, percent), "links")

    def still_apart(component: DataFrame) -> DataFrame:
        """Members of buckets in several components, with the bucket's main component and one member of it."""
        now = members.join(component.withColumnRenamed("node", "class"), "class", "left").select("band", "number", "class", "n", F.coalesce("component", "class").alias("component"))
        sizes = now.groupBy("band", "component").agg(F.count("*").alias("size"), F.min_by("class", F.xxhash64("class", "band")).alias("pivot"), F.max("n").alias("n"))
        apart = sizes.groupBy("band").agg(F.max(F.struct("size", "component", "pivot")).alias("main"), F.count("*").alias("k"), F.max("n").alias("n")).where("k > 1")
        return materialize(_by_bucket(now, apart).select("band", "number", "class", "n", "component", F.col("main.component").alias("main"), F.col("main.pivot").alias("pivot")), "apart")

    first = confirmed(best)
    links, written = first, [first]
    component = connected_components(links)
    apart = still_apart(component)
    if not apart.isEmpty():
        second = confirmed(apart.where("component <> main"))
        links = links.union(second)
        drop(component, apart)
        written.append(second)
        component = connected_components(links)
        apart = still_apart(component)
    if not apart.isEmpty():
        able = _able(apart, sides, n_words, percent, bands, rows, seed)
        third = confirmed(_rest(able, percent))
        drop(able)
        written.append(third)
        if not third.isEmpty():
            drop(component)
            component = connected_components(links.union(third))
    drop(members, sides, apart, *written)
    return signed, classes, component


def _with_fine(sides: DataFrame, n_words: int, seed: int) -> DataFrame:
    """``sides`` with, in place of the text, ``fine``: the lowest bytes of many more minima, a kilobyte for any text."""
    keep = [f for f in sides.schema if f.name != "text"]

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            marks = [minima(shingle_hashes(t, n_words), FINE, seed + 1).astype(np.uint8).tobytes() for t in pdf["text"]]
            yield pdf[[f.name for f in keep]].assign(fine=marks)

    return sides.mapInPandas(sign, T.StructType([*keep, T.StructField("fine", T.BinaryType())]))


def _able(apart: DataFrame, sides: DataFrame, n_words: int, percent: int, bands: int, rows: int, seed: int) -> DataFrame:
    """The members of ``apart`` that the bound on shared shingles leaves, with what ``_rest`` compares."""
    involved = sides.join(apart.select("class").distinct(), "class", "left_semi")
    bound = involved.join(_lonely(involved, n_words), "class", "left")
    bound = bound.withColumn("shareable", F.col("n_shingles") - F.coalesce("lonely", F.lit(0))).drop("lonely")
    bound = bound.where(F.col("shareable") * 100 >= F.col("n_shingles") * percent)
    bound = _with_fine(bound.withColumn("bands", F.array(*_keys_of(bands, rows))).drop("minima"), n_words, seed)
    return materialize(apart.select("band", "number", "class", "n", "component").join(bound, "class"), "able")


def _rest(able: DataFrame, percent: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (class, pivot) of different components within a bucket that the bound and the signatures allow.

    A bucket's members outside its main component meet all its members in blocks of bounded size, so that neither a
    large bucket nor its pairs are ever in one place; a pair is given only by the first bucket that its classes share.
    """
    sizes = able.groupBy("band", "component").agg(F.count("*").alias("size"), F.max("n").alias("n"))
    main = sizes.groupBy("band").agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all"), F.count("*").alias("k"), F.max("n").alias("n")).where("k > 1")
    blocks = lambda n: F.ceil(n / F.lit(block_rows)).cast("int")
    facts = main.select("band", "n", F.col("main.component").alias("main"), blocks(F.col("all") - F.col("main.size")).alias("n_few"), blocks(F.col("all")).alias("n_all"))
    rows_of = _by_bucket(able, facts)
    spot = lambda n: F.pmod(F.xxhash64("class", F.lit("block")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = rows_of.where("component <> main").withColumn("i", spot("n_few")).withColumn("j", every("n_all")).withColumn("few", F.lit(True))
    two = rows_of.withColumn("j", spot("n_all")).withColumn("i", every("n_few")).withColumn("few", F.lit(False))
    columns = ["band", "i", "j", "few", "number", "class", "component", "n_shingles", "shareable", "bands", "fine"]
    least_fine = FINE * (percent / 100 - FINE_SLACK + (1 - percent / 100 + FINE_SLACK) / 256)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        number, few, found = int(pdf["number"].iloc[0]), pdf["few"].to_numpy(), [np.zeros((0, 2), np.int64)]
        comp, n, able_n, names = (pdf[c].to_numpy() for c in ("component", "n_shingles", "shareable", "class"))
        keys, left, right = np.array(pdf["bands"].tolist(), np.int64), np.flatnonzero(few), np.flatnonzero(~few)
        fine = np.frombuffer(b"".join(pdf["fine"]), np.uint8).reshape(len(pdf), FINE)
        signs, least = _signs(fine), FINE * (percent / 100 - FINE_SLACK)
        for at in range(0, len(left), 256):
            x = left[at : at + 256, None]
            near = signs[left[at : at + 256]] @ signs[right].T >= least - 5 * np.sqrt(FINE - least)
            near &= (comp[x] != comp[right]) & (np.minimum(able_n[x], able_n[right]) * (100 + percent) >= (n[x] + n[right]) * percent)
            i, j = np.nonzero(near)
            for low in range(0, len(i), _PAIRS):
                a, b = left[at + i[low : low + _PAIRS]], right[j[low : low + _PAIRS]]
                close = np.count_nonzero(fine[a] == fine[b], axis=1) >= least_fine
                a, b = a[close], b[close]
                ok = (keys[a] == keys[b]).argmax(axis=1) == number
                found.append(np.stack([names[a[ok]], names[b[ok]]], axis=1))
        return pd.DataFrame(np.concatenate(found), columns=["class", "pivot"])

    return one.select(columns).union(two.select(columns)).groupBy("band", "i", "j").applyInPandas(meet, "class long, pivot long")


def _assemble(signed: DataFrame, classes: DataFrame, component: DataFrame) -> DataFrame:
    """The smallest doc_id of each component, for every row; rows without shingles are their own component."""
    reach = classes.join(component.withColumnRenamed("node", "class"), "class", "left").select("set_key", F.coalesce("component", "class").alias("component"), "first_id")
    smallest = reach.groupBy("component").agg(F.min("first_id").alias("component_id"))
    known = reach.join(smallest, "component").select("set_key", "component_id")
    out = signed.select("doc_id", "n_shingles", "set_key").join(known, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op4_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles at 80 %, over all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"), n_words=4, percent=80)
