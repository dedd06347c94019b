"""Document fingerprints: consistent weighted sampling of word counts, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, small, table

#: Samples in a fingerprint (a likeness is off by 0.0625 at 0.5, as a standard error), and the hexadecimal digits of each.
SAMPLES, DIGITS = 64, 6
_ROWS_A_BUCKET, _BLOCK = 250, 8
_WHITE = r"[\x20\x09-\x0D]+"


def sample_keys(term: Column, numbers: list[Column], log_weights: list[Column]) -> list[list[Column]]:
    """For each sample's number and each weight a whole number whose minimum over a document's terms is the sample (Ioffe 2010).

    r and c are Gamma(2, 1), minus the logarithm of a product of two uniform numbers, and b is uniform, all cut from a hash
    of the term and the sample's number (and that hash's own hash). With t = floor(ln w / r + b), the term of the least
    ln a = ln c - r (t - b + 1) is chosen, and two documents choose the same (term, t) with the probability of their
    generalised Jaccard similarity. The upper bits of a key are ln a, the lowest 24 a hash of the term and t. A null
    weight gives a null key. What depends on the term alone is computed once for all weights.
    """
    unit = lambda h, at, bits: (F.shiftright(h, at).bitwiseAND((1 << bits) - 1) + 0.5) * F.lit(0.5**bits)
    keys = []
    for number in numbers:
        h = F.xxhash64(term, number)
        g = F.hash(h)
        r = -F.log(unit(h, 0, 21) * unit(h, 21, 21))
        log_c = F.log(-F.log(unit(g, 0, 16) * unit(g, 16, 16)))
        b = unit(h, 42, 21)
        name = F.shiftrightunsigned(h, 40)
        own = []
        for log_weight in log_weights:
            t = F.floor(log_weight / r + b)
            log_a = log_c - r * (t - b + 1)
            own.append(F.shiftleft(((log_a + 64) * F.lit(float(1 << 30))).cast("long"), 24).bitwiseOR(name.bitwiseXOR((t * 0x9E3779).bitwiseAND(0xFFFFFF))))
        keys.append(own)
    return keys


def _digits(minimum: Column) -> Column:
    return F.lpad(F.lower(F.hex(minimum.bitwiseAND(0xFFFFFF))), DIGITS, "0")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of equal samples of two fingerprints: an unbiased estimate of their similarity."""
    same = [(F.substring(a, 1 + i * DIGITS, DIGITS) == F.substring(b, 1 + i * DIGITS, DIGITS)).cast("int") for i in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def _in_buckets(docs: DataFrame, per_bucket: int) -> DataFrame:
    """``docs(doc_id, text, h)`` with a bucket of about ``per_bucket`` rows; buckets follow each other by id, then ``h``.

    Buckets are equal ranges of ids where no range gets over twenty times its share (counted), else ranges of equal
    counts, found from the sorted ids and hashes alone; there, rows of one id spread by their hash, and copies of one row
    over as many buckets as they fill. Null ids come first.
    """
    facts = docs.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    if not facts.n or facts.low is None:
        return docs.withColumn("bucket", F.lit(0).cast("long"))
    width = max(1, (int(facts.high) - int(facts.low) + 1) * per_bucket // facts.n)
    even = F.coalesce(F.floor((F.col("doc_id").cast("decimal(20,0)") - F.lit(facts.low)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    dealt = docs.withColumn("bucket", even)
    most = dealt.groupBy("bucket").count().agg(F.max("count")).first()[0]
    if most <= 20 * per_bucket:
        return dealt
    # copies of a row are told apart by number only, so that a group of them takes as many buckets as it needs
    key = [F.col("doc_id").alias("id"), F.col("h").alias("hash")]
    groups = materialize(docs.groupBy(*key).agg(F.count("*").alias("n")).repartitionByRange(max(1, facts.n // 50_000), "id", "hash").withColumn("part", F.spark_partition_id().cast("long")), "groups")
    upto = F.sum("n").over(Window.partitionBy("part").orderBy("id", "hash"))
    at = lambda place: F.col("part") * F.lit(1 << 40) + F.floor(place / per_bucket)
    known = groups.withColumn("upto", upto).select("id", "hash", at(F.col("upto") - F.col("n")).alias("low"), at(F.col("upto") - 1).alias("high"))
    spread = F.pmod(F.xxhash64("no"), F.col("high") - F.col("low") + 1)
    numbered = docs.withColumn("no", F.monotonically_increasing_id()).join(known, F.col("doc_id").eqNullSafe(F.col("id")) & F.col("h").eqNullSafe(F.col("hash")))
    return numbered.withColumn("bucket", F.col("low") + F.when(F.col("high") > F.col("low"), spread).otherwise(0)).drop("id", "hash", "low", "high", "no")


def _successors(buckets: DataFrame) -> DataFrame:
    """``(bucket, following)`` of distinct buckets, the last followed by the first.

    Most are followed by the next number, which a join finds; only the ends of runs of numbers are sorted together.
    """
    nxt = buckets.select((F.col("bucket") - 1).alias("bucket"), F.lit(True).alias("has_next"))
    prev = buckets.select((F.col("bucket") + 1).alias("bucket"), F.lit(True).alias("has_prev"))
    marked = buckets.join(nxt, "bucket", "left").join(prev, "bucket", "left")
    edges = marked.where("has_next is null or has_prev is null")
    order = Window.orderBy("bucket")
    start = F.when(F.col("has_prev").isNull(), F.col("bucket"))
    after = F.coalesce(F.min(start).over(order.rowsBetween(1, Window.unboundedFollowing)), F.min("bucket").over(Window.partitionBy()))
    ends = edges.withColumn("following", after).where("has_next is null").select("bucket", "following")
    return marked.where("has_next").select("bucket", (F.col("bucket") + 1).alias("following")).union(ends)


def with_next(docs: DataFrame, per_bucket: int = _ROWS_A_BUCKET) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(bucket, place, doc_id, text, next_text)``, the next by ascending id, the last's the first.

    Texts are dealt once, by bucket; within a bucket a window finds the next row, and each bucket's last row gets the
    first row of the following bucket. Rows with one id are ordered by a hash of their text; of repeated rows each but
    the last is followed by its own copy.
    """
    dealt = _in_buckets(docs.withColumn("h", F.xxhash64("text")), per_bucket)
    order = Window.partitionBy("bucket").orderBy("doc_id", "h")
    rows = dealt.select("bucket", F.row_number().over(order).alias("place"), "doc_id", "text", F.lead("text").over(order).alias("lead"), F.lead(F.lit(True)).over(order).alias("has_lead"))
    heads = dealt.groupBy("bucket").agg(F.min(F.struct("doc_id", "h")).alias("head"))
    following = _successors(heads.select("bucket")).join(heads.select(F.col("bucket").alias("following"), "head"), "following")
    first = following.select(F.col("bucket").alias("of"), "following", F.col("head.doc_id").alias("id"), F.col("head.h").alias("hash"))
    texts = dealt.join(small(first), F.col("doc_id").eqNullSafe(F.col("id")) & F.col("h").eqNullSafe(F.col("hash")) & (F.col("bucket") == F.col("following"))).groupBy("of").agg(F.first(F.struct("text")).alias("first"))
    return rows.join(texts, rows.bucket == texts["of"], "left").select("bucket", "place", "doc_id", "text", F.when(F.col("has_lead"), F.col("lead")).otherwise(F.col("first.text")).alias("next_text"))


def edited_text(text: Column, nxt: Column) -> Column:
    """The text with its last floor(n / 2) code points replaced by the first as many (or all) of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(text.substr(F.lit(1), F.length(text) - half), F.when(half > 0, nxt.substr(F.lit(1), half)).otherwise(""))


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``docs(doc_id, text)`` -> fingerprints of every text and its edited text, and their likeness.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. One shuffle of the
    texts; counting and sampling stay in the bucket. A row's facts (id, length and digest) travel as marked terms among its
    words, so that no text is kept for them. Texts without words have a fingerprint of zeros, which no word gives.

    Cases: null texts are empty; repeated rows and ids as in ``with_next``; a single row is its own next; null ids are
    kept, first in order; an empty table gives no rows; other columns are not read.
    """
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(clean).withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    digest = F.sha2("edited", 256)
    quarters = [F.conv(F.substring(digest, 1 + 16 * i, 16), 16, -10) for i in range(4)]
    facts = [F.concat(F.lit(f" {i}"), v) for i, v in enumerate([F.col("doc_id").cast("string"), F.length("text").cast("string"), *quarters])]  # no word holds a space
    both = F.array(F.struct(F.lit(0).alias("variant"), F.col("text").alias("t"), F.array(*facts).alias("facts")), F.struct(F.lit(1).alias("variant"), F.col("edited").alias("t"), F.array().cast("array<string>").alias("facts")))
    each = rows.select("bucket", "place", F.explode(both).alias("v")).select("bucket", "place", "v.variant", "v.t", "v.facts")
    spread = each.select("bucket", "place", "variant", F.explode(F.concat(F.split(F.lower("t"), _WHITE), "facts")).alias("term")).where("term <> ''")
    is_fact = F.startswith("term", F.lit(" "))
    fact = F.when(is_fact, F.substring("term", 2, 1).cast("int")).otherwise(-1)
    value = F.when(is_fact, F.expr("try_cast(substring(term, 3) as bigint)")).otherwise(F.xxhash64("term"))
    counts = spread.select("bucket", "place", "variant", fact.alias("fact"), value.alias("value")).groupBy("bucket", "place", "fact", "value").agg(F.count_if(F.col("variant") == 0).alias("w0"), F.count_if(F.col("variant") == 1).alias("w1"))
    logs = [F.log(F.when((F.col("fact") < 0) & (F.col(w) > 0), F.col(w)).cast("double")).alias(f"l{w}") for w in ("w0", "w1")]  # null for a fact or an absent word
    # eight samples at a time: an expression for all of them would be too long to be compiled to machine code
    blocks = -(-samples // _BLOCK)
    per_block = counts.select("bucket", "place", "fact", "value", *logs, F.explode(F.sequence(F.lit(0), F.when(F.col("fact").isin(-1, 1), blocks - 1).otherwise(0))).alias("block"))
    keys = sample_keys(F.col("value"), [F.col("block") * _BLOCK + i for i in range(_BLOCK)], [F.col("lw0"), F.col("lw1")])
    minima = [F.min(key).alias(f"s{v}_{i}") for i, own in enumerate(keys) for v, key in enumerate(own)]
    known = [F.max(F.when(F.col("fact") == i, F.col("value"))).alias(f"f{i}") for i in range(6)]
    least = per_block.groupBy("bucket", "place", "block").agg(*minima, *known)
    mark = lambda v: F.concat(*(_digits(F.coalesce(f"s{v}_{i}", F.lit(0))) for i in range(_BLOCK))).alias(f"m{v}")
    parts = least.select("bucket", "place", F.struct("block", mark(0), mark(1)).alias("part"), *[f"f{i}" for i in range(6)])
    whole = parts.groupBy("bucket", "place").agg(F.array_sort(F.collect_list("part")).alias("parts"), *[F.max(f"f{i}").alias(f"f{i}") for i in range(6)])
    sha = F.lower(F.concat(*(F.lpad(F.hex(f"f{i}"), 16, "0") for i in range(2, 6))))
    joined = lambda v: F.substring(F.array_join(F.transform("parts", lambda p: p[f"m{v}"]), ""), 1, samples * DIGITS)
    done = whole.select("bucket", "place", F.col("f0").alias("doc_id"), F.col("f1").alias("n_chars"), sha.alias("edited_sha256"), joined(0).alias("fingerprint"), joined(1).alias("edited_fingerprint"))
    done = materialize(done, "fingerprints")

    order = Window.partitionBy("bucket").orderBy("place")
    heads = done.where("place = 1").select("bucket", F.col("fingerprint").alias("head"))
    following = _successors(heads.select("bucket")).join(heads.withColumnRenamed("bucket", "following"), "following").select("bucket", "head")
    paired = done.withColumn("ahead", F.lead("fingerprint").over(order)).join(following, "bucket")
    ahead = F.coalesce("ahead", "head")
    return paired.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), ahead, samples).alias("near_next"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, its edited text and its neighbour."""
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
