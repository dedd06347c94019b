"""Readers and shapes of inbound records: JSON, nested threads, listings, pages, several sources at once."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..scratch import scratch_path

#: The sentiment input record.
RECORD = "source string, asset string, text string, timestamp string, engagement struct<like: long, reply: long, share: long>, author struct<followers: long, reputation_score: double>"
TWEET = "id string, id_str string, text string, full_text string, created_at string, favorite_count long, retweet_count long, reply_count long, user struct<screen_name: string, followers_count: long>"


def read_records(spark: SparkSession, path: str, schema: str = RECORD) -> DataFrame:
    """A JSON array or object a file; what does not parse is kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).json(path)


def stream_records(spark: SparkSession, path: str, schema: str | T.StructType, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def parse_tweet_json(c: Column) -> Column:
    """One struct from either spelling of a tweet; null where it has no id."""
    t = F.from_json(c, TWEET)
    text = F.coalesce(t["full_text"], t["text"])
    key = F.coalesce(t["id_str"], t["id"])
    return F.when(key.isNotNull(), F.struct(key.alias("tweet_id"), text.alias("text"), t["created_at"].alias("created_at"), F.coalesce(t["favorite_count"], F.lit(0)).alias("likes"), F.coalesce(t["retweet_count"], F.lit(0)).alias("reposts"), F.coalesce(t["reply_count"], F.lit(0)).alias("replies"), F.startswith(text, F.lit("RT @")).alias("is_retweet")))


def flatten_listing(df: DataFrame, json_col: str, data: str) -> DataFrame:
    """The ``data.children[].data`` of a listing, one row each."""
    shape = f"data struct<children: array<struct<kind: string, data: struct<{data}>>>>"
    return df.withColumn("_c", F.explode(F.from_json(json_col, shape)["data"]["children"])).select(*[c for c in df.columns if c != json_col], "_c.data.*")


#: A JSON token: a sign, a string, or a number or word.
_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\]|\\.)*")|([^\s\[\]{},:"]+))', re.S)
#: Depth up to which a reply's whole path is given.
MOST_PATH = 1000


def parse_json_deep(source: str):
    """A JSON text of any depth, by a stack of its own; ValueError where it does not parse."""
    stack: list[tuple[object, object]] = []  # open arrays and objects, with the key that waits for a value
    done, whole, at, need = False, None, 0, "value"
    end = len(source.rstrip(" \t\r\n"))
    while at < end:
        token = _TOKEN.match(source, at)
        if not token or done:
            raise ValueError("not JSON")
        at, sign = token.end(), token[1]
        held, key = stack[-1] if stack else (None, None)
        if sign in (",", ":"):
            if need != sign and not (need == "end" and sign == ","):
                raise ValueError("not JSON")
            need = "key" if sign == "," and isinstance(held, dict) else "value"
            continue
        if sign in ("]", "}"):
            if not isinstance(held, list if sign == "]" else dict) or need not in ("end", "first", "first key"):
                raise ValueError("not JSON")
            value = stack.pop()[0]
            held, key = stack[-1] if stack else (None, None)
            if held is None:
                done, whole = True, value
            need = "end"
            continue
        if need in ("key", "first key"):
            if not token[2]:
                raise ValueError("not JSON")
            stack[-1] = held, json.loads(token[2])
            need = ":"
            continue
        if need not in ("value", "first"):
            raise ValueError("not JSON")
        value = [] if sign == "[" else {} if sign == "{" else json.loads(token[2] or token[3])
        if isinstance(held, list):
            held.append(value)
        elif isinstance(held, dict):
            held[key] = value
        if sign:
            stack.append((value, None))
            need = "first" if sign == "[" else "first key"
        elif held is None:
            done, whole = True, value
        else:
            need = "end"
    if not done:
        raise ValueError("not JSON")
    return whole


def _parsed(source: str):
    try:
        return json.loads(source)
    except RecursionError:
        return parse_json_deep(source)


def _replies(source: str | None, limit: int | None = None) -> list[tuple]:
    """(place, parent, depth, path, author, body) of a thread's replies in pre-order, places from 0, parent null at the top.

    Replies are objects or, nested, JSON strings; each string is parsed once. ValueError where one does not parse.
    """
    out: list[tuple] = []
    work: list[tuple] = [(None, 0, [], None, source)]
    while work and (limit is None or len(out) < limit):
        parent, depth, path, node, replies = work.pop()
        place = parent
        if node is not None:
            place = len(out)
            out.append((place, parent, depth, path, node.get("author"), node.get("body")))
        if isinstance(replies, str):
            replies = _parsed(replies) if replies else []
        below = []
        for i, child in enumerate(replies if isinstance(replies, list) else []):
            data = child.get("data") if isinstance(child, dict) and child.get("kind") == "t1" else None
            if isinstance(data, dict):
                below.append((place, depth + 1, [*path, i] if path is not None and depth < MOST_PATH else None, data, data.get("replies")))
        work.extend(reversed(below))
    return out


def flatten_thread(df: DataFrame, json_col: str, key: str, limit: int | None = None, report: bool = False) -> DataFrame:
    """``(key, place, parent, depth, path, author, body, parsed)`` of a reply tree in pre-order; at most ``limit`` a tree.

    ``place`` numbers a tree's replies from 0, ``parent`` is the place of what a reply answers, null at the top. ``path``
    holds the position at each level; it is null below ``MOST_PATH`` levels, as the paths of a deep chain would grow with
    its square. One pass over the rows, whatever the depth. A null or empty tree has no rows, nor has one that does not
    parse, unless ``report`` asks for it: then it is one row without a place, and ``parsed`` false.
    """
    kind = df.schema[key]
    schema = T.StructType([kind, *T.StructType.fromDDL("place int, parent int, depth int, path array<int>, author string, body string, parsed boolean")])

    def tree(source: str | None) -> list[tuple]:
        try:
            return [(*r, True) for r in _replies(source, limit)]
        except ValueError:
            return [(None, None, None, None, None, None, False)] if report else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [to_arrow_type(f.dataType) for f in schema]
        for batch in batches:
            for k, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if rows := tree(source):
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), type=types[0]), *(pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types[1:]))], names=schema.fieldNames())

    return df.select(key, json_col).mapInArrow(run, schema)


def as_thread(turns: DataFrame) -> DataFrame:
    """``(conv_id, thread)``: each conversation as the JSON of a thread in which every turn answers the one before."""
    last_first = F.reverse(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))))

    def wrap(inner: Column, t: Column) -> Column:
        own = F.to_json(F.struct(t["role"].alias("author"), t["text"].alias("body")))
        return F.concat(F.lit('[{"kind":"t1","data":'), F.substring(own, F.lit(1), F.length(own) - 1), F.lit(',"replies":'), inner, F.lit("}}]"))

    return turns.groupBy("conv_id").agg(last_first.alias("t")).select("conv_id", F.aggregate("t", F.lit('""'), wrap).alias("thread"))


def harvest_pages(pages: DataFrame, patterns: list[str], html_col: str = "html", most: int | None = None) -> DataFrame:
    """Adds ``harvested``: the first non-empty of the patterns' match lists, at most ``most`` long."""
    tiers = [F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(p), F.lit(1)) for p in patterns]
    got = F.coalesce(*[F.when(F.size(t) > 0, t) for t in tiers], F.array().cast("array<string>"))
    return pages.withColumn("harvested", F.slice(got, 1, most) if most else got)


# Where a page holds its state, a record, or a bare text; how many bare texts count.
STATE = r"(?s)window\.__INITIAL_STATE__\s*=\s*(\{.+?\});"
RECORD_PARTS = r'"id_str":"(\d+)"[^}]*"text":"([^"]+)"[^}]*"favorite_count":(\d+)[^}]*"retweet_count":(\d+)'
BARE_TEXT = r'"text":"([^"]{20,500})"'
MOST_BARE = 50
_HARVEST = "array<struct<tweet_id: string, text: string, likes: bigint, reposts: bigint>>"


def harvest_records(pages: DataFrame, html_col: str = "html", name_col: str | None = None) -> DataFrame:
    """Adds ``records`` (tweet_id, text, likes, reposts) and ``tier``: what the first way that finds something finds.

    ``state``: the tweets of the timeline in the page's embedded state, if that parses. ``records``: single records by
    their fields. ``texts``: at most 50 bare texts, with made-up ids. Null where a page holds nothing.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    tweet = "struct<id_str: string, id: string, text: string, full_text: string, favorite_count: bigint, retweet_count: bigint>"
    state = F.from_json(F.regexp_extract(html, STATE, 1), f"timeline struct<entries: array<struct<content: struct<tweet: {tweet}>>>>")
    tweets = F.transform(state["timeline"]["entries"], lambda e: e["content"]["tweet"])
    found = F.transform(F.filter(tweets, lambda t: F.coalesce(t["id_str"], t["id"]).isNotNull()), lambda t: F.struct(F.coalesce(t["id_str"], t["id"]).alias("tweet_id"), F.coalesce(t["full_text"], t["text"]).alias("text"), F.coalesce(t["favorite_count"], F.lit(0)).alias("likes"), F.coalesce(t["retweet_count"], F.lit(0)).alias("reposts"))).cast(_HARVEST)
    part = lambda i: F.regexp_extract_all(html, F.lit(RECORD_PARTS), F.lit(i))
    single = F.transform(F.arrays_zip(part(1).alias("a"), part(2).alias("b"), part(3).alias("c"), part(4).alias("d")), lambda r: F.struct(r["a"].alias("tweet_id"), r["b"].alias("text"), r["c"].cast("bigint").alias("likes"), r["d"].cast("bigint").alias("reposts"))).cast(_HARVEST)
    name = F.coalesce(F.col(name_col).cast("string"), F.lit("")) if name_col else F.lit("page")
    bare = F.transform(F.slice(F.regexp_extract_all(html, F.lit(BARE_TEXT), F.lit(1)), 1, MOST_BARE), lambda t, i: F.struct(F.concat(F.lit("syn_"), name, F.lit("_"), i.cast("string")).alias("tweet_id"), t.alias("text"), F.lit(0).alias("likes"), F.lit(0).alias("reposts"))).cast(_HARVEST)
    parsed = state["timeline"]["entries"].isNotNull()  # an embedded state settles the page, also an empty one
    tier = F.when(parsed, "state").when(F.size(single) > 0, "records").when(F.size(bare) > 0, "texts")
    return pages.withColumn("tier", tier).withColumn("records", F.when(F.col("tier") == "state", found).when(F.col("tier") == "records", single).when(F.col("tier") == "texts", bare))


def to_pipeline_event(df: DataFrame) -> DataFrame:
    """Adds ``pipeline_id``, the message id with its source's prefix, and the metrics as one struct."""
    s = F.col("source")
    key = F.when(s == "twitter", F.concat(F.lit("tw_"), "message_id")).when(s == "reddit", F.concat(F.lit("reddit_"), "message_id")).otherwise(F.concat(F.lit("tg_"), F.col("channel"), F.lit("_"), F.col("message_id")))
    return df.withColumn("pipeline_id", key).withColumn("metrics", F.struct("likes", "reposts", "replies", "followers"))


def union_sources(spark: SparkSession, loaders: dict[str, Callable[[], DataFrame]], stage: str | None = None) -> tuple[DataFrame | None, DataFrame]:
    """The union of what loads, by name, and a status row for each source; a failed one adds no rows and does not fail the rest.

    Each source is read whole, once, before it counts, so that one which fails only while it is read is left out too: into
    a folder of its own under ``stage`` (overwritten; by default a new one in the shared folder), from which the union reads.
    """
    frames, status, stage = [], [], stage or scratch_path(spark, "sources")
    for name, load in loaders.items():
        try:
            df = load()
            df.write.mode("overwrite").parquet(f"{stage}/{name}")
            frames.append(spark.read.schema(df.schema).parquet(f"{stage}/{name}"))
            status.append((name, True, None))
        except Exception as e:
            status.append((name, False, f"{type(e).__name__}: {e}"))
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out, spark.createDataFrame(status, T.StructType.fromDDL("source string, ok boolean, error string"))


def range_predicates(column: str, low: int, high: int, parts: int) -> list[str]:
    """SQL conditions that cut a table by ``column`` into ``parts`` ranges: each row meets one, also beyond low and high, or null."""
    edges = [low + (high - low) * i // parts for i in range(1, parts)]
    edges = sorted(set(edges))
    if not edges:
        return ["1 = 1"]
    inner = [f"{column} >= {a} AND {column} < {b}" for a, b in zip(edges, edges[1:], strict=False)]
    return [f"{column} < {edges[0]} OR {column} IS NULL", *inner, f"{column} >= {edges[-1]}"]


def read_relational(spark: SparkSession, url: str, name: str, column: str, low: int, high: int, parts: int = 32, **properties: str) -> DataFrame:
    """A table of a relational store, read by one task for each range of ``column``; filters and columns are pushed to it.

    Needs the store's JDBC driver on the class path.
    """
    return spark.read.jdbc(url, name, predicates=range_predicates(column, low, high, parts), properties=properties)
