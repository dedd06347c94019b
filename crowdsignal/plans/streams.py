"""Queries of the streaming operators: each runs to its end over files of messages, in two runs of one checkpoint, and is read back."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import profiles as P
from ..sources.records import stream_records
from ..streaming import commits, processors, worker
from .core import ID
from .inputs import messages, scratch, with_messages
from .ordered import _CASES, GUARD, _fold, _recursive
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

#: Seconds added to all times: a stream's watermark starts at 0, and a minute begins here.
EPOCH = 1_600_000_020
ORDER = ("event_id", "replay")
#: Rows of a micro-batch, about, and the files that hold them.
BATCH, FILES = 4_000_000, 20
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with times as a stream has them."""
    m = messages(spark, sf_dir)
    return m.withColumns({"arrival_s": F.col("arrival_s") + EPOCH, "event_s": F.col("event_s") + EPOCH})


def arrive(rows: DataFrame, folder: str, label: str, ts: str, most: int) -> int:
    """Add ``rows`` to ``folder`` in files that follow ``ts``, also by their times of change, by which a stream takes them.

    Gives how many files hold ``most`` rows, about. Rows of one second are in one file. A store that does not keep times
    of change has no order of files, so there all of them are one batch.
    """
    spark, staged, n = rows.sparkSession, scratch(rows.sparkSession, "staged"), rows.count()
    rows.repartitionByRange(max(1, -(-n * FILES // most)), ts).write.parquet(staged)
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    parts = sorted(p for x in fs.listStatus(path(staged)) if (p := x.getPath().getName()).startswith("part-"))
    times, now = [], int(time.time() * 1000)
    for i, part in enumerate(parts):
        to = path(f"{folder}/{label}-{i:08d}.parquet")
        if not fs.rename(path(f"{staged}/{part}"), to):
            raise OSError(f"{to} could not be written")
        fs.setTimes(to, now + i, -1)
        times.append(fs.getFileStatus(to).getModificationTime())
    ordered = all(a < b for a, b in zip(times, times[1:], strict=False))
    return max(1, len(parts) * most // n if ordered and n else len(parts))


def in_two_runs(rows: DataFrame, start: Callable[[DataFrame, str], list], ts: str = "arrival_s", most: int = BATCH) -> None:
    """Files of the first half of the time, then of the second, each read to the end by the queries that ``start`` starts.

    ``start(stream, checkpoint)`` gives started queries; the second run goes on from the first one's checkpoint and state.
    A run takes ``most`` rows at a time, about, in the order of ``ts``.
    """
    spark = rows.sparkSession
    folder, checkpoint = scratch(spark, "arrivals"), scratch(spark, "checkpoint")
    low, high = rows.agg(F.min(ts), F.max(ts)).first()
    middle = ((low or 0) + (high or 0)) // 2
    provider = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        for label, half in (("first", F.col(ts) <= middle), ("second", F.col(ts) > middle)):
            files = arrive(rows.where(half), folder, label, ts, most)
            for query in start(stream_records(spark, folder, rows.schema, files), checkpoint):
                query.awaitTermination()
    finally:
        spark.conf.set(_PROVIDER, provider)


def drained(rows: DataFrame, make: Callable[[DataFrame], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """What the streams of ``make`` wrote, by name, after both runs."""
    spark, out, schemas = rows.sparkSession, scratch(rows.sparkSession, "streamed"), {}

    def start(stream: DataFrame, checkpoint: str) -> list:
        started = []
        for name, df in make(stream).items():
            schemas[name] = df.schema
            started.append(df.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start())
        return started

    in_two_runs(rows, start)
    return {name: spark.read.schema(schema).parquet(f"{out}/{name}") for name, schema in schemas.items()}


def _stepped(spark: SparkSession, sf_dir: str, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return drained(arrivals(spark, sf_dir), lambda s: {"rows": step(processors.arriving(s)).drop(processors.AT)})["rows"]


@register("str3_order_guard", with_messages(f", {GUARD} SELECT event_id, replay, coalesce(e1 IS NULL AND event_s < seen - {_CASES(P.ORDER_TOLERANCE)}, FALSE) AS out_of_order FROM g2"))
def str3(spark, sf_dir):
    """Rows past the future and late tests, against the latest event of their source and asset."""
    lag, source = F.col("arrival_s") - F.col("event_s"), F.col("source")
    most = F.create_map(*[F.lit(x) for pair in P.MAX_DELAY.items() for x in pair])[source]
    tested = lambda s: s.withColumn("drop_reason", F.when(lag < 0, "future").when(lag > most, "late"))
    return _stepped(spark, sf_dir, lambda s: processors.order_guard(tested(s), order=ORDER)).select(*ID, "out_of_order")


@register("str4_duplicates_by_source", _recursive(f", a AS (SELECT *, source || '|' || text AS fingerprint FROM m), {_fold('f', 'a', 'fingerprint', 1, "CASE split_part(f_rows.fingerprint, '|', 1) WHEN 'twitter' THEN 301 WHEN 'reddit' THEN 1801 ELSE 601 END")} SELECT event_id, replay, NOT admitted AS duplicate FROM f"))
def str4(spark, sf_dir):
    """A text repeated within its source's own window."""
    return _stepped(spark, sf_dir, lambda s: processors.duplicates(s.withColumn("fingerprint", F.concat_ws("|", "source", "text")), order=ORDER)).select(*ID, "duplicate")


def _velocity_of(rows: str, p: dict) -> str:
    """SQL of the velocity over ``rows``, by arrival."""
    over = lambda s: f"(count(*) OVER (PARTITION BY source ORDER BY arrival_s RANGE BETWEEN {s - 1} PRECEDING AND CURRENT ROW) - later) / {s}.0::DOUBLE"
    return f"""v0 AS (SELECT *, count(*) OVER (PARTITION BY source, arrival_s) - row_number() OVER (PARTITION BY source, arrival_s ORDER BY event_id, replay) AS later FROM {rows}),
 v AS (SELECT *, round({over(p['short'])} / ({over(p['long'])}), 6) AS velocity FROM v0)"""


@register("vl5_stream_velocity", with_messages(f", {_velocity_of('m', P.VELOCITY['ing_tw'])} SELECT event_id, replay, velocity FROM v"))
def vl5(spark, sf_dir):
    """The rate of a source's last minute over that of its last five, from a ring of counts by second."""
    return _stepped(spark, sf_dir, lambda s: processors.velocity(s, "ing_tw", order=ORDER)).select(*ID, F.round("velocity", 6).alias("velocity"))


@register("mn3_stream_coordinated", with_messages(", d AS (SELECT event_id, replay, len(list_distinct(list(channel) OVER (PARTITION BY text ORDER BY arrival_s RANGE BETWEEN 299 PRECEDING AND CURRENT ROW))) >= 3 AS coordinated FROM m) SELECT * FROM d"))
def mn3(spark, sf_dir):
    """A phrase used in three chats within five minutes."""
    return _stepped(spark, sf_dir, lambda s: processors.coordinated(s, order=ORDER)).select(*ID, "coordinated")


_LATE = _CASES(P.MAX_DELAY)


@register("str2_lateness_by_source", with_messages(f""", l AS (SELECT *, CASE WHEN arrival_s < event_s THEN 'future' WHEN arrival_s - event_s > {_LATE} THEN 'late' END AS lateness FROM m),
 w AS (SELECT min(t) AS mark FROM (SELECT max(event_s) - max({_LATE}) AS t FROM l WHERE lateness IS NULL GROUP BY source)),
 c AS (SELECT source, asset, CAST(floor(event_s / 60.0::DOUBLE) AS BIGINT) * 60 AS window_s, count(*) AS n FROM l WHERE lateness IS NULL GROUP BY ALL)
 SELECT source, asset, window_s, NULL::VARCHAR AS lateness, n FROM c, w WHERE window_s + 60 <= mark
 UNION ALL SELECT source, asset, NULL, lateness, count(*) FROM l WHERE lateness IS NOT NULL GROUP BY source, asset, lateness"""))
def str2(spark, sf_dir):
    """Minutes of rows on time, final once the slowest source has passed them, and the other rows by source and lateness."""
    rows = arrivals(spark, sf_dir).withColumns({"event_time": F.timestamp_seconds("event_s"), "arrival_time": F.timestamp_seconds("arrival_s")})

    def make(stream: DataFrame) -> dict[str, DataFrame]:
        counts, late = processors.windows_by_source({s: stream.where(F.col("source") == s) for s in P.MAX_DELAY})
        return {"counts": counts, "late": late.select("source", "asset", "lateness")}

    out = drained(rows, make)
    counts = out["counts"].select("source", "asset", (F.unix_seconds("window_start") - EPOCH).alias("window_s"), F.lit(None).cast("string").alias("lateness"), F.col("total").alias("n"))
    return counts.union(out["late"].groupBy("source", "asset", "lateness").agg(F.count("*").alias("n")).select("source", "asset", F.lit(None).cast("bigint"), "lateness", "n"))


KEYWORDS = ("moon", "dump", "buy", "lambo", "panic")
_LIVE = f""", d AS (SELECT * REPLACE (CASE WHEN event_id % 17 = 0 THEN event_s - 400 WHEN event_id % 19 = 0 THEN event_s + 60 ELSE event_s END AS event_s) FROM m),
 r AS (SELECT *, CASE WHEN {' AND '.join(f"NOT contains(text, '{k}')" for k in KEYWORDS)} THEN 'No keyword match' WHEN arrival_s - event_s < -5 THEN 'future' WHEN arrival_s - event_s > 300 THEN 'delayed' END AS rule FROM d),
 q AS (SELECT *, coalesce(rule, CASE WHEN row_number() OVER (PARTITION BY source, text, event_s, rule IS NULL ORDER BY arrival_s, event_id, replay) > 1 THEN 'duplicate' END) AS reason FROM r),
 a AS (SELECT * FROM q WHERE reason IS NULL), {_velocity_of('a', P.VELOCITY['ing_tw'])}"""


@register("src9_stream_records", with_messages("SELECT event_id, replay, text FROM m WHERE likes > 50"))
def src9(spark, sf_dir):
    """Messages as they arrive, filtered."""
    return drained(arrivals(spark, sf_dir), lambda s: {"rows": s.where("likes > 50").select(*ID, "text")})["rows"]


def _worker(spark: SparkSession, sf_dir: str, hook: Callable[[DataFrame], DataFrame] | None = None) -> str:
    """The folder of a worker's tables, after both runs."""
    e, path = F.col("event_id"), scratch(spark, "worker")
    rows = arrivals(spark, sf_dir).withColumn("event_s", F.when(e % 17 == 0, F.col("event_s") - 400).when(e % 19 == 0, F.col("event_s") + 60).otherwise(F.col("event_s")))
    in_two_runs(rows, lambda stream, checkpoint: [worker.start_worker(stream, path, checkpoint, hook=hook, keywords=KEYWORDS, order=ORDER)])
    return path


@register("str1_live_worker", with_messages(f"""{_LIVE} SELECT event_id, replay, velocity, CASE source WHEN 'twitter' THEN likes + 2.0::DOUBLE * reposts + 1.5::DOUBLE * replies ELSE 0.0::DOUBLE END AS engagement_weight,
 CASE source WHEN 'telegram' THEN 1.0::DOUBLE ELSE round(least(10.0::DOUBLE, followers / 10000.0::DOUBLE), 6) END AS author_weight, source = 'telegram' AND contains(text, '100x') AS manipulation,
 CASE WHEN contains(text, 'eth') THEN 'ETH' WHEN contains(text, 'sol') THEN 'SOL' ELSE 'BTC' END AS asset_found FROM v"""))
def str1(spark, sf_dir):
    """The raw rows that the worker stores, with what it stores beside them."""
    raw = commits.committed(spark, _worker(spark, sf_dir), "raw")
    return raw.select(*ID, F.round("velocity", 6).alias("velocity"), "engagement_weight", F.round("author_weight", 6).alias("author_weight"), "manipulation", "asset_found")


@register("snk8_committed_batches", with_messages(f"{_LIVE} SELECT source, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM q GROUP BY ALL"))
def snk8(spark, sf_dir):
    """What the worker counted by reason; a batch that broke off before its manifest is not read."""
    path = _worker(spark, sf_dir)
    commits.committed(spark, path, "drops").drop("batch").write.parquet(f"{path}/drops/batch=1000000")
    return commits.committed(spark, path, "drops").groupBy("source", "reason").agg(F.sum("n").alias("n"))


@register("ud4_batch_hook", with_messages(f"{_LIVE} SELECT source, coalesce(reason, CASE WHEN reposts = 0 THEN 'unwanted' END, 'accepted') AS reason, count(*) AS n FROM q GROUP BY ALL"))
def ud4(spark, sf_dir):
    """A caller's function drops what it does not want of every batch, before rows are scored and stored."""
    unwanted = lambda rows: rows.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("reposts") == 0, "unwanted")))
    return commits.committed(spark, _worker(spark, sf_dir, unwanted), "drops").groupBy("source", "reason").agg(F.sum("n").alias("n"))
