"""Streaming operators give the batch operators' rows over the same data in several micro-batches."""

import time

import pytest
from pyspark.sql import functions as F

from crowdsignal.functions import profiles as P
from crowdsignal.operators import admission, ordered
from crowdsignal.sources.records import stream_records
from crowdsignal.streaming import pipeline, stateful
from test_ordered import SCHEMA, rows

FULL = SCHEMA + ", event_time timestamp, text string, alert_key string, score double"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    df = spark.createDataFrame(rows(21, 200), SCHEMA).withColumns({"event_time": F.timestamp_seconds("event_s"), "text": F.when(F.col("event_id") % 3 == 0, "bitcoin moon pump").otherwise("btc crash fear panic"), "alert_key": F.col("channel"), "score": F.col("event_id") % 5 / F.lit(5.0)})
    df = df.withColumn("text", F.when(F.col("event_id") % 10 != 0, F.col("text")))
    for i in range(4):  # arrival order over four files
        df.where(f"event_id >= {50 * i} and event_id < {50 * (i + 1)}").coalesce(1).write.mode("append").parquet(path)
    return path


def drained(spark, tmp_path, df, name):
    out, ck = str(tmp_path / name), str(tmp_path / f"{name}-ck")
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.read.parquet(out)


def test_order_admission_and_suppression(spark, data, tmp_path):
    batch = spark.read.parquet(data)
    stream = lambda: stream_records(spark, data, FULL, 1)
    got = drained(spark, tmp_path, stateful.admit_stream(stream(), "channel", 3), "admit")
    want = admission.admit(batch, ("channel",), 3)
    assert {(r.event_id, r.admitted) for r in got.collect()} == {(r.event_id, r.admitted) for r in want.collect()}
    got = drained(spark, tmp_path, stateful.suppress_stream(stream(), quiet=120), "suppress")
    want = admission.suppress_alerts(batch, quiet=120)
    assert {(r.event_id, r.sent) for r in got.collect()} == {(r.event_id, r.sent) for r in want.collect()}
    seen, flags = {}, {}
    for i, _, s, _, a, e, _, _ in rows(21, 200):
        flags[i] = (s, a) in seen and e < seen[s, a] - P.ORDER_TOLERANCE[s]
        seen[s, a] = max(seen.get((s, a), e), e)
    got = drained(spark, tmp_path, stateful.order_guard_stream(stream()), "order")
    assert {r.event_id: r.out_of_order for r in got.collect()} == flags


def test_dedupe_and_windows(spark, data, tmp_path):
    batch = spark.read.parquet(data)
    got = drained(spark, tmp_path, stateful.dedupe_stream(stream_records(spark, data, FULL, 1), window="2 days"), "dedupe")
    assert got.count() == batch.select("fingerprint").distinct().count() == got.select("fingerprint").distinct().count()
    got = drained(spark, tmp_path, stateful.signal_stream(stream_records(spark, data, FULL, 1), size="10 minutes", delay="10 minutes"), "signal")
    want = batch.groupBy(F.window("event_time", "10 minutes").alias("w"), "asset").agg(F.count("*").alias("n")).select("w.start", "asset", "n")
    whole = {(r.start, r.asset): r.n for r in want.collect()}
    assert got.count() > 0 and all(whole[r.window_start, r.asset] == r.total for r in got.collect())


def test_lateness_is_by_wall_clock(spark):
    df = spark.createDataFrame([("twitter", 0, 15), ("twitter", 0, 16), ("reddit", 5, 4)], "source string, e long, a long").select("source", F.timestamp_seconds("e").alias("event_time"), F.timestamp_seconds("a").alias("arrival_time"))
    assert [r.lateness for r in stateful.with_lateness(df).collect()] == [None, "late", "future"]


def fine(source="source"):
    lag = F.col("arrival_s") - F.col("event_s")
    return F.col("text").isNotNull() & (lag >= 0) & (lag <= F.coalesce(*[F.when(F.col(source) == k, v) for k, v in P.MAX_DELAY.items()]))


def whole(spark, path, table):
    out = [spark.read.parquet(f"{path}/{s}/{table}") for s in P.RELIABILITY]
    return out[0].unionByName(out[1]).unionByName(out[2])


def test_pipeline_writes_each_batch_once(spark, data, tmp_path):
    path, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    for _ in range(2):  # the second start finds nothing new
        streams = {s: stream_records(spark, data, FULL, 2).where(F.col("source") == s) for s in P.RELIABILITY}
        for q in pipeline.start_pipeline(streams, path, ck).values():
            q.awaitTermination(120)
    rows_in = spark.read.parquet(data)
    raw = whole(spark, path, "raw")
    assert 0 < raw.count() == rows_in.where(fine()).count() == raw.select("event_id").distinct().count()
    drops = spark.read.parquet(f"{path}/twitter/drops").groupBy("reason").agg(F.sum("count").alias("n")).collect()
    assert sum(r.n for r in drops) == rows_in.where("source = 'twitter'").count() and {"late", "future"} & {r.reason for r in drops}
    assert {r.label for r in spark.read.parquet(f"{path}/reddit/sentiment").select("label").distinct().collect()} <= {-1, 1}
    quality = whole(spark, path, "quality")
    assert quality.agg(F.sum("collected")).first()[0] == rows_in.count() and quality.agg(F.sum("inserted")).first()[0] == raw.count()


def test_pipeline_goes_on_after_a_restart_with_more_to_read(spark, data, tmp_path):
    path, ck, folder = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "in")
    rows_in = spark.read.parquet(data)
    for part in ("event_id < 100", "event_id >= 100"):
        rows_in.where(part).coalesce(1).write.mode("append").parquet(folder)
        streams = {s: stream_records(spark, folder, FULL, 1).where(F.col("source") == s) for s in P.RELIABILITY}
        for q in pipeline.start_pipeline(streams, path, ck, hook=lambda d: d.withColumn("text", F.upper("text"))).values():
            q.awaitTermination(120)
    raw = whole(spark, path, "raw")
    assert raw.count() == rows_in.where(fine()).count() == raw.select("event_id").distinct().count()
    assert raw.where("text <> upper(text)").count() == 0


def test_one_source_fails_and_the_others_go_on(spark, data, tmp_path):
    path, ck = str(tmp_path / "out"), str(tmp_path / "ck")
    streams = {s: stream_records(spark, data, FULL, 2).where(F.col("source") == s) for s in P.RELIABILITY}
    streams["reddit"] = streams["reddit"].withColumn("text", F.raise_error(F.lit("away")))
    queries = pipeline.start_pipeline(streams, path, ck)
    with pytest.raises(Exception, match="away"):
        queries["reddit"].awaitTermination(120)
    for s in ("twitter", "telegram"):
        queries[s].awaitTermination(120)
        assert spark.read.parquet(f"{path}/{s}/raw").count() == spark.read.parquet(data).where((F.col("source") == s) & fine()).count()


def test_pipeline_runs_on_and_drops_repeats(spark, data, tmp_path):
    path, ck, folder = str(tmp_path / "out"), str(tmp_path / "ck"), str(tmp_path / "in")
    rows_in = spark.read.parquet(data).where("source = 'reddit'")
    for _ in range(2):
        rows_in.coalesce(1).write.mode("append").parquet(folder)
    q = pipeline.start_pipeline({"reddit": stream_records(spark, folder, FULL, 1)}, path, ck, every="0 seconds", dedupe="fingerprint")["reddit"]
    try:
        q.processAllAvailable()
        assert q.isActive
        raw = spark.read.parquet(f"{path}/reddit/raw")
        # the first row of a fingerprint counts, also where a rule drops it
        passed = rows_in.where(fine()).select("fingerprint").distinct()
        assert 0 < raw.count() == raw.select("fingerprint").distinct().count() <= passed.count() and raw.join(passed, "fingerprint", "left_anti").isEmpty()
    finally:
        q.stop()


def test_state_of_a_key_expires(spark, data, tmp_path):
    stream = stateful.admit_stream(stream_records(spark, data, FULL, 1), "channel", 3, ttl=1)
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            time.sleep(1)
            progress = q.lastProgress
            if progress and progress["stateOperators"] and progress["numInputRows"] == 0 and progress["stateOperators"][0]["numRowsTotal"] == 0:
                break
        assert q.isActive and q.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
    finally:
        q.stop()
