"""Stateful steps against models in order, over several runs of one checkpoint; state that timers end; commits."""

import random

import pytest
from pyspark.sql import functions as F

from crowdsignal.functions import profiles as P
from crowdsignal.operators import ordered
from crowdsignal.plans import streams
from crowdsignal.streaming import commits, processors, worker

SCHEMA = "event_id bigint, source string, asset string, channel string, text string, fingerprint string, event_s bigint, arrival_s bigint"


def some_rows(seed, n=400):
    rng = random.Random(seed)
    t, out = streams.EPOCH, []
    for i in range(n):
        t += rng.choice([0, 1, 5, 40])
        out.append((i, rng.choice(["twitter", "reddit", "telegram"]), "BTC", f"c{rng.randrange(4)}", rng.choice(["pump it", "Pump it!", "other"]), rng.choice([None, *"abcdef"]), t - rng.randrange(100), t))
    return out


def stepped(spark, rows, step):
    return streams.drained(spark.createDataFrame(rows, SCHEMA), lambda s: {"rows": step(processors.arriving(s))})["rows"]


def test_order_guard_and_duplicates_against_models(spark):
    rows = some_rows(1)
    seen, want = {}, {}
    for i, s, a, _, _, _, e, _ in rows:
        want[i] = (s, a) in seen and e < seen[s, a] - P.ORDER_TOLERANCE[s]
        seen[s, a] = max(seen.get((s, a), e), e)
    assert {r.event_id: r.out_of_order for r in stepped(spark, rows, processors.order_guard).collect()} == want
    accepted, want = {}, {}
    for i, s, _, _, _, fp, _, t in rows:
        want[i] = fp is not None and (s, fp) in accepted and t <= accepted[s, fp] + P.DUPLICATE_WINDOW[s]
        if not want[i]:
            accepted[s, fp] = t
    got = stepped(spark, rows, lambda s: processors.duplicates(s, parts=2))
    assert {r.event_id: r.duplicate for r in got.collect()} == want and True in want.values()


@pytest.mark.parametrize("profile", ["ing_tw", "crawl_tw"])
def test_velocity_ring_equals_the_batch_operator(spark, profile):
    rows = some_rows(2)
    got = {r.event_id: r.velocity for r in stepped(spark, rows, lambda s: processors.velocity(s, profile, ("channel",))).collect()}
    want = ordered.velocity(spark.createDataFrame(rows, SCHEMA), profile, ("channel",), "arrival_s", exact=True)
    assert got == {r.event_id: pytest.approx(r.velocity) for r in want.collect()}


def test_chats_of_a_phrase_in_the_last_minutes(spark):
    rows = some_rows(3)
    got = {r.event_id: r.coordinated for r in stepped(spark, rows, processors.coordinated).collect()}
    clean = lambda x: x.lower().replace("!", "")
    for i, _, _, _, text, _, _, t in rows:
        near = {r[3] for r in rows if clean(r[4]) == clean(text) and t - 300 < r[7] <= t}
        assert got[i] == (len(near) >= 3), i


def test_dropped_rows_pass_on_and_touch_no_state(spark):
    rows = [(i, "twitter", "BTC", "c", "x", "f", streams.EPOCH + 10 * i, streams.EPOCH + 10 * i) for i in range(6)]
    drop = lambda s: s.withColumn("drop_reason", F.when(F.col("event_id") == 0, "late"))
    out = stepped(spark, rows, lambda s: processors.velocity(processors.duplicates(drop(s)), "ing_tw")).orderBy("event_id").collect()
    assert [r.duplicate for r in out] == [False, False, True, True, True, True]
    assert out[0].velocity is None and out[0].drop_reason == "late" and out[1].velocity == pytest.approx(5.0)


def test_timers_end_state_once_its_window_is_over(spark, tmp_path):
    t = streams.EPOCH
    first = [(i, "twitter", "BTC", "c", "x", f"f{i}", t + i, t + i) for i in range(50)]
    late = [(99, "twitter", "BTC", "c", "x", "late", t + 5000, t + 5000)]
    left = []
    for rows in (first, late):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = processors.duplicates(processors.arriving(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), delay="1 minute"))
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination()
        left.append(q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"])
    assert left == [50, 1]


def test_a_batch_appears_in_all_tables_at_once_and_once(spark, tmp_path):
    path = str(tmp_path)
    one = spark.createDataFrame([(1,)], "x int")
    assert commits.commit_batch(path, 0, {"a": one, "b": one}) and not commits.commit_batch(path, 0, {"a": one, "b": one})
    broken = one.withColumn("x", F.raise_error(F.lit("away")).cast("int"))
    with pytest.raises(Exception, match="away"):
        commits.commit_batch(path, 1, {"a": one, "b": broken})
    assert spark.read.parquet(f"{path}/a").count() == 2 and commits.committed(spark, path, "a").count() == 1
    assert commits.commit_batch(path, 1, {"a": one, "b": one})
    assert commits.committed(spark, path, "a").count() == commits.committed(spark, path, "b").count() == 2


def test_worker_reads_what_comes_later_and_stores_it_once(spark, tmp_path):
    rows = [(i, s, "BTC", "c", text, None, streams.EPOCH + e, streams.EPOCH + 10 * i) for i, (s, text, e) in enumerate([("telegram", "btc pump", 0), ("telegram", "btc pump", 0), ("telegram", "bitcoin and eth", 26), ("twitter", "nothing", 0), ("twitter", "btc", -400), ("twitter", None, 0), ("reddit", "btc crash fear panic", 60)])]
    path = str(tmp_path / "out")

    def start(stream, checkpoint):
        return [worker.start_worker(stream.drop("fingerprint"), path, checkpoint)]

    streams.in_two_runs(spark.createDataFrame(rows, SCHEMA), start)
    raw = {r.event_id: r for r in commits.committed(spark, path, "raw").collect()}
    assert set(raw) == {0, 6} | ({2} if 26 - 20 <= 5 else set())
    assert raw[0].manipulation and raw[0].asset_found == "BTC" and raw[0].source_reliability == P.RELIABILITY["telegram"]
    drops = {(r.source, r.reason): r.n for r in commits.committed(spark, path, "drops").groupBy("source", "reason").agg(F.sum("n").alias("n")).collect()}
    assert drops["telegram", "duplicate"] == 1 and drops["twitter", "delayed"] == 1 and drops["twitter", "Missing text content"] == 1
    assert {r.label for r in commits.committed(spark, path, "risk").where("event_id = 6").collect()} == {-1}


def backlog(n=600, step=40):
    """Rows of one source over hours: repeats within, at and beyond the window of 300 s, some of them in another batch."""
    t = streams.EPOCH
    return [(i, "twitter", "BTC", f"c{i % 3}", "x", f"f{(i // 14) * 7 + i % 7}" if i % 5 else f"f{i}", t + step * i, t + step * i) for i in range(n)]


def test_a_run_takes_bounded_batches_in_order(spark):
    rows, seen = random.Random(5).sample(backlog(), 600), []

    def start(stream, checkpoint):
        note = lambda batch, _: seen.append(sorted(r.arrival_s for r in batch.select("arrival_s").collect()))
        return [stream.writeStream.foreachBatch(note).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()]

    streams.in_two_runs(spark.createDataFrame(rows, SCHEMA), start, most=100)
    assert [t for batch in seen for t in batch] == sorted(r[7] for r in rows)
    assert len(seen) >= 6 and max(map(len, seen)) <= 200


def in_batches(spark, monkeypatch, rows, step, most):
    monkeypatch.setattr(streams.in_two_runs, "__defaults__", ("arrival_s", most))
    return stepped(spark, rows, step).collect()


@pytest.mark.parametrize("most", [90, 100_000])
def test_repeats_over_batches_against_the_model(spark, monkeypatch, most):
    rows, accepted, want = backlog(), {}, {}
    for i, s, _, _, _, fp, _, t in rows:
        want[i] = fp in accepted and t <= accepted[fp] + P.DUPLICATE_WINDOW[s]
        if not want[i]:
            accepted[fp] = t
    got = in_batches(spark, monkeypatch, rows, lambda s: processors.duplicates(s, parts=2), most)
    assert {r.event_id: r.duplicate for r in got} == want and 0 < sum(want.values()) < len(rows)


def state_rows(spark, tmp_path, step):
    """Rows of state after one batch that holds the whole backlog."""
    spark.createDataFrame(backlog(), SCHEMA).write.parquet(str(tmp_path / "in"))
    stream = step(processors.arriving(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))))
    q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    return max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress)


def test_a_backlog_leaves_the_fingerprints_of_its_last_minutes(spark, tmp_path):
    assert 0 < state_rows(spark, tmp_path, lambda s: processors.duplicates(s.withColumn("fingerprint", F.col("event_id").cast("string")), parts=2)) <= 2 * (600 + 300) // 40 + 2


@pytest.mark.parametrize("profile,most", [("ing_tw", 90), ("ing_tw", 100_000), ("crawl_tw", 300)])
def test_velocity_over_slices_and_batches_equals_the_batch_operator(spark, monkeypatch, profile, most):
    rows = backlog(step=30 if profile == "ing_tw" else 300)
    got = {r.event_id: r.velocity for r in in_batches(spark, monkeypatch, rows, lambda s: processors.velocity(s, profile), most)}
    want = ordered.velocity(spark.createDataFrame(rows, SCHEMA), profile, ("source",), "arrival_s", exact=True)
    assert got == {r.event_id: pytest.approx(r.velocity) for r in want.collect()}


def test_a_source_of_a_backlog_is_a_key_for_each_slice(spark, tmp_path):
    span, times = processors.SLICE * 300, [r[7] for r in backlog()]
    slices = {t // span for t in times} | {(t + 300) // span for t in times}
    assert state_rows(spark, tmp_path, lambda s: processors.velocity(s, "ing_tw")) == len(slices) >= 3


def test_the_worker_counts_and_stores_the_same_in_many_batches(spark, tmp_path):
    rows = [(i, s, "BTC", "c", "btc moon" if i % 11 else "nothing", None, streams.EPOCH + 40 * (i - i % 4) - 9 + 90 * (i % 13 == 0), streams.EPOCH + 40 * i) for i in range(300) for s in ("twitter", "telegram")]
    got = []
    for most in (150, 100_000):
        path = str(tmp_path / f"out{most}")

        def start(stream, checkpoint, path=path):
            return [worker.start_worker(stream.drop("fingerprint"), path, checkpoint)]

        streams.in_two_runs(spark.createDataFrame(rows, SCHEMA), start, most=most)
        commits.committed(spark, path, "drops").drop("batch").write.parquet(f"{path}/drops/batch=1000000")  # never committed
        drops = commits.committed(spark, path, "drops")
        got.append((sorted(map(tuple, drops.groupBy("source", "reason").agg(F.sum("n")).collect())), sorted(map(tuple, commits.committed(spark, path, "raw").select("source", "event_id", "velocity").collect())), drops.select("batch").distinct().count()))
    assert got[0][:2] == got[1][:2] and got[0][2] >= 4 > got[1][2]
    assert sum(n for *_, n in got[0][0]) == len(rows) and {r for _, r, _ in got[0][0]} >= {"accepted", "duplicate", "future", "No keyword match"}
