"""Order-sensitive operators against sequential models on random rows with ties, gaps and repeats."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from crowdsignal.functions import profiles as P
from crowdsignal.operators import admission, ordered


def rows(seed, n=300):
    rng = random.Random(seed)
    at, out = 1000, []
    for i in range(n):
        at += rng.choice([0, 0, 1, 3, 20, 90])
        out.append((i, 0, rng.choice(["twitter", "reddit", "telegram"]), rng.choice("ab"), rng.choice(["BTC", "ETH"]), at - rng.choice([-3, 0, 5, 14, 40, 130]), at, f"f{rng.randrange(60)}"))
    return out


SCHEMA = "event_id bigint, replay int, source string, channel string, asset string, event_s bigint, arrival_s bigint, fingerprint string"


def model_guard(data):
    last, accepted, out = {}, {}, {}
    for i, _, s, _, a, e, t, f in data:
        reason = None
        if e > t:
            reason = "future"
        elif t - e > P.MAX_DELAY[s]:
            reason = "late"
        elif (s, a) in last and e < last[s, a] - P.ORDER_TOLERANCE[s]:
            reason = "out_of_order"
        elif f in accepted and t - accepted[f] <= P.DUPLICATE_WINDOW[s]:
            reason = "duplicate"
        else:
            last[s, a] = max(last.get((s, a), e), e)
            accepted[f] = t
        out[i] = reason
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_time_guard(spark, seed):
    data = rows(seed)
    # a fingerprint names one source, asset and event time, as in the guard itself
    data = [(*r[:7], f"{r[2]}|{r[4]}|{r[5]}|{r[7][:2]}") for r in data]
    data += [(1000 + i, 1, *data[i][2:6], data[i][6], data[i][7]) for i in range(0, 300, 7)]
    data.sort(key=lambda r: (r[6], r[0], r[1]))
    got = {r.event_id: r.guard_reason for r in ordered.time_guard(spark.createDataFrame(data, SCHEMA)).collect()}
    assert got == model_guard(data)


@pytest.mark.parametrize("limit", [1, 3])
def test_admission(spark, limit):
    data = rows(3)
    kept, want = defaultdict(deque), {}
    for i, _, _, c, _, _, t, _ in data:
        q = kept[c]
        while q and q[0] <= t - 60:
            q.popleft()
        want[i] = len(q) < limit
        if want[i]:
            q.append(t)
    got = {r.event_id: r.admitted for r in admission.admit(spark.createDataFrame(data, SCHEMA), ("channel",), limit).collect()}
    assert got == want


def test_neither_admission_gathers_rows(spark):
    df = spark.createDataFrame(rows(3), SCHEMA)
    plan = lambda x: x._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan(admission.admit(df, ("channel",), 3))
    assert "SinglePartition" not in plan(ordered.admit_per_run(df, ("channel",), 40, 60, ("arrival_s", "event_id"))).split("TakeOrderedAndProject")[0]


def test_admission_of_one_key_without_a_pause(spark):
    data = [(i, 0, "twitter", "a", "BTC", 1000 + i // 3, 1000 + i // 3, "f") for i in range(30_000)]
    kept, want = deque(), {}
    for r in data:
        while kept and kept[0] <= r[6] - 60:
            kept.popleft()
        want[r[0]] = len(kept) < 8
        if want[r[0]]:
            kept.append(r[6])
    got = {r.event_id: r.admitted for r in admission.admit(spark.createDataFrame(data, SCHEMA).repartition(5), ("source",), 8).collect()}
    assert got == want


def test_velocity_counts_itself_and_those_before(spark):
    data = rows(4)
    got = {r.event_id: r.velocity for r in ordered.velocity(spark.createDataFrame(data, SCHEMA), "crawl_tw", ("channel",)).collect()}
    by_time = sorted(data, key=lambda r: (r[5], r[0]))
    for k, r in enumerate(by_time):
        seen = [x for x in by_time[: k + 1] if x[3] == r[3]]
        short = sum(x[5] >= r[5] - 60 for x in seen) / 60
        long = sum(x[5] >= r[5] - 3600 for x in seen) / 3600
        assert got[r[0]] == pytest.approx(short / long)


def test_per_run_caps(spark):
    data = rows(5)
    out = ordered.admit_per_run(spark.createDataFrame(data, SCHEMA), ("channel",), 40, 60, ("arrival_s", "event_id")).collect()
    taken, n, want = 0, defaultdict(int), {}
    for r in data:
        if n[r[3]] >= 40:
            want[r[0]] = "source_rate"
        elif taken >= 60:
            want[r[0]] = "global_rate"
            n[r[3]] += 1
        else:
            want[r[0]] = None
            n[r[3]] += 1
            taken += 1
    assert {r.event_id: r.run_reason for r in out} == want


def test_coordinated(spark):
    texts = [(0, "a", "Pump it!"), (10, "b", "pump it"), (20, "c", "PUMP it 2"), (400, "d", "pump it"), (15, "a", "other")]
    df = spark.createDataFrame([(i, c, t, s) for i, (s, c, t) in enumerate(texts)], "event_id int, channel string, text string, event_s bigint")
    got = {r.event_id: r.coordinated for r in ordered.flag_coordinated(df).collect()}
    assert got == {0: False, 1: False, 2: True, 3: False, 4: False}


def test_suppressed_alerts_do_not_extend_the_pause(spark):
    df = spark.createDataFrame([(i, "k", t) for i, t in enumerate([0, 300, 599, 600, 900, 1200])], "event_id int, alert_key string, arrival_s bigint")
    got = admission.suppress_alerts(df).orderBy("event_id").collect()
    assert [r.sent for r in got] == [True, False, False, True, False, True]


def test_sort_by_event_time_keeps_every_row_in_order(spark):
    data = rows(6, 1500)
    data = [(*r[:5], None if r[0] % 50 == 0 else r[5], *r[6:]) for r in data]
    random.Random(1).shuffle(data)
    got = [(r.event_s, r.event_id) for r in ordered.sort_by_event_time(spark.createDataFrame(data, SCHEMA).repartition(7)).collect()]
    assert got == sorted(((r[5], r[0]) for r in data), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_empty_input(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ordered.time_guard(empty).count() == 0
    assert admission.admit(empty, ("channel",), 3).count() == 0
    assert ordered.velocity(empty, "ing_tw").agg(F.count("*")).first()[0] == 0
