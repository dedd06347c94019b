"""Joint admission and suppression against models that read every row in order."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from crowdsignal.operators import admission

SCHEMA = "event_id int, source string, channel string, arrival_s bigint, cap int"


def load(seed, n=3000):
    """Arrivals whose rate rises and falls, so that both limits bind in places and neither does in others."""
    rng = random.Random(seed)
    t, out = 1000, []
    for i in range(n):
        t += rng.choice([0, 0, 1, 2]) if (i // 150) % 3 == 0 else rng.choice([5, 9, 14, 20])
        out.append((i, rng.choice(["a", "b"]), f"c{min(4, int(rng.expovariate(0.7)))}", t, rng.choice([3])))
    return out


def joint_model(data, limit, overall, window=60):
    kept, out = defaultdict(deque), {}
    for i, s, c, t, _ in sorted(data, key=lambda r: (r[3], r[0])):
        for key in ((s, c), s):
            while kept[key] and kept[key][0] <= t - window:
                kept[key].popleft()
        out[i] = "source_rate" if len(kept[s, c]) >= limit else "global_rate" if len(kept[s]) >= overall else None
        if out[i] is None:
            kept[s, c].append(t)
            kept[s].append(t)
    return out


@pytest.mark.parametrize("seed, limit, overall", [(1, 3, 8), (2, 20, 30), (3, 3, 1000), (4, 1, 1), (5, 0, 5)])
def test_joint_admission_matches_a_model_in_order(spark, seed, limit, overall):
    data = load(seed)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    out = admission.admit_jointly(df, ("source", "channel"), limit, ("source",), overall, order=("event_id",))
    want = joint_model(data, limit, overall)
    assert {r.event_id: r.rate_reason for r in out.collect()} == want
    assert out.count() == len(data) and {r.admitted == (r.rate_reason is None) for r in out.collect()} == {True}
    if limit == 3 and overall == 8:
        assert {"source_rate", "global_rate", None} == set(want.values())


def test_a_row_that_the_global_limit_drops_leaves_the_source_its_quota(spark):
    rows = [(0, "a", "x", 0, 0), (1, "a", "y", 1, 0), (2, "a", "y", 2, 0), (3, "a", "y", 60, 0), (4, "a", "y", 61, 0)]
    out = admission.admit_jointly(spark.createDataFrame(rows, SCHEMA), ("source", "channel"), 2, ("source",), 2, order=("event_id",))
    assert [r.rate_reason for r in out.orderBy("event_id").collect()] == [None, None, "global_rate", None, None]


def test_limits_from_a_column_nulls_and_an_empty_table(spark):
    rows = [(0, "a", "x", 0, 1), (1, "a", "x", 1, 1), (2, "a", "y", 1, 2), (3, "a", "y", 1, 2), (4, "a", None, 1, 2), (5, "a", "y", None, 2), (6, None, "y", 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = admission.admit_jointly(df, ("source", "channel"), "cap", ("source",), 3, order=("event_id",))
    assert [(r.rate_reason, r.admitted) for r in out.orderBy("event_id").collect()] == [(None, True), ("source_rate", False), (None, True), (None, True), (None, None), (None, None), (None, None)]
    assert out.columns == [*df.columns, "rate_reason", "admitted"]
    assert admission.admit_jointly(df.limit(0), ("source", "channel"), 3, ("source",), 9, order=("event_id",)).count() == 0
    with pytest.raises(ValueError):
        admission.admit_jointly(df, ("channel",), 3, ("source",), 9)


def test_a_key_without_a_pause_is_settled_in_many_stretches(spark):
    """Arrivals never pause for a minute, the load does: no task folds more than one stretch of it."""
    data = [(i, "a", "x", t, 0) for i, t in enumerate(t for block in range(40) for t in [*range(block * 600, block * 600 + 100), *range(block * 600 + 110, (block + 1) * 600, 20)])]
    df = spark.createDataFrame(data, SCHEMA)
    seen = {}
    folded = admission._folded
    admission._folded = lambda rows, *a: seen.update(n=rows.where("_of is not null").select("_of").distinct().count()) or folded(rows, *a)
    try:
        out = admission.admit_jointly(df, ("source", "channel"), 30, ("source",), 40, order=("event_id",))
    finally:
        admission._folded = folded
    assert {r.event_id: r.rate_reason for r in out.collect()} == joint_model(data, 30, 40)
    assert seen["n"] == 40


@pytest.mark.parametrize("seed, quiet, slices", [(1, 60, 2), (2, 60, 3), (3, 25, 4), (4, 600, 64)])
def test_sent_alerts_are_an_orbit(spark, seed, quiet, slices):
    data = load(seed, 2500)
    rng = random.Random(seed)
    last, want = {}, {}
    for i, s, _, t, _ in sorted(data, key=lambda r: (r[3], r[0])):
        want[i] = s not in last or t >= last[s] + quiet
        if want[i]:
            last[s] = t
    rng.shuffle(data)
    df = spark.createDataFrame(data, SCHEMA)
    got = admission.suppress_alerts(df, ("source",), quiet, order=("event_id",), slices=slices)
    assert {r.event_id: r.sent for r in got.collect()} == want and got.columns == [*df.columns, "sent"]


def test_a_key_that_never_pauses_doubles_its_ways(spark):
    df = spark.range(20_000).select(F.col("id").cast("int").alias("event_id"), F.lit("a").alias("source"), F.col("id").alias("arrival_s"))
    got = admission.suppress_alerts(df, ("source",), 7, order=("event_id",), slices=4).where("sent").select("arrival_s").orderBy("arrival_s").collect()
    assert [r.arrival_s for r in got] == list(range(0, 20_000, 7))


def test_suppression_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(0, "a", "x", None, 0), (1, None, "x", 5, 0), (2, "a", "x", 5, 0)], SCHEMA)
    got = admission.suppress_alerts(df, ("source",), 60, order=("event_id",))
    assert [r.sent for r in got.orderBy("event_id").collect()] == [None, None, True]
    assert admission.suppress_alerts(df.limit(0), ("source",), 60, order=("event_id",)).count() == 0


def test_a_repeat_after_the_window_is_no_duplicate(spark):
    rows = [(0, "Twitter", "f", 0, 0), (1, "twitter", "f", 300, 0), (2, "twitter", "f", 301, 0), (3, "reddit", "f", 1000, 0), (4, "reddit", "f", 2800, 0), (5, "other", "f", 1, 0), (6, "twitter", None, 1, 0)]
    got = admission.flag_duplicates(spark.createDataFrame(rows, SCHEMA), "channel", order=("event_id",))
    assert [r.duplicate for r in got.orderBy("event_id").collect()] == [False, True, False, False, True, None, None]
