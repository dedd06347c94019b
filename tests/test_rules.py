"""Rules and helpers that the registered queries reach only in part."""

import json
import random

import pytest
from pyspark.sql import functions as F

from crowdsignal.operators import ordered, scoring, tables, validation
from crowdsignal.sources import records


def test_a_source_that_fails_while_it_is_read_is_left_out(spark, tmp_path):
    good = spark.range(5).select(F.col("id"), F.lit("a").alias("source"))
    bad = spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("away")).cast("bigint")).alias("id"), F.lit("b").alias("source"))
    for stage in (None, str(tmp_path / "stage")):
        df, status = records.union_sources(spark, {"a": lambda: good, "b": lambda: bad}, stage)
        assert df.count() == 5
        assert {r.source: r.ok for r in status.collect()} == {"a": True, "b": False}


def test_threads_that_do_not_parse_have_no_rows(spark):
    tree = json.dumps([{"kind": "t1", "data": {"author": "a", "body": "x", "replies": json.dumps([{"kind": "t1", "data": {"author": None, "body": "y", "replies": ""}}, {"kind": "more", "data": {}}])}}, {"kind": "t1", "data": {"author": "b", "body": "z", "replies": {}}}])
    df = spark.createDataFrame([(1, tree), (2, "[not json"), (3, None), (4, "")], "id bigint, thread string")
    got = [(r.id, r.depth, r.path, r.author, r.body) for r in records.flatten_thread(df, "thread", "id").collect()]
    assert got == [(1, 1, [0], "a", "x"), (1, 2, [0, 0], None, "y"), (1, 1, [1], "b", "z")]
    assert records.flatten_thread(df, "thread", "id", limit=2).count() == 2


def test_pages_harvest_the_first_tier_that_finds_something(spark):
    state = 'x window.__INITIAL_STATE__ = {"timeline":{"entries":[]}}; "text":"a bare text of some length"'
    single = '{"id_str":"7","text":"hi","favorite_count":1,"retweet_count":2} "text":"a bare text of some length"'
    df = spark.createDataFrame([(1, state), (2, single), (3, '"text":"a bare text of some length" ' * 60), (4, "<p>"), (5, None), (6, "window.__INITIAL_STATE__ = {broken};" + single)], "id bigint, html string")
    got = {r.id: (r.tier, None if r.records is None else len(r.records)) for r in records.harvest_records(df).collect()}
    assert got == {1: ("state", 0), 2: ("records", 1), 3: ("texts", 50), 4: (None, None), 5: (None, None), 6: ("records", 1)}


def test_names_resolve_by_id_then_by_part(spark):
    reg = spark.createDataFrame([("CH1", "Whale One"), ("CH2", "One more"), ("X", None)], "source_id string, source_name string")
    df = spark.createDataFrame([("ch2",), ("WHALE",), ("on",), ("o",), ("zzz",), (None,), ("e o",)], "wanted string")
    got = {r.wanted: r.resolved for r in tables.resolve_channel(df, reg).collect()}
    assert got == {"ch2": "CH2", "WHALE": "CH1", "on": "CH1", "o": "CH1", "zzz": None, None: None, "e o": "CH1"}


def test_windows_in_slices_match_plain_windows(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(-4000, 9000, 7)]), rng.choice("xyz")) for i in range(800)]
    df = spark.createDataFrame(rows, "event_id bigint, source string, event_s bigint, channel string").withColumns({"replay": F.lit(0), "text": F.element_at(F.array(F.lit("same words"), F.lit("other words")), (F.col("event_id") % 2 + 1).cast("int"))})
    got = {r.event_id: r.recent for r in ordered.recent_count(df.where("event_s is not null"), ("source",), 600).collect()}
    timed = [r for r in rows if r[2] is not None]
    assert got == {i: sum(s2 == s and t - 600 <= t2 <= t and (t2, i2) <= (t, i) for i2, s2, t2, _ in timed) for i, s, t, _ in timed}
    flags = {r.event_id: r.coordinated for r in ordered.flag_coordinated(df, 3, 60).collect()}
    assert len(flags) == len(rows)
    for i, _, t, _ in rows:
        want = t is not None and len({c for i2, _, t2, c in timed if i2 % 2 == i % 2 and t - 60 < t2 <= t}) >= 3
        assert flags[i] == want
    repeats = {r.event_id: r.repeated for r in ordered.flag_repeats(df.where("event_s is not null")).collect()}
    assert repeats == {i: sum(c2 == c and i2 % 2 == i % 2 and (t2, i2) <= (t, i) for i2, _, t2, c2 in timed) >= 3 for i, _, t, c in timed}


def test_guard_keeps_a_running_maximum_over_slices_and_any_case(spark):
    rng = random.Random(6)
    rows, now = [], 0
    for i in range(600):
        now += rng.randrange(0, 30)
        rows.append((i, rng.choice(["Twitter", "twitter", "REDDIT", "forum", None]), rng.choice(["BTC", None]), now, now - rng.randrange(-3, 70), 0, f"f{rng.randrange(400)}"))
    df = spark.createDataFrame(rows, "event_id bigint, source string, asset string, arrival_s bigint, event_s bigint, replay int, fingerprint string")
    got = {r.event_id: r.guard_reason for r in ordered.time_guard(df, slice_s=100).collect()}
    delay, tolerance, seen, known = {"twitter": 15, "reddit": 120}, {"twitter": 5, "reddit": 60}, {}, set()
    for i, source, asset, arrival, event, _, fp in rows:
        s = (source or "").lower()
        if s not in delay:
            assert got[i] == "unknown_source"
        elif arrival < event or arrival - event > delay[s]:
            assert got[i] == ("future" if arrival < event else "late")
        else:
            top = seen.get((s, asset), event)
            seen[s, asset] = max(top, event)
            if event < top - tolerance[s]:
                assert got[i] == "out_of_order"
            else:
                assert got[i] == ("duplicate" if fp in known else None)
                known.add(fp)


def test_enrich_leaves_what_came_in(spark):
    df = spark.createDataFrame([(2, "Moon", 0.5), (1, None, None)], "id bigint, text string, score double")
    out = scoring.enrich(df)
    assert out.columns[:3] == df.columns and {"label", "panic_risk"} <= set(out.columns)
    assert sorted(map(tuple, out.select(df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_catalog_bound_and_comment_rules(spark):
    catalog = spark.range(20).select(F.concat(F.lit("S"), "id").alias("symbol"), F.lit("n").alias("name"), F.array(F.concat(F.lit("key"), "id")).alias("keywords"), F.lit(True).alias("is_active"), F.lit(1).alias("priority"))
    df = spark.createDataFrame([("about key7 and KEY3",), (None,)], "text string")
    assert [(r.assets, r.asset_found) for r in tables.detect_assets(df, catalog=catalog).collect()] == [(["S3", "S7"], "S3"), ([], "BTC")]
    with pytest.raises(ValueError, match="more than 10"):
        tables.active_assets(catalog, bound=10)
    comments = spark.createDataFrame([("x", "bitcoin up"), (None, "bitcoin"), ("x", "[removed]"), ("x", None), ("x", "rain")], "author string, text string")
    assert [r.drop_reason for r in validation.validate_comment(comments).collect()] == [None, "author_deleted", "text_removed", "missing_text", "no_asset"]
