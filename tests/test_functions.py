"""Boundary rows of the column operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crowdsignal.functions import columns as C
from crowdsignal.operators import ordered, scoring, tables, validation


def one(spark, expr, **row):
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'bigint'}" for k, v in row.items())) if row else spark.range(1)
    return df.select(expr.alias("x")).first().x


def test_clean_text_drops_urls_and_emoji_without_a_gap(spark):
    assert one(spark, C.clean_text(F.col("t")), t="To the MOON🚀now https://x.y/z ok") == "to the moonnow  ok"


def test_lexicon_counts_overlap(spark):
    r = scoring.sentiment(spark.createDataFrame([("dump",), ("100x",), ("buy wall and whale buying!!",), (None,), ("",)], "text string")).orderBy(F.desc("matches"), "text").collect()
    by = {x.text: x for x in r}
    assert by["dump"].bearish_count == 2 and by["dump"].label == -1  # word and rule both count
    assert by["100x"].greed_count == 2
    assert by["buy wall and whale buying!!"].bullish_count == 2
    assert by[None].score == 0.0 and by[""].label == 0


def test_token_profile_needs_whole_tokens(spark):
    r = scoring.sentiment(spark.createDataFrame([("bullish!",), ("bullish moon",), ("",)], "text string"), "tokens").collect()
    assert [x.label for x in r] == [0, 1, 0]
    assert [x.confidence for x in r] == [0.5, 0.7, 0.0]


@pytest.mark.parametrize(("velocity", "anomaly", "expected"), [(3.0, True, True), (2.9, True, False), (3.0, False, False)])
def test_overheat_boundary(spark, velocity, anomaly, expected):
    df = spark.createDataFrame([(0, 1.0, velocity, anomaly, None)], "label int, confidence double, velocity double, anomaly boolean, fear_greed_index double")
    assert scoring.risk_indicators(df).first().social_overheat is expected


def test_zone_edges(spark):
    got = [r.z for r in spark.createDataFrame([(None,), (20.0,), (20.1,), (80.0,)], "i double").select(scoring.zone(F.col("i")).alias("z")).collect()]
    assert got == ["unknown", "extreme_fear", "normal", "extreme_greed"]


def test_times(spark):
    rows = ["2024-05-01T10:00:00Z", "2024-05-01T12:00:00+02:00", "2024-05-01 10:00:00", "1714557600", "Wed May 01 10:00:00 +0000 2024", "nonsense", None]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = df.select(C.parse_ts(F.col("t")).alias("p"), C.parse_ts_strict(F.col("t")).alias("s")).collect()
    assert [g.p for g in got] == [datetime(2024, 5, 1, 10)] * 5 + [None, None]
    assert [g.s is not None for g in got] == [True, True, False, False, False, False, False]


def test_isoformat_shows_microseconds_only_where_there_are_any(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 0, 0, 1),), (datetime(2024, 1, 1, 0, 0, 1, 5),)], "t timestamp")
    assert [r.x for r in df.select(C.isoformat(F.col("t")).alias("x")).collect()] == ["2024-01-01T00:00:01+00:00", "2024-01-01T00:00:01.000005+00:00"]


def test_linear_engagement(spark):
    assert one(spark, C.engagement_linear(F.lit("twitter"), likes=F.lit(100), reposts=F.lit(50), replies=F.lit(20))) == 230.0
    assert one(spark, C.author_linear(F.lit("twitter"), F.lit(20_000), F.lit(True))) == 3.0


def test_assets_by_priority(spark):
    df = tables.detect_assets(spark.createDataFrame([("Ether beats satoshi",), ("absolutely",), ("nothing",), (None,)], "text string"))
    assert [(r.assets, r.asset_found) for r in df.collect()] == [(["BTC", "ETH"], "BTC"), (["SOL"], "SOL"), ([], "BTC"), ([], "BTC")]


def test_first_failing_rule_wins_and_null_conditions_pass(spark):
    df = spark.createDataFrame([(None, 1), ("a", None), ("a", 0), ("a", 2)], "t string, n int")
    got = df.select(validation.first_reason((F.col("t").isNull(), "no_text"), (F.col("n") < 1, "low")).alias("r")).collect()
    assert [g.r for g in got] == ["no_text", None, "low", None]


def test_upsert_keeps_untouched_columns_and_deletes(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, p string, q string")
    changes = spark.createDataFrame([(1, "n", None, 1, False), (1, None, "m", 2, False), (3, "new", None, 3, False), (2, None, None, 4, True)], "k int, p string, q string, seq int, gone boolean")
    got = {r.k: (r.p, r.q) for r in tables.upsert_latest(base, changes, "k", ["p", "q"], delete="gone").collect()}
    assert got == {1: ("n", "m"), 3: ("new", None)}


def test_append_unique(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([("f", 1), ("f", 2), (None, 3), (None, 4)], "fingerprint string, n int")
    assert tables.append_unique(a, path, "fingerprint", ("n",)).count() == 3
    tables.append_unique(spark.createDataFrame([("f", 5), ("g", 6), (None, 7)], "fingerprint string, n int"), path, "fingerprint", ("n",))
    assert sorted((r.fingerprint or "", r.n) for r in spark.read.parquet(path).collect()) == [("", 3), ("", 4), ("", 7), ("f", 1), ("g", 6)]


def test_dedupe_first_keeps_null_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), (None, 4)], "k string, n int")
    assert sorted(r.n for r in ordered.dedupe_first(df, ("k",), ("n",)).collect()) == [1, 3, 4]
