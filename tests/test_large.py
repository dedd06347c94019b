"""Deep threads, large catalogs, bucketed snapshots and injected classifiers."""

import json
import random

import pytest
from pyspark.sql import functions as F

from crowdsignal.operators import scoring, tables
from crowdsignal.sources import records


def chain(depth):
    open_, close = '[{"kind":"t1","data":{"author":"a","body":"b","replies":', "}}]"
    return open_ * depth + '""' + close * depth


def test_a_thread_of_any_depth_is_flattened(spark):
    df = spark.createDataFrame([(1, chain(100_000)), (2, chain(3))], "id int, thread string")
    out = records.flatten_thread(df, "thread", "id")
    deep = out.where("id = 1").agg(F.count("*"), F.max("depth"), F.count_if(F.col("parent") == F.col("place") - 1), F.count_if("parsed")).first()
    assert tuple(deep) == (100_000, 100_000, 99_999, 100_000)
    assert [(r.depth, r.path, r.place, r.parent) for r in out.where("id = 2").orderBy("place").collect()] == [(1, [0], 0, None), (2, [0, 0], 1, 0), (3, [0, 0, 0], 2, 1)]


def test_the_stack_parser_reads_what_json_reads():
    rng = random.Random(4)

    def value(depth):
        kind = rng.randrange(7 if depth < 4 else 5)
        return [None, True, rng.randrange(-9, 9) / 2, 'x "\\ \n é', "", [value(depth + 1) for _ in range(rng.randrange(4))] if kind == 5 else None, {f"k{i}": value(depth + 1) for i in range(rng.randrange(4))} if kind == 6 else None][kind]

    for _ in range(300):
        v = value(0)
        text = json.dumps(v, indent=rng.choice([None, 2]))
        assert records.parse_json_deep(text) == v
    for bad in ("", "[", "[1,]", "{", '{"a"}', '{"a":1,}', "[1 2]", "1 2", "[}", '{1:2}', "nope", '["a]', "[,1]", "{,}", '{"a":}', "]"):
        with pytest.raises(ValueError):
            records.parse_json_deep(bad)


def test_what_does_not_parse_is_reported(spark):
    df = spark.createDataFrame([(1, "[not json"), (2, None), (3, chain(1))], "id int, thread string")
    out = records.flatten_thread(df, "thread", "id", report=True)
    assert {(r.id, r.place, r.parsed) for r in out.collect()} == {(1, None, False), (3, 0, True)}


@pytest.mark.parametrize("block", [100_000, 40])
def test_a_large_catalog_finds_what_tests_of_each_keyword_find(spark, block):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    assets = [(f"S{i}", f"n{i}", [word().upper() if rng.random() < 0.3 else word() for _ in range(3)] + [""], rng.randrange(4), i % 11 != 0) for i in range(300)]
    catalog = spark.createDataFrame(assets, "symbol string, name string, keywords array<string>, priority int, is_active boolean")
    texts = [None, "", "zzz"] + [" ".join(rng.choice([word(), "xyz"]) for _ in range(rng.randrange(1, 6))).upper() for _ in range(60)]
    df = spark.createDataFrame([(i, t, "y") for i, t in enumerate(texts)], "id int, text string, assets string")
    got = {r.id: r for r in tables.detect_assets(df, catalog=catalog, block=block).collect()}
    listed = sorted((a for a in assets if a[4]), key=lambda a: (-a[3], a[0]))
    for i, t in enumerate(texts):
        want = [a[0] for a in listed if any(k and k.lower() in (t or "").lower() for k in a[2])]
        assert (got[i].assets, got[i].asset_found) == (want, want[0] if want else "BTC")
    some = tables.detect_assets(df, catalog=catalog, tests=1000).collect()
    assert {r.id: r.assets for r in some} == {i: r.assets for i, r in got.items()}


def test_only_changed_buckets_are_written(spark, tmp_path):
    path = str(tmp_path / "snapshot")
    tables.write_snapshot(spark.range(100).select("id", F.lit("old").alias("s")), path, "id", 8)
    files = lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "snapshot").rglob("*.parquet")}
    before = files()
    changes = spark.createDataFrame([(5, "new", 1, False), (5, None, 2, False), (1000, "added", 1, False)], "id long, s string, seq int, gone boolean")
    tables.merge_snapshot(spark, path, changes, "id", ["s"], 8, delete_flag="gone")
    got = {r.id: r.s for r in tables.read_snapshot(spark, path).collect()}
    assert got == {**{i: "old" for i in range(100)}, 5: "new", 1000: "added"}
    assert 5 <= len(before.keys() & files().keys()) < 8
    everyone = spark.range(0, 2000).select("id", F.lit(None).cast("string").alias("s"), F.lit(9).alias("seq"), F.lit(True).alias("gone"))
    tables.merge_snapshot(spark, path, everyone.where("id <> 7"), "id", ["s"], 8, delete_flag="gone")
    assert [r.id for r in spark.read.parquet(path).collect()] == [7]


def test_a_classifier_sees_texts_without_a_match_only(spark):
    def load():
        def judge(texts):
            assert len(texts) <= 3 and all("moon" not in t for t in texts)
            return [(1, 2.0) if t == "up" else (-1, None) if t == "down" else (5, 0.3) if t else (0, -1.0) for t in texts]

        return judge

    rows = [("to the moon", 1, 1, 0.7), ("up", 0, 0, 0.0), ("down", 0, 0, 0.0), ("odd", 0, 0, 0.0), (None, 0, 0, 0.0)] * 3
    df = spark.createDataFrame(rows, "text string, matches int, label int, confidence double").coalesce(1)
    got = {r.text: (r.model_used, r.final_label, r.final_confidence) for r in scoring.classify_unmatched(df, load, rows=3).collect()}
    assert got == {"to the moon": (False, 1, 0.7), "up": (True, 1, 1.0), "down": (True, -1, 0.5), "odd": (False, 0, 0.0), None: (True, 0, 0.0)}
    assert scoring.classify_unmatched(df.limit(0), load).count() == 0


def test_every_row_meets_one_range(spark):
    for low, high, parts in ((0, 100, 7), (5, 5, 3), (0, 2, 8), (-10, 10, 1)):
        cuts = records.range_predicates("id", low, high, parts)
        df = spark.range(-20, 120).select(F.when(F.col("id") != 3, F.col("id")).alias("id"))
        met = sum((F.coalesce(F.expr(c), F.lit(False)).cast("int") for c in cuts), F.lit(0))
        assert {r.n for r in df.select(met.alias("n")).collect()} == {1}
