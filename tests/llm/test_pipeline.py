"""Stages of the pipeline against brute force, with repeated rows, shared ids and null ids."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from crowdsignal.llm import decontaminate, mixing, packing, toxicity

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def row(i, text):
    return (i, text, "en", "web", len(text or ""))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [[f"w{rng.randrange(900)}" for _ in range(n)] for n in (30, 30, 40, 60, 80, 80)]
    texts = [" ".join(b) for b in base]
    out = [row(10 + i, t) for i, t in enumerate(texts)]
    out += [row(10, texts[0])] * 40  # one row as a large share of all
    out += [row(30 + i, " ".join([*b[:-1], f"e{i}"])) for i, b in enumerate(base[2:])]  # near copies
    out += [row(11, "a different text under the id of a row that stays"), row(11, texts[5])]
    out += [row(None, texts[1])] * 3 + [row(None, "only null ids have this text here")] * 3
    out += [row(None, "another text of a null id is here")] + [row(50, ""), row(50, ""), row(51, ""), row(52, None), row(None, None), row(None, None)]
    rng.shuffle(out)
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    groups = []
    for r in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        s = shingles(r[1])
        near = [g for g in groups if s and any(100 * len(s & t) >= 80 * len(s | t) for _, t in g if t)]
        groups = [g for g in groups if g not in near] + [[(r, s)] + [x for g in near for x in g]]
    order = lambda r: (r[0] is None, r[0] or 0)
    return [min((r for r, _ in g), key=order) for g in groups]


def plain(rows):
    return sorted(map(tuple, rows), key=repr)


def test_near_dedup_keeps_one_row_of_each_group(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = STAGES["near_dedup"](spark, df, "")
    # of two rows with one id in one group either may stay; here no group has such
    assert got.columns == df.columns and plain(got.collect()) == plain(brute_kept(rows))


def test_near_dedup_of_an_empty_table(spark):
    assert STAGES["near_dedup"](spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_decontamination_drops_every_row_with_an_item(spark, rows, tmp_path):
    items = [(1, rows[0][1] or "x y z"), (2, "different text under the id of a row"), (3, "null ids have this text"), (4, None)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    low = lambda t: " ".join((t or "").lower().split())
    bad = lambda t: any(i and decontaminate.best_distance(low(i), low(t))[0] <= 0.2 * len(low(i)) for _, i in items)
    got = STAGES["decontamination"](spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path))
    assert plain(got.collect()) == plain(r for r in rows if not bad(r[1]))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A folder of small tables with planted toxic documents, copies and benchmark items."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    docs, labels = [], []
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(15))) for i in range(6)]
    for i in range(240):
        w, toxic = [word() for _ in range(rng.randrange(15, 60))], i % 4 == 0
        for _ in range(3 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit"]))
        if i % 10 == 3:
            w.insert(5, items[i % 6][1])
        docs.append((i, " ".join(w), "en", None if i % 11 == 0 else f"s{i % 3}"))
        labels.append((i, 1, int(toxic)))
    docs += [(500 + i, docs[i][1], "en", "s1") for i in range(1, 60, 3)] + [docs[1]] * 5 + [(None, "a text without an id", "en", "s2"), (700, "", "en", "s0"), (701, None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    rows_in = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows_in.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_the_whole_pipeline_against_its_parts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = [tuple(r) for r in docs.collect()]
    scorer = toxicity.learn(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = [r for r in found if scorer.score(r[1]) < 0.5]
    assert not any("blockhead" in (r[1] or "") or "nitwit" in (r[1] or "") for r in clean) and len(clean) > 150
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    low = lambda t: " ".join((t or "").lower().split())
    kept = [r for r in brute_kept(clean) if not any(decontaminate.best_distance(i, low(r[1]))[0] <= 0.2 * len(i) for i in items)]
    mixed = mixing.mixed_documents(spark.createDataFrame(kept, docs.schema)).collect()
    encoder = packing._encoder(packing.TOKENIZER).encoding
    want = collections.Counter((r.doc_id, tuple(encoder.encode_ordinary(r.text or ""))) for r in mixed)
    got = collections.Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        ids = np.frombuffer(r.input_ids, "<u2")
        assert set(r.parts) == {0}  # no text is longer than a row here
        for doc, a, b in zip(r.doc_ids, r.cu_seqlens, r.cu_seqlens[1:], strict=False):
            assert ids[b - 1] == packing.END_OF_DOCUMENT
            got[doc, tuple(ids[a : b - 1].tolist())] += 1
    assert got == want


def test_every_stage_but_the_last_keeps_the_columns_and_takes_an_empty_table(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "packing" or out.columns == none.columns)
