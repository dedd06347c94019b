"""License templates, tokenizer alignment and the Merkle manifest against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from crowdsignal.llm import alignment, licenses, merkle

# ---- 11 ------------------------------------------------------------------------------------------------------------

MIT = """Copyright (c) 2019 Ann Other and others

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software.
"""


def labels(text):
    every = tuple((label, phrase) for phrase, label in licenses.PHRASES) + licenses.TEMPLATES
    return licenses.find_licenses(text, every, len(licenses.PHRASES))


def test_mandatory_wording_matches_exactly_and_regions_are_free():
    n, found, score = labels(f"before it {MIT} after it")
    assert [(m[0], m[3]) for m in found] == [("mit", False)] and n == len(re.findall(r"[0-9a-z]+", f"before it {MIT} after it".lower()))
    assert found[0][1] == 2 and 0.9 < score < 1
    assert [m[1] for m in labels("x " + MIT.replace("Copyright (c) 2019 Ann Other and others", ""))[1]] == [1]
    assert labels(MIT.replace("free of charge", "free of any charge"))[1] == []
    assert labels(MIT.replace('"Software"', "one two three four"))[1] == []
    assert [m[0] for m in labels("Licensed under the terms of the Apache License 2")[1]] == ["apache-2"]
    assert [m[0] for m in labels("licensed under the GNU General Public License, version 3")[1]] == ["gpl-3"]
    assert labels("") == (0, [], 0.0) == labels(None)


def test_automaton_agrees_with_regular_expressions(spark):
    rng = random.Random(3)
    for _ in range(60):
        def tree(depth):
            out = []
            for _ in range(rng.randrange(1, 4)):
                kind = rng.random()
                out.append(f"[[{tree(depth + 1)}]]" if kind < 0.25 and depth < 2 else f"<<{(low := rng.randrange(0, 2))},{low + rng.randrange(0, 3)}>>" if kind < 0.4 else rng.choice("abc"))
            return " ".join(out)

        markup = rng.choice("abc") + " " + tree(0)
        auto = licenses.TokenAutomaton([("x", markup)])
        shape = re.compile(licenses._pattern(licenses.parse(markup)))
        for _ in range(20):
            words = [rng.choice("abcd").encode() for _ in range(rng.randrange(0, 12))]
            want = {}
            for i in range(len(words)):
                for j in range(i + 1, len(words) + 1):
                    if shape.fullmatch("".join(f"{w.decode()} " for w in words[i:j])):
                        want.setdefault(j, i)
            assert {end: start for _, start, end in auto.scan(words)} == want, (markup, words)


def test_templates_must_begin_with_a_word():
    for bad in ("<<1,2>> a", "[[a]]", "[[a", "a ]]", "[[<<1,2>>]] a"):
        with pytest.raises(ValueError):
            licenses.TokenAutomaton([("x", bad)])


def test_license_columns_and_edges(spark):
    rows = [(1, "Under the MIT license; UNDER THE MIT LICENSE", "x"), (2, None, "x"), (3, "", "x"), (4, "cc-by-nc under the mít license", "x"), (4, "cc-by-nc under the mít license", "x"), (None, "apache license version 2", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, matches string")
    out = licenses.scan_licenses(docs)
    assert out.columns == ["doc_id", "text", "n_words", "matches", "license_score"]
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert [m.first_word for m in got[1, rows[0][1]].matches] == [0, 4] and got[1, rows[0][1]].n_words == 8
    assert got[2, None].n_words == 0 and got[2, None].matches == [] and got[3, ""].license_score == 0
    assert [m.label for m in got[4, rows[3][1]].matches] == ["cc-by-nc"]
    assert out.count() == 6 and licenses.scan_licenses(docs.limit(0)).count() == 0
    long = "under the " * 200_000 + "mit license"
    assert licenses.find_licenses(long, (("mit", "under the mit license"),), 1)[1] == [("mit", 399_998, 400_002, True)]


# ---- 12 ------------------------------------------------------------------------------------------------------------

BITS = ["foo", "bar  baz", "<|endoftext|>", "<s>", "é", "日本語", "\n\n", "\t x", "123456", "a" * 60, "don't", "　", "\x1c", "▁", "  ", " z", "😀", "\r\n", "://", "end.", " "]


@pytest.fixture(scope="module")
def pair():
    return alignment.TokenizerPair()


@pytest.fixture(scope="module")
def plain_model(pair):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(alignment.TOKENIZER_A)
    own.encode_special_tokens = True

    def groups(text):
        """The groups of a text by both libraries on the whole text; None where the bytes differ."""
        if not text:
            return None
        a, b = own.encode(f" {text}", add_special_tokens=False).ids, pair.b.encode(text)
        if not b"".join(pair.bytes_a[i] for i in a) == f" {text}".encode() == b"".join(pair.bytes_b[i] for i in b):
            return None
        at_a, at_b = ({e: k for k, e in enumerate(np.cumsum(size[ids]).tolist())} for size, ids in ((pair.size_a, a), (pair.size_b, b)))
        out, i, j = [], 0, 0
        for e in sorted(at_a.keys() & at_b.keys()):
            out.append((a[i : at_a[e] + 1], b[j : at_b[e] + 1]))
            i, j = at_a[e] + 1, at_b[e] + 1
        return out

    return groups


def shown(groups):
    return ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)


def some_texts(n):
    rng = random.Random(n)
    out = [None, "", " ", "a", "\n", " x"]
    for _ in range(n):
        few = rng.sample(BITS, 4)
        out.append("".join(rng.choice(few) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(1, 60))))
    return out


@pytest.mark.parametrize("lane, wide", [(1024, 4096), (3, 2)])
def test_lockstep_groups_and_links_match_whole_texts(pair, plain_model, monkeypatch, lane, wide):
    monkeypatch.setattr(alignment.lockstep, "__defaults__", (lane,))
    monkeypatch.setattr(alignment, "_WIDE", wide)
    texts = some_texts(600)
    aligned = 0
    for text, got in zip(texts, alignment.align_texts(texts, pair), strict=True):
        groups = plain_model(text)
        if groups is None:
            assert got[:5] == (0, 0, 0, 0, "") and not len(got[5])
            continue
        aligned += 1
        links = collections.Counter(x << 16 | y for g, h in groups for x in g for y in h)
        assert got[:5] == (sum(len(g) for g, _ in groups), sum(len(h) for _, h in groups), len(groups), sum(links.values()), shown(groups))
        assert dict(zip(got[5].tolist(), got[6].tolist(), strict=True)) == dict(links)
    assert aligned > 300


def test_a_batch_aligns_repeated_pieces_once(pair, plain_model, monkeypatch):
    walked, lockstep = [], alignment.lockstep
    monkeypatch.setattr(alignment, "lockstep", lambda ends_a, *rest: walked.append(len(ends_a)) or lockstep(ends_a, *rest))
    texts = [" ".join(random.Random(i).choices(["alpha", "don't", "x=1;", "αβγ", "end.\nNo"], k=200)) for i in range(40)]
    for text, got in zip(texts, alignment.align_texts(texts, pair), strict=True):
        assert got[4] == shown(plain_model(text))
    assert 0 < sum(walked) < 40


@pytest.mark.parametrize("run", [1, 3, 128])
def test_pieces_remembered_over_batches_give_the_same_rows(pair, plain_model, monkeypatch, run):
    monkeypatch.setattr(alignment, "_REMEMBERED", 60)
    monkeypatch.setattr(alignment, "_RUN", run)
    rng, known = random.Random(run), alignment.Alignments(pair)
    often = ["the", "of", "a▁b", "naïve", "end."]
    texts = some_texts(100) + [" ".join(rng.choice(often) if rng.random() < 0.8 else f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(100)]
    texts += ["o" * 300 + " the", "  the", "the of ", "a  b the", "the\x1cof of", "\n the"]
    for start in range(0, len(texts), 7):
        batch = texts[start : start + 7]
        for text, got, fresh in zip(batch, alignment.align_texts(batch, pair, known), alignment.align_texts(batch, pair), strict=True):
            groups = plain_model(text)
            links = collections.Counter(x << 16 | y for g, h in groups or [] for x in g for y in h)
            assert got[:5] == fresh[:5] == (sum(len(g) for g, _ in groups or []), sum(len(h) for _, h in groups or []), len(groups or []), sum(links.values()), shown(groups or []))
            assert dict(zip(got[5].tolist(), got[6].tolist(), strict=True)) == dict(links) and (np.diff(got[5]) > 0).all()
        assert not any(map(alignment._alone, known.place)) and len(known.place) == len(known.shown) == len(known.numbers) == len(known.first) - 1
        if start > 150:
            assert {"the", "of", "naïve", "end."} <= known.place.keys() and len(known.place) < 200


def test_texts_are_cut_alike_by_both_ways():
    rng = random.Random(7)
    for _ in range(5000):
        text = "".join(rng.choices([" ", "a", "b", "\n", "\t", "\x1c", "\u3000", "\u00a0"], [6, 5, 5, 1, 1, 1, 1, 1], k=rng.randrange(1, 12)))
        assert alignment._pieces(text) == alignment._SPLIT.split(text)


def test_alignment_query_against_brute_force(spark, plain_model, tmp_path):
    texts = some_texts(150)
    texts += texts[:20]
    spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id bigint, text string, groups string, block string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in alignment.op12_tokenizer_alignment(spark, str(tmp_path)).collect()}
    groups = [plain_model(t) for t in texts]
    links = [collections.Counter((x, y) for g, h in one or [] for x in g for y in h) for one in groups]
    held = collections.Counter(k for c in links for k in c)
    most = collections.Counter()
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    assert len(got) == len(texts)
    for i, (one, c) in enumerate(zip(groups, links, strict=True)):
        best, total = sum(n for k, n in c.items() if held[k] == most[k[0]]), sum(n * held[k] for k, n in c.items())
        digest = hashlib.sha256(shown(one).encode()).hexdigest() if one else ""
        assert (got[i].n_groups, got[i].n_links, got[i].n_best, got[i].count_sum, got[i].groups_sha256) == (len(one or []), sum(c.values()), best, total, digest)


def test_alignment_of_an_empty_table_and_of_a_long_text(spark, pair, plain_model, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert alignment.op12_tokenizer_alignment(spark, str(tmp_path)).count() == 0
    long = " ".join(random.Random(1).choice(["alpha", "Beta", "x=1;", "αβγ"]) for _ in range(60_000)) + "z" * 5000
    assert alignment.align_texts([long, "short one"], pair)[0][4] == shown(plain_model(long))


# ---- 13 ------------------------------------------------------------------------------------------------------------


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves, arity):
    """The root, and each leaf's way: its place in the run and the run, by level."""
    ways, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for w, k in zip(ways, range(len(at)), strict=True):
            w.append((at[k] % arity, runs[at[k] // arity]))
        at = [k // arity for k in at]
        level = [sha("".join(r)) for r in runs]
    return level[0], ways


def plain_manifest(rows, arity):
    """(doc_id, leaf, subroot, root, proof) of each row."""
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    roots, ways = [], []
    for lang in langs:
        own = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        root, way = plain_tree([leaf_of(r) for r in own], arity)
        roots.append(root)
        ways.append([(r[0], leaf_of(r), w) for r, w in zip(own, way, strict=True)])
    root, tops = plain_tree(roots, arity)
    return [(i, leaf, roots[k], root, "".join(x for slot, run in [*w, *tops[k]] for j, x in enumerate(run) if j != slot)) for k, own in enumerate(ways) for i, leaf, w in own]


def some_rows(n, rng):
    langs = [None, "", "a", "b", "é", "B"] if n > 10 else ["a"]
    rows = [(rng.randrange(3 * n) if rng.random() < 0.95 else None, rng.choice([None, "s"]), langs[min(len(langs) - 1, int(rng.expovariate(0.8)))], rng.choice([None, 7]), rng.choice([None, "", "Text", f"long é {rng.random()}"])) for _ in range(n)]
    return rows + rows[: n // 5]


@pytest.mark.parametrize("n, arity", [(1, 8), (2, 8), (9, 8), (700, 8), (150, 2), (150, 3)])
def test_manifest_matches_plain_trees(spark, monkeypatch, n, arity):
    monkeypatch.setattr(merkle, "_ROWS_A_PART", 40)
    rows = some_rows(n, random.Random(n + arity))
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id bigint, source string, lang string, n_chars bigint, text string, idx string, tree string").repartition(3)
    out = merkle.manifest(docs, arity=arity)
    back = merkle.fold(F.col("leaf"), F.col("path")).alias("back")
    got = [tuple(r) for r in out.select("doc_id", "leaf", "subroot", "root", F.array_join(merkle.proof(F.col("path")), "").alias("proof"), back).collect()]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((r[:5] for r in got), key=key) == sorted(plain_manifest(rows, arity), key=key)
    assert all(r[5] == r[3] for r in got)


def test_manifest_query_finds_tampering_and_takes_an_empty_table(spark, tmp_path):
    import zlib

    rows = [(i, "s", "en", 4, "Text" if i % 2 else "text") for i in range(100)] + [(200, "s", "fr", None, None)]
    schema = "doc_id bigint, source string, lang string, n_chars bigint, text string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    got = merkle.op13_merkle_manifest(spark, f"{tmp_path}/a").collect()
    assert len(got) == 101 and len({r.root for r in got}) == 1 and len({r.subroot for r in got}) == 2
    for r in got:
        assert r.verified == (not (zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.doc_id % 2 == 1)) == (r.folded_root == r.root)
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert merkle.op13_merkle_manifest(spark, f"{tmp_path}/b").count() == 0
