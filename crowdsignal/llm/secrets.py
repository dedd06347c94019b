"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, let, materialize, table

#: Fixed patterns, by kind in order, with the least length of the given group.
BASE = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)
#: A text without one of these, whatever the case, has no ``assign`` match.
KEYWORDS = ("password", "passwd", "secret", "token", "api")
#: What a Markov span may look like.
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: The classes of characters: letters whatever their case, any digit, any separator of names, "+" and "=".
CLASSES = "abcdefghijklmnopqrstuvwxyz0-+="
#: Documents whose strings train the models, at most about so many (chosen by a hash of the text).
SAMPLE_DOCS = 1_000
#: The log-likelihood ratio a character that a span must reach where none was learned.
LEAST_RATIO = 0.5
#: Ordinary identifiers of the held-out part that the learned threshold lets pass as random, and random ones it misses.
FALSE_ALARMS, MISSES = 0.005, 0.008
#: Counts that the single-character distribution is worth beside a character's own pairs, and the share of an ordinary
#: pair's probability that comes from vowels, consonants, digits and signs following each other: it holds for words of
#: languages that the corpus does not have.
BACK_OFF, BROAD = 4.0, 0.1
_KIND = [0] + [1 if c in "aeiouy" else 2 if c.isalpha() else 3 if c == "0" else 4 for c in CLASSES]
_SIZE = len(CLASSES) + 1
_SPAN = "array<struct<start: int, rank: int, end: int, kind: string>>"
#: Stands for a character of a base span; in a text itself it counts as a space.
_MARK = "\x01"


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost non-overlapping matches, in order: (gap before it, match, length of its ``group``); last the end's gap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    sized = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.zip_with(pairs, sized, lambda p, v: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), F.length(v).alias("size")))


def _places(matches: Column, kind: str, rank: int, least: int = 0) -> Column:
    """Spans, in code points, of the matches whose group has ``least`` characters.

    Places are running sums of gaps and matches. They are summed in blocks of the square root of their number, so that
    the arrays that grow by a span at a time stay short.
    """
    length = lambda block: F.aggregate(block, F.lit(0), lambda acc, m: acc + m["gap"] + m["len"])

    def blocked(sizes: Column) -> Column:
        per = F.ceil(F.sqrt(F.size(sizes).cast("double"))).cast("int")
        return F.transform(F.sequence(F.lit(1), F.size(sizes), per), lambda at: F.slice(sizes, at, per))

    def starts(blocks: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(blocks, start, lambda acc, b: F.struct((acc["at"] + length(b)).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + m["gap"]
        end = begin + m["len"]
        span = F.struct(begin.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(m["size"] >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    inside = lambda blocks: F.zip_with(blocks, starts(blocks), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), F.array().cast(_SPAN).alias("spans")), step, lambda acc: acc["spans"]))
    sizes = F.transform(matches, lambda m: F.struct(F.length(m["gap"]).alias("gap"), F.coalesce(F.length(m["match"]), F.lit(0)).alias("len"), m["size"].alias("size")))
    return F.flatten(let(let(sizes, blocked), inside))


def find_spans(text: Column, pattern: str, kind: str, rank: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points, whose ``group`` has ``least`` characters."""
    return F.when(F.rlike(text, F.lit(pattern)), _places(_matches(text, pattern, group), kind, rank, least)).otherwise(F.array().cast(_SPAN))


def _searched() -> list[tuple[str, str, int, int]]:
    """The fixed patterns; where a run that is too short can hide no longer one, with its least length in the pattern."""
    short = {"access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}"}
    return [(kind, short.get(kind, pattern), group, least) for kind, pattern, group, least in BASE]


def base_spans(text: Column) -> Column:
    """All spans of the fixed patterns, by start, then kind in the listed order."""
    spans = []
    for rank, (kind, pattern, group, least) in enumerate(_searched()):
        found = find_spans(text, pattern, kind, rank, group, least)
        if kind == "assign":  # a cheap test that no match can fail
            found = F.when(reduce(or_, [F.contains(F.lower(text), F.lit(w)) for w in KEYWORDS]), found).otherwise(F.array().cast(_SPAN))
        spans.append(found)
    return F.array_sort(F.concat(*spans))


def _hidden(text: Column, pattern: str, group: int, least: int) -> Column:
    """The text with a mark for each character of the matches whose group has ``least`` characters."""
    mark = lambda m: F.when(m["size"] >= least, F.repeat(F.lit(_MARK), F.length(m["match"]))).otherwise(F.coalesce(m["match"], F.lit("")))
    return let(text, lambda t: F.array_join(F.transform(_matches(t, pattern, group), lambda m: F.concat(m["gap"], mark(m))), ""))


def masked(text: Column) -> Column:
    """The text with a mark for each character of a base span, so that places stay the same."""
    out = F.translate(text, _MARK, " ")
    for _, pattern, group, least in _searched():
        out = _hidden(out, pattern, group, least)
    return out


def _codes(s: Column) -> Column:
    """The class of each character: its place in ``CLASSES``, 0 for any other."""
    folded = F.translate(F.lower(s), "123456789_/", "000000000--")
    return F.transform(F.split(folded, ""), lambda c: F.instr(F.lit(CLASSES), c))


def train_markov(samples: DataFrame) -> list[float]:
    """``samples(value, random boolean)`` -> the log-likelihood ratio of each character pair, row by row.

    Pairs of character classes are counted in both kinds of strings. In ordinary ones a pair's probability given its first
    class is drawn to that of the second alone, and mixed with that of vowels, consonants, digits and signs in a row; the random model is mixed with the uniform one in equal parts, as a corpus
    may hold random strings of one alphabet only. At most the square of the number of classes, 31 x 31, reaches the driver.
    """
    codes = _codes(F.col("value"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("codes") - 1), lambda i: F.element_at("codes", i) * _SIZE + F.element_at("codes", i + 1))
    coded = samples.where("length(value) >= 2").select("random", codes.alias("codes"))
    counts = coded.select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").count().collect()
    seen = {True: [0.0] * _SIZE**2, False: [0.0] * _SIZE**2}
    for r in counts:
        seen[r["random"]][r["pair"]] += r["count"]
    single = [sum(seen[False][b::_SIZE]) + 0.5 for b in range(_SIZE)]
    plain = [x / sum(single) for x in single]
    kinds = range(max(_KIND) + 1)
    of_kind = [sum(x for x, k in zip(single, _KIND, strict=True) if k == j) for j in kinds]
    members = [_KIND.count(j) for j in kinds]
    within = [(x + of_kind[k] / members[k]) / (2 * of_kind[k]) for x, k in zip(single, _KIND, strict=True)]
    next_kind = [[1.0 + sum(seen[False][a * _SIZE + b] for a in range(_SIZE) if _KIND[a] == i for b in range(_SIZE) if _KIND[b] == j) for j in kinds] for i in kinds]
    out = []
    for a in range(_SIZE):
        rand, own = (seen[k][a * _SIZE : (a + 1) * _SIZE] for k in (True, False))
        n_rand, n_own, follow = sum(rand), sum(own), next_kind[_KIND[a]]
        for b in range(_SIZE):
            p_rand = 0.5 * (rand[b] + 1) / (n_rand + _SIZE) + 0.5 / _SIZE
            broad = follow[_KIND[b]] / sum(follow) * within[b]
            p_own = (1 - BROAD) * (own[b] + BACK_OFF * plain[b]) / (n_own + BACK_OFF) + BROAD * broad
            out.append(math.log(p_rand / p_own))
    return out


def labelled_strings(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled samples from the corpus -> ``(value, random, held)``, each distinct string once.

    Drawn from about ``most`` documents by a hash of the text. Random: what the fixed patterns find, and digests of the
    texts written in four alphabets (base64, its letters and digits, its letters, hexadecimal). Ordinary: identifiers, two to
    four neighbouring words of a text joined by "_" or, as in camel case, by nothing, some with a number at the end; and the
    words themselves. ``held`` marks a fifth of the words, by hash: no identifier has words of both parts, so the held-out
    ones are made of words that training never saw.
    """
    text = F.col(text_col)
    share = min(1.0, most / max(1, docs.count()))
    sample = docs.select(text.alias("text")).where(F.pmod(F.xxhash64(text, F.lit("markov")), F.lit(1_000_000)) < int(share * 1_000_000))

    def values(pattern: str, group: int, least: int) -> Column:
        return F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda v: F.length(v) >= least)

    chance = lambda v, n: F.pmod(F.xxhash64(v), F.lit(n))
    digest = F.base64(F.unhex(F.sha2("text", 512)))
    alphabets = [digest, F.translate(digest, "+/=", ""), F.translate(digest, "+/=0123456789", ""), F.md5("text")]
    secret = F.concat(F.array(*(F.substring(x, F.lit(1), F.lit(16) + chance(x, 17).cast("int")) for x in alphabets)), *(values(p, g, n) for _, p, g, n in BASE))
    rest = F.regexp_replace(F.regexp_replace(F.col("text"), BASE[0][1], " "), r"AKIA[A-Z0-9]{14,}|[0-9a-f]{16,}", " ")
    words = F.filter(F.regexp_extract_all(rest, F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w).between(2, 14))

    def names(own: Column) -> Column:
        def name(at: Column) -> Column:
            few = F.slice(own, at, F.lit(2) + chance(F.element_at(own, at), 3).cast("int"))
            style = chance(F.concat(F.element_at(own, at), F.lit("style")), 4)
            tail = F.when(style == 3, chance(F.element_at(own, at), 100).cast("string")).otherwise("")
            return F.concat(F.when(style % 2 == 0, F.array_join(few, "_")).otherwise(F.array_join(few, "")), tail)

        return F.concat(own, F.when(F.size(own) > 3, F.transform(F.sequence(F.lit(1), F.size(own) - 3, F.lit(3)), name)).otherwise(F.array().cast("array<string>")))

    part = lambda held: let(F.filter(words, lambda w: (chance(w, 5) == 0) == held), names)
    marked = lambda vs, random, held: F.transform(vs, lambda v: F.struct(v.alias("value"), F.lit(random).alias("random"), (held(v) if callable(held) else F.lit(held)).alias("held")))
    every = F.concat(marked(secret, True, lambda v: chance(v, 5) == 0), marked(part(False), False, False), marked(part(True), False, True))
    return sample.select(F.explode(every).alias("s")).select("s.*").distinct()


def learn(docs: DataFrame, text_col: str = "text", most: int = SAMPLE_DOCS) -> tuple[list[float], float]:
    """The ratios of character pairs and the least ratio a character, from the strings of ``docs``.

    The ratios come from the part of the labelled strings that is not held out. The threshold is set on the held-out one,
    on strings long enough to be candidates: the ratio that all but ``MISSES`` of the random strings reach (without those
    that a fixed pattern finds), but none that more than ``FALSE_ALARMS`` of the identifiers reach.
    """
    samples = materialize(labelled_strings(docs, text_col, most), "strings")
    ratios = train_markov(samples.where("not held").select("value", "random"))
    judged = samples.where("held and length(value) >= 16 and not (random and value rlike '^[0-9a-f]+$')").select("random", mean_ratio(F.col("value"), ratios).alias("ratio"))
    quantile = lambda random, q: F.percentile_approx(F.when(F.col("random") == random, F.col("ratio")), q)
    ordinary, secret = judged.agg(quantile(False, 1 - FALSE_ALARMS), quantile(True, MISSES)).first()
    drop(samples)
    if ordinary is None or secret is None:
        return ratios, LEAST_RATIO
    return ratios, max(ordinary, secret)


def mean_ratio(value: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a string, random to ordinary, for each of its pairs of characters."""
    scores = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
    total = F.aggregate(_codes(value), start, lambda acc, c: F.struct(c.alias("last"), (acc["sum"] + F.when(acc["last"] < 0, 0.0).otherwise(F.element_at(scores, acc["last"] * _SIZE + c + 1))).alias("sum")), lambda acc: acc["sum"])
    return total / F.greatest(F.length(value) - 1, F.lit(1))


def markov_spans(marked: Column, ratios: list[float], least: float = LEAST_RATIO) -> Column:
    """Candidates of a masked text that touch no base span and whose mean ratio is ``least`` or more."""
    pattern = CANDIDATE.replace("[", f"[{_MARK}", 1)
    judged = F.transform(_matches(marked, pattern), lambda m: F.struct(m["gap"].alias("gap"), m["match"].alias("match"), F.when(~F.contains(m["match"], F.lit(_MARK)) & (mean_ratio(m["match"], ratios) >= least), 1).otherwise(0).alias("size")))
    return F.when(F.rlike(marked, F.lit(pattern)), _places(judged, "markov", len(BASE), 1)).otherwise(F.array().cast(_SPAN))


def scan_secrets(docs: DataFrame, ratios: list[float], text_col: str = "text", keep: list[str] | None = None, least: float = LEAST_RATIO) -> DataFrame:
    """``docs`` with ``base_spans`` and ``markov_spans``: arrays of (start, rank, end, kind) in code points.

    Built-in functions only, one pass, no shuffle; work grows with a text's length, also in runs of a million characters
    or matches. Cases: null and empty texts have no spans; repeated rows have theirs each; kept columns of these names are
    replaced; an empty table gives no rows.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("base_spans", "markov_spans")]
    row = F.struct(*[F.col(c) for c in names]).alias("row")
    first = docs.select(row, F.coalesce(F.col(text_col), F.lit("")).alias("scanned"))
    first = first.withColumn("base_spans", base_spans(F.col("scanned")))
    plain = F.translate("scanned", _MARK, " ")
    marked = F.when((F.size("base_spans") > 0) & F.rlike("scanned", F.lit(CANDIDATE)), masked(F.col("scanned"))).otherwise(plain)
    both = first.withColumn("marked", marked).select("row", "base_spans", markov_spans(F.col("marked"), ratios, least).alias("markov_spans"))
    return both.select("row.*", "base_spans", "markov_spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios, least = learn(docs)
    found = scan_secrets(docs, ratios, keep=["doc_id"], least=least)

    def count(kind: str) -> Column:
        return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind, *_ in BASE]
    every = F.array_sort(F.concat("base_spans", "markov_spans"))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"), joined(every).alias("spans"))
