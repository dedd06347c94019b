"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and scores by context."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, small, table
from .texts import add_columns

#: Labelled rows that the lexicon and the weights are learned from, at most about so many (chosen by a hash of the id).
LABELLED = 12_000
#: Terms of at least so many letters may be one edit away, two edits away.
FUZZY_FROM = (4, 8)
WINDOW = 6
_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "“”„«»‘’…–—¿¡"
_OPEN, _CLOSE = "\"“„«‘'", "\"”“»’'"
#: Words of reported speech in the four languages of the tables.
REPORTS = frozenset("said says wrote writes quoted quote called reported dit écrit citation sagte schrieb zitat dijo escribió cita".split())
_KNOWN_WORDS = 300_000


def edits_allowed(term: str) -> int:
    return sum(len(term) >= n for n in FUZZY_FROM)


class Automaton:
    """The product of a trie of terms with their Levenshtein automata, made deterministic as words need it.

    A state is a set of (trie node, edits so far, letter owed); a letter moves along the edge it names, or spends an edit:
    along any edge (substitution), at the same node (insertion), on entering a node, one edge further without a letter
    (deletion), or along the second of two edges, the first's letter being owed (swapped neighbours). A term is as many
    edits away at most as ``edits_allowed`` says. A word is dropped at the letter that leaves no state, mostly after
    three or four.
    """

    def __init__(self, terms: list[str], allowed: Callable[[str], int] = edits_allowed):
        self.terms = terms
        self.edges: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        self.allowed = [allowed(t) for t in terms]
        self.most = [0]  # edits that some term at or below a node allows
        for number, term in enumerate(terms):
            node, n = 0, self.allowed[number]
            self.most[0] = max(self.most[0], n)
            for c in term:
                nxt = self.edges[node].get(c)
                if nxt is None:
                    nxt = len(self.edges)
                    self.edges.append({})
                    self.most.append(0)
                    self.edges[node][c] = nxt
                node = nxt
                self.most[node] = max(self.most[node], n)
            self.ends[node] = number
        self.sets: list[frozenset] = []
        self.number: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.found: list[tuple[int, int] | None] = []
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        least: dict[tuple[int, str], int] = {}
        work = list(items)
        while work:
            node, edits, owed = work.pop()
            if edits > self.most[node] or edits >= least.get((node, owed), 99):
                continue
            least[node, owed] = edits
            if not owed:
                work.extend((x, edits + 1, "") for x in self.edges[node].values())
        closed = frozenset((n, e, o) for (n, o), e in least.items())
        if not closed:
            return -1
        if closed not in self.number:
            self.number[closed] = len(self.sets)
            self.sets.append(closed)
            self.moves.append({})
            ends = [(e, self.ends[n]) for n, e, o in closed if not o and n in self.ends and e <= self.allowed[self.ends[n]]]
            self.found.append(min(ends)[::-1] if ends else None)
        return self.number[closed]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, owed in self.sets[state]:
            edges = self.edges[node]
            if owed:
                if owed == c:
                    out.add((node, edits, ""))
                continue
            if c in edges:
                out.add((edges[c], edits, ""))
            if edits < self.most[node]:
                out.add((node, edits + 1, ""))
                for k, x in edges.items():
                    if k != c:
                        out.add((x, edits + 1, ""))
                        if c in self.edges[x]:
                            out.add((self.edges[x][c], edits + 1, k))
        self.moves[state][c] = nxt = self._state(out)
        return nxt

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term, the first of the list on a tie; None beyond the edits a term allows."""
        state, moves = self.start, self.moves
        for c in word:
            nxt = moves[state].get(c)
            if nxt is None:
                nxt = self._move(state, c)
            if nxt < 0:
                return None
            state = nxt
        return self.found[state]


def words_of(text: str | None) -> list[str]:
    """Lower-case words without punctuation at their ends."""
    return [w for x in text.lower().split() if (w := x.strip(_EDGE))] if text else []


def _quoted(raw: list[str], at: int) -> bool:
    """Whether a match stands in reported speech: between quotation marks, or by a reporting word, within the window."""
    before, after = raw[max(0, at - WINDOW) : at + 1], raw[at : at + WINDOW + 1]
    if any(x.strip(_EDGE) in REPORTS for x in (*before, *after)):
        return True
    opens = any(x[0] in _OPEN and not (x[-1] in _CLOSE and len(x) > 1 and i < len(before) - 1) for i, x in enumerate(before))
    return opens and any(x.rstrip(".,;:!?")[-1:] in tuple(_CLOSE) for x in after)


class Scorer:
    """Matches of a text, and its features and score; words that are known not to match are remembered."""

    def __init__(self, terms: list[str], weights: list[list[float]], model: list[float] | None = None):
        """``weights``: of each term, by edits."""
        self.terms, self.weights, self.model = terms, weights, model
        self.reset()

    def reset(self) -> None:
        self.automaton, self.known = Automaton(self.terms), {}

    def __getstate__(self):
        return {"terms": self.terms, "weights": self.weights, "model": self.model}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.reset()

    def matches(self, text: str | None) -> tuple[int, list[tuple[int, int, bool]]]:
        """(words, [(term, edits, quoted)])."""
        raw = text.lower().split() if text else []
        known, out = self.known, []
        for i, x in enumerate(raw):
            try:
                m = known[x]
            except KeyError:
                m = self.automaton.match(x.strip(_EDGE))
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                known[x] = m
            if m is not None:
                out.append((*m, _quoted(raw, i)))
        return len(raw), out

    def features(self, text: str | None) -> list[float]:
        """Bias, sum and maximum of the match weights, what of it is quoted, and matches by length."""
        n, found = self.matches(text)
        weights = [self.weights[term][edits] * (0.5 if quoted else 1.0) for term, edits, quoted in found]
        quoted = sum(w for w, m in zip(weights, found, strict=True) if m[2])
        return [1.0, math.log1p(sum(weights)), max(weights, default=0.0), math.log1p(quoted), sum(weights) / math.sqrt(n + 20.0)]

    def score(self, text: str | None) -> float:
        z = sum(a * b for a, b in zip(self.model, self.features(text), strict=True))
        return round(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z)))), 6)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the bias is not shrunk."""
    w, shrink = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + shrink, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(text, y) of about ``most`` labelled documents outside the held-out fifth, chosen by a hash of the id."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label).cast("int").alias("y"))
    share = min(1.0, most / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("doc_id").agg(F.max("y").alias("y"))
    return docs.select("doc_id", "text").join(small(chosen), "doc_id").select("text", "y")  # so the documents do not shuffle


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Scorer:
    """Learn terms, their weights and the score from ``labels(doc_id, toxic)``, never from held-out rows.

    A term is a word whose distinct contexts (the words on both sides) lie in toxic documents far beyond chance: its
    log-likelihood ratio passes a bound for as many words as were looked at. Copies of a document share their contexts,
    so a copied text cannot make its words terms. Every such word is a term, of any length; ``most`` alone bounds what the
    driver holds. Weights are smoothed log-odds; neighbours of one and of two edits have their own for each term, drawn to
    a half and a quarter of the term's where the sample says nothing. Without labels of both kinds the score is constant.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", most), "labelled")

    def contexts(texts: list) -> list[tuple]:
        out = []
        for text in texts:
            w = words_of(text)
            around = ["", *w, ""]
            out.append((sorted({f"{b}\t{a}\t{c}" for a, b, c in zip(around, w, around[2:], strict=False)}),))
        return out

    seen = add_columns(sample, "text", "seen array<string>", contexts, ["y"]).select("y", F.explode("seen").alias("seen")).groupBy("seen").agg(F.max("y").alias("y"))
    counts = materialize(seen.groupBy(F.split_part("seen", F.lit("\t"), F.lit(1)).alias("word")).agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n")), "words")
    total = counts.agg(F.count("*"), F.sum("t"), F.sum("n")).first()
    vocabulary, toxic, clean = total[0] or 0, float(total[1] or 0), float(total[2] or 0)
    both = sample.agg(F.sum("y"), F.sum(1 - F.col("y"))).first()
    if not both[0] or not both[1]:
        return Scorer([], [], [-30.0 if not both[0] else 30.0, 0.0, 0.0, 0.0, 0.0])
    p = toxic / (toxic + clean)
    t, n = F.col("t").cast("double"), F.col("n").cast("double")
    ratio = 2 * (t * F.log(t / ((t + n) * p)) + F.when(n > 0, n * F.log(n / ((t + n) * (1 - p)))).otherwise(0.0))
    odds = F.log((t + 0.5) / (n + 0.5) * (clean / toxic))
    picked = counts.where("t >= 3").withColumns({"ratio": ratio, "odds": odds}).where((F.col("ratio") >= 2 * math.log(20 * vocabulary)) & (F.col("odds") >= 2.0))
    terms = sorted((r.word, min(r.odds, 6.0)) for r in picked.collect())
    scorer = Scorer([w for w, _ in terms], [[o, 0.5 * o, 0.25 * o] for _, o in terms])
    for r in _near_words(counts, scorer.terms).groupBy("term", "edits").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).collect():
        own = scorer.weights[r.term]
        prior = math.exp(own[r.edits])
        own[r.edits] = max(0.0, min(own[0], math.log((r.t * clean / toxic + 2 * prior) / (r.n + 2))))

    features = add_columns(sample, "text", "x array<double>", lambda texts: [(scorer.features(x),) for x in texts], ["y"]).collect()
    scorer.model = _logistic(np.array([r.x for r in features]), np.array([r.y for r in features], float)).tolist()
    return scorer


def _near_words(counts: DataFrame, terms: list[str]) -> DataFrame:
    """(term, edits, t, n) of the sample's distinct words that are within the allowed edits of a term, but none."""

    def check(words: list) -> list[tuple]:
        automaton = Automaton(terms)
        return [automaton.match(w) or (-1, 0) for w in words]

    return add_columns(counts, "word", "term int, edits int", check).where("edits > 0").select("term", "edits", "t", "n")


def toxicity(docs: DataFrame, scorer: Scorer, threshold: float = 0.5, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold``), from the text alone.

    Null and empty texts score as a text without matches. Repeated rows score alike; other columns are not read; kept
    columns named score or predicted are replaced; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(scorer)
    scored = add_columns(docs, text_col, "score double", lambda texts: [(model.value.score(x),) for x in texts], keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by what the labels outside the held-out fifth teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
