"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialize, table
from .texts import add_columns
from .toxicity import labelled_sample

#: Labelled rows that the model is fitted on, at most about so many (chosen by a hash of the id).
LABELLED = 20_000
FEATURES, RIDGE, SEED = 256, 1.0, 5
#: Width of the Gaussian kernel, over standardised statistics.
WIDTH = 4.0
_BINS = 400
_GROUPS = {"space": b" ", "line": b"\n", "digit": b"0123456789", "upper": bytes(range(65, 91)), "stop": b".", "comma": b",", "bang": b"!?", "sign": b"#$%&*@^~", "bar": b"|<>{}[]\\/=_", "quote": b"\"'`"}
_CLASS = np.zeros((256, len(_GROUPS) + 1))
for _i, _chars in enumerate(_GROUPS.values()):
    _CLASS[list(_chars), _i] = 1.0
_CLASS[128:, len(_GROUPS)] = 1.0


def statistics(text: str | None) -> list[float]:
    """What a text looks like: sizes, shares of byte classes, and how much its words and lines repeat."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    if not data:
        return [0.0] * N_STATISTICS
    shares = np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASS / len(data)
    words = data.split()
    n = max(1, len(words))
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    top = max(counts.values(), default=0)
    upper = sum(map(str.isupper, text.split()[:n])) / n
    return [
        math.log1p(len(data)), math.log1p(n), len(data) / n / 10, *np.sqrt(shares).tolist(), upper,
        len(counts) / n, math.log1p(len(counts)) / math.log1p(n), top / n, sum(map(eq, words, words[1:])) / n,
        math.log1p(len(lines)), len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))),
    ]


N_STATISTICS = 3 + len(_GROUPS) + 1 + 1 + 4 + 3


class Model:
    """Standardised statistics -> cosines of random directions -> ridge score -> calibrated score."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, n_features: int, width: float, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.mean, self.scale = mean, scale
        self.directions = rng.normal(0, 1 / width, (len(mean), n_features - 1))
        self.phases = rng.uniform(0, 2 * np.pi, n_features - 1)
        self.weights = np.zeros(n_features)
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6) @ self.directions + self.phases
        return np.hstack([np.cos(z) * math.sqrt(2 / len(self.phases)), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.weights

    def score(self, texts: list) -> np.ndarray:
        stats = np.array([statistics(t) for t in texts]).reshape(len(texts), N_STATISTICS)
        return np.round(np.clip(np.interp(self.raw(stats), *self.knots), 0, 1), 6)


def isotonic(at: np.ndarray, weight: np.ndarray, mean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points in increasing order -> knots at the pooled blocks' centres."""
    blocks: list[list[float]] = []
    for x, w, y in zip(at, weight, mean, strict=True):
        blocks.append([x, w, y])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            x2, w2, y2 = blocks.pop()
            x1, w1, y1 = blocks.pop()
            blocks.append([(x1 * w1 + x2 * w2) / (w1 + w2), w1 + w2, (y1 * w1 + y2 * w2) / (w1 + w2)])
    return np.array([b[0] for b in blocks]), np.array([b[2] for b in blocks])


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, n_features: int = FEATURES, ridge: float = RIDGE, width: float = WIDTH, seed: int = SEED) -> Model:
    """Fit on ``labels(doc_id, quality)``, never on held-out rows.

    Each partition of the sample sums its own normal equations; their sums by matrix row meet in as many groups as there
    are features. A quarter of the sample (by a hash of the text) is kept from the fit and calibrates it, binned by
    score. The driver holds one matrix of ``n_features`` squared, and the bins. Without labels of both kinds every
    document scores the share of ones.
    """
    sample = add_columns(labelled_sample(docs, labels, "quality", most), "text", "x array<double>", lambda texts: [(statistics(t),) for t in texts], ["y", "text"])
    sample = materialize(sample.select("y", "x", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("calibrate")), "statistics")
    moments = sample.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("y")).orderBy("i").collect()
    share = moments[0].y if moments else 0.5
    mean = np.array([r.m for r in moments] or [0.0] * N_STATISTICS)
    scale = np.array([max(r.s, 1e-3) for r in moments] or [1.0] * N_STATISTICS)
    model = Model(mean, scale, n_features, width, seed)
    if not 0 < share < 1:
        model.knots = (np.array([0.0, 1.0]), np.array([share, share]))
        return model

    def normal(batches):
        total = np.zeros((n_features, n_features + 1))
        for pdf in batches:
            z, y = model.fourier(np.stack(pdf["x"].to_numpy())), pdf["y"].to_numpy(float)
            total += z.T @ np.hstack([z, y[:, None]])
        yield pd.DataFrame({"i": np.arange(n_features), "row": list(total)})

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = np.stack(sorted(pdf["row"].to_numpy(), key=lambda r: r.tobytes()))
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "row": [rows.sum(axis=0)]})

    sums = sample.where(~F.col("calibrate")).select("y", "x").mapInPandas(normal, "i int, row array<double>").groupBy("i").applyInPandas(add, "i int, row array<double>")
    matrix = np.array([r.row for r in sums.orderBy("i").collect()])
    if matrix.any():
        gram, target = matrix[:, :-1], matrix[:, -1]
        model.weights = np.linalg.solve(gram + np.diag([ridge] * (n_features - 1) + [1e-6]), target)

    def scored(batches):
        for pdf in batches:
            raw = np.clip(model.raw(np.stack(pdf["x"].to_numpy())), -0.5, 1.5)
            yield pd.DataFrame({"bin": np.round(raw * _BINS / 2).astype(int), "raw": raw, "y": pdf["y"].to_numpy(float)})

    bins = sample.where("calibrate").select("y", "x").mapInPandas(scored, "bin int, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("raw"), F.count("*").alias("n"), F.avg("y").alias("y")).orderBy("bin").collect()
    if bins:
        x, y = isotonic(np.array([r.raw for r in bins]), np.array([r.n for r in bins], float), np.array([r.y for r in bins]))
        # a slight slope keeps the order of the ridge scores inside and beyond the pooled blocks
        x, y = np.concatenate([[-1.0], x, [2.0]]), np.concatenate([[y[0]], y, [y[-1]]])
        model.knots = (x, 0.999 * y + 0.001 * (x + 1) / 3)
    return model


def quality(docs: DataFrame, model: Model, threshold: float = 0.3, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better) and ``predicted`` (1 from ``threshold``), from the text alone.

    Null and empty texts score as a text whose statistics are all 0. Repeated rows score alike; other columns are not
    read; kept columns named score or predicted are replaced; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    scored = add_columns(docs, text_col, "score double", lambda texts: [(float(x),) for x in sent.value.score(texts)], keep)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by what the labels outside the held-out fifth teach."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality(docs, learn(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
