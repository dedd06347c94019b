"""Sentiment and risk: named profiles over one frame; columns are added, rows never dropped."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import profiles as P
from .validation import first_reason


def _sign(score: Column, at: float, inclusive: bool) -> Column:
    up, down = (score >= at, score <= -at) if inclusive else (score > at, score < -at)
    return F.when(up, 1).when(down, -1).otherwise(0)


def sentiment(df: DataFrame, profile: str = "lexicon", text_col: str = "text", lexicon: dict | None = None, rules: dict | None = None, stored: str | None = None) -> DataFrame:
    """Adds ``score``, ``label`` (-1, 0, 1) and ``confidence``, and the counts they rest on.

    ``lexicon``: whole words and rules, weighted, over the matches, within -1 and 1; label from 0.2 inclusive.
    ``tokens``: distinct tokens; the sign of the difference. ``substring``: terms anywhere; label beyond 0.2.
    ``context``: the majority of terms anywhere, unless the JSON column ``stored`` holds a ``sentiment``. Null texts are empty; each profile's empty result is its own.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if profile == "lexicon":
        words, ruled = C.lexicon_counts(C.clean_text(text), lexicon or P.LEXICON), C.regex_counts(C.clean_text(text), P.RULES if rules is None else rules)
        out = df.withColumns({f"{k}_count": (words[k] + ruled.get(k, F.lit(0))).cast("long") for k in words})
        n = C.total([F.col(f"{k}_count") for k in words])
        raw = C.total([F.col(f"{k}_count") * P.COEFFICIENTS[k] for k in words])
        out = out.withColumn("matches", n).withColumn("score", F.when(n == 0, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw / n))))
        return out.withColumns({"label": _sign(F.col("score"), P.LABEL_AT, True), "confidence": F.abs("score")})
    terms = lexicon or {"tokens": P.TOKENS, "substring": P.SUBSTRINGS, "context": P.CONTEXT_TERMS}[profile]
    hits = C.token_hits if profile == "tokens" else C.substring_hits
    out = df.withColumns({"bullish_count": hits(text, terms["bullish"]).cast("long"), "bearish_count": hits(text, terms["bearish"]).cast("long")})
    up, down = F.col("bullish_count"), F.col("bearish_count")
    n = up + down
    if profile == "tokens":
        return out.withColumns({"score": (up - down).cast("double"), "label": F.signum((up - down).cast("double")).cast("int"), "confidence": F.when(text == "", 0.0).when(n == 0, 0.5).otherwise(F.least(F.lit(1.0), n / 5.0) * 0.5 + 0.5)})
    if profile == "substring":
        score = F.when(n == 0, 0.0).otherwise((up - down) / n)
        return out.withColumns({"score": score, "label": _sign(score, P.LABEL_AT, False), "confidence": F.when(n == 0, 0.5).otherwise(F.least(F.lit(0.95), 0.5 + n * 0.1))})
    label = F.when(up > down, 1).when(down > up, -1).otherwise(0)
    sure = F.when(label == 0, 0.5).otherwise(F.least(F.greatest(up, down) * 0.1 + 0.5, F.lit(0.95)))
    if stored:
        kept = F.from_json(F.get_json_object(stored, "$.sentiment"), "label int, confidence double")
        label, sure = F.when(kept.isNotNull(), kept["label"]).otherwise(label), F.when(kept.isNotNull(), kept["confidence"]).otherwise(sure)
    return out.withColumns({"score": label.cast("double"), "label": label, "confidence": sure})


def weighted_score(df: DataFrame) -> DataFrame:
    """``weighted_score`` = score x reliability x (1 + (engagement + author) / 20), ``signal_strength`` = its size x confidence."""
    w = F.col("score") * F.col("source_reliability") * (1 + (F.col("engagement_weight") + F.col("author_weight")) / 20)
    return df.withColumn("weighted_score", w).withColumn("signal_strength", F.abs("weighted_score") * F.col("confidence"))


def merge_sentiment(df: DataFrame, reply_col: str = "reply") -> DataFrame:
    """Final label and confidence: the rules' wherever a term matched, else those of a model's reply, else neutral."""
    body = F.regexp_extract(F.regexp_replace(F.coalesce(F.col(reply_col), F.lit("")), r"```(?:json)?", ""), r"\{[^}]+\}", 0)
    got = F.from_json(F.when(body != "", body), "label int, confidence double")
    valid = got["label"].isin(-1, 0, 1)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(got["confidence"], F.lit(0.5))))
    return df.withColumns({
        "model_used": (F.col("matches") == 0) & F.coalesce(valid, F.lit(False)),
        "final_label": F.when(F.col("matches") > 0, F.col("label")).when(valid, got["label"]).otherwise(0),
        "final_confidence": F.when(F.col("matches") > 0, F.col("confidence")).when(valid, sure).otherwise(0.0),
    })


def classify_unmatched(df: DataFrame, load: Callable[[], Callable[[list[str]], list[tuple[int, float]]]], text_col: str = "text", rows: int = 256) -> DataFrame:
    """Final label and confidence: the rules' wherever a term matched, else those of an injected classifier, else neutral.

    ``load()`` gives the classifier, once for each Python worker and pass; it maps a list of texts, at most ``rows`` of
    them, to (label, confidence). Only texts of rows with ``matches = 0`` reach it; other rows pass Python as nulls, and
    nothing shuffles or is read twice. A label that is not -1, 0 or 1 counts as no answer; confidences are clamped, a null
    one is 0.5. Needs ``matches``, ``label`` and ``confidence``, as ``sentiment`` gives them.
    """

    def answers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for texts in batches:
            out = pd.DataFrame({"label": pd.array([None] * len(texts), "Int32"), "confidence": np.full(len(texts), np.nan)})
            asked = np.flatnonzero(texts.notna())
            for at in range(0, len(asked), rows):
                model = model or load()
                some = asked[at : at + rows]
                for i, (label, sure) in zip(some, model(texts.iloc[some].tolist()), strict=True):
                    out.iat[i, 0], out.iat[i, 1] = label, np.nan if sure is None else sure
            yield out

    ask = F.pandas_udf(answers, "label int, confidence double")
    out = df.withColumn("_said", ask(F.when(F.col("matches") == 0, F.coalesce(F.col(text_col), F.lit("")))))
    said = F.col("_said")
    valid = F.coalesce((F.col("matches") == 0) & said["label"].isin(-1, 0, 1), F.lit(False))
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(said["confidence"], F.lit(None).cast("double")), F.lit(0.5))))
    return out.withColumns({
        "model_used": valid,
        "final_label": F.when(F.col("matches") > 0, F.col("label")).when(valid, said["label"]).otherwise(0),
        "final_confidence": F.when(F.col("matches") > 0, F.col("confidence")).when(valid, sure).otherwise(0.0),
    }).drop("_said")


def zone(index: Column) -> Column:
    return F.when(index.isNull(), "unknown").when(index <= 20, "extreme_fear").when(index >= 80, "extreme_greed").otherwise("normal")


def risk_indicators(df: DataFrame, profile: str = "core", text_col: str = "text", stored: str | None = None) -> DataFrame:
    """Adds the risk flags and the fear and greed zone.

    ``core``: needs label, confidence, velocity, anomaly and fear_greed_index (null allowed). ``worker``: from the
    text's fear and greed tokens. ``context``: from velocity alone, unless the JSON column ``stored`` holds
    ``risk_indicators``. ``orchestrated``: core with defaults for nulls.
    """
    if profile == "worker":
        text = F.coalesce(F.col(text_col), F.lit(""))
        out = df.withColumns({"fear_count": C.token_hits(text, P.TOKENS["fear"]).cast("long"), "greed_count": C.token_hits(text, P.TOKENS["greed"]).cast("long")})
        fear, greed = F.col("fear_count"), F.col("greed_count")
        index = F.when(fear > greed + 2, F.greatest(F.lit(0), 25 - fear * 5)).when(greed > fear + 2, F.least(F.lit(100), 75 + greed * 5)).otherwise(F.greatest(F.lit(25), F.least(F.lit(75), 50 + (greed - fear) * 10)))
        return out.withColumns({
            "social_overheat": (F.col("velocity") > 5.0) | (greed >= 3),
            "panic_risk": (F.col("label") == -1) & (fear >= 2),
            "fomo_risk": (F.col("label") == 1) & (greed >= 2),
            "fear_greed_index": index.cast("double"),
            "fear_greed_zone": F.when(fear > greed + 2, "extreme_fear").when(greed > fear + 2, "extreme_greed").otherwise("normal"),
        })
    if profile == "context":
        v = F.when(F.coalesce(F.col("velocity"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("velocity"))
        flags = {"social_overheat": v > 5.0, "panic_risk": F.lit(False), "fomo_risk": v > 3.0, "fear_greed_index": F.lit(None).cast("double"), "fear_greed_zone": F.lit("unknown"), "sentiment_reliability": F.lit("normal")}
        if stored:
            kept = F.from_json(F.get_json_object(stored, "$.risk_indicators"), "social_overheat boolean, panic_risk boolean, fomo_risk boolean, fear_greed_index double, fear_greed_zone string, sentiment_reliability string")
            flags = {k: F.when(kept.isNotNull(), kept[k]).otherwise(v) for k, v in flags.items()}
        return df.withColumns(flags)
    if profile == "orchestrated":
        defaults = {"label": 0, "velocity": 1.0, "anomaly": False, "fear_greed_index": 50.0}
        df = df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
    index = F.col("fear_greed_index")
    return df.withColumns({
        "social_overheat": (F.col("velocity") >= 3.0) & F.col("anomaly"),
        "panic_risk": (F.col("label") == -1) & (F.col("velocity") >= 2.0),
        "fomo_risk": (F.col("label") == 1) & F.coalesce(index >= 70, F.lit(False)),
        "fear_greed_zone": zone(index),
        "sentiment_reliability": F.when(F.col("confidence") < 0.6, "low").otherwise("normal"),
    })


# The gate's reasons, in order, by action; a later one holds only where no earlier one does.
GATE_BLOCK = ["No social data available", "Data quality is critical", "Panic risk detected", "Extreme fear zone", "Social overheat detected"]
GATE_REDUCE = ["Sentiment reliability is low", "Data quality is degraded", "FOMO risk detected"]
GATE_ALLOW = "Trading allowed"


def trading_gate(df: DataFrame) -> DataFrame:
    """``action`` (block, reduce, allow) and ``reason``: the first rule that holds, blocking ones first; nulls hold for none."""
    c = F.col
    block = [c("overall").isNull(), c("overall") == "critical", c("panic_risk"), c("fear_greed_zone") == "extreme_fear", c("social_overheat")]
    reduced = [c("sentiment_reliability") == "low", c("overall") == "degraded", c("fomo_risk")]
    reason = first_reason(*zip([*block, *reduced], [*GATE_BLOCK, *GATE_REDUCE], strict=True))
    out = df.withColumn("reason", F.coalesce(reason, F.lit(GATE_ALLOW)))
    return out.withColumn("action", F.when(c("reason").isin(*GATE_BLOCK), "block").when(c("reason").isin(*GATE_REDUCE), "reduce").otherwise("allow"))


def enrich(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All columns of ``df`` unchanged, and what the stages add: by default lexicon sentiment and orchestrated risk.

    A stage is any function of a frame, so an analyser can be put in place of the given ones. It works on a copy: a column
    that it overwrites, and any row order, stays as it was.
    """
    stages = stages or (sentiment, lambda d: risk_indicators(d, "orchestrated"))
    out = df.withColumn("_own", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    for stage in stages:
        out = stage(out)
    added = [c for c in out.columns if c not in df.columns and c != "_own"]
    return out.select("_own.*", *added)
