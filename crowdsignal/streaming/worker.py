"""The worker's live path as one query: rules, time rule, repeats and velocity in a chain, one commit for each batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..functions import profiles as P
from ..operators import ordered, scoring, tables, validation
from . import processors
from .commits import commit_batch

#: The worker's time rule: seconds in the future, and of delay.
FUTURE, DELAY = 5, 300


def live_rows(posts: DataFrame, keywords: tuple[str, ...] = ("btc", "bitcoin", "$btc")) -> DataFrame:
    """Posts with ``drop_reason`` by the worker's rules, then its time rule, and the fingerprint, weights, flag and asset of each.

    Metrics that a platform does not have are nulls or missing columns and count as nothing.
    """
    c = F.col
    checked = validation.validate_raw(posts, keywords)
    checked = ordered.time_check(checked, future=FUTURE, delay=DELAY).withColumn("drop_reason", F.coalesce("drop_reason", "time_reason")).drop("time_reason")
    metrics = {n: c(n) for n in ("likes", "reposts", "replies", "score", "comments", "views", "forwards") if n in posts.columns}
    have = lambda n, kind: c(n) if n in posts.columns else F.lit(None).cast(kind)
    out = checked.withColumns({
        "fingerprint": C.fingerprint("worker", source=c("source"), text=F.coalesce("text", F.lit("")), event_time=F.timestamp_seconds("event_s")),
        "source_reliability": C.reliability(c("source")),
        "engagement_weight": C.engagement_linear(c("source"), **metrics),
        "author_weight": C.author_linear(c("source"), have("followers", "double"), have("verified", "boolean")),
    })
    return tables.detect_assets(ordered.flag_pump_terms(out)).drop("assets")


def live_stream(posts: DataFrame, keywords: tuple[str, ...] = ("btc", "bitcoin", "$btc"), profile: str = "ing_tw", by: tuple[str, ...] = ("source",), ts: str = "arrival_s", order: tuple[str, ...] = ("event_id",), delay: str = "10 minutes") -> DataFrame:
    """``live_rows`` of a stream, repeats dropped, velocities counted over what is left: two stateful steps in one query.

    The fingerprint holds the event time, and the time rule admits rows of at most ``FUTURE`` and ``DELAY``; so whatever
    may repeat a row arrives within their sum, and remembering a fingerprint so long drops every repeat, as a unique
    column of the stored table would.
    """
    rows = processors.arriving(live_rows(posts, keywords), ts, delay)
    every = dict.fromkeys(P.MAX_DELAY, FUTURE + DELAY)
    once = processors.duplicates(rows, windows=every, default=FUTURE + DELAY, ts=ts, order=order)
    once = once.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("duplicate"), "duplicate"))).drop("duplicate")
    return processors.velocity(once, profile, by, ts, order).drop(processors.AT)


def live_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of a batch: raw, sentiment, risk, drops by reason, and counts by source.

    Risk is taken at velocity 0, as the worker does; the counted velocity is stored with the raw row.
    """
    accepted = validation.keep_accepted(rows).drop("drop_reason")
    scored = scoring.sentiment(accepted, "tokens")
    risk = scoring.risk_indicators(scored.withColumn("velocity", F.lit(0.0)), "worker")
    key = [c for c in ("event_id", "replay") if c in rows.columns]
    return {
        "raw": accepted,
        "sentiment": scored.select(*key, "event_s", "label", "confidence"),
        "risk": risk.select(*key, "event_s", "label", "social_overheat", "panic_risk", "fomo_risk", "fear_greed_index", "fear_greed_zone"),
        "drops": rows.groupBy("source", F.coalesce("drop_reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n")),
    }


def live_sink(path: str, hook: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function that commits the batch's tables together. ``hook`` may change the rows before they are scored."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = (hook(batch) if hook else batch).persist()
        try:
            commit_batch(path, batch_id, live_tables(kept))
        finally:
            kept.unpersist()

    return write


def start_worker(posts: DataFrame, path: str, checkpoint: str, every: str | None = None, hook: Callable[[DataFrame], DataFrame] | None = None, **options) -> StreamingQuery:
    """The live path over ``posts``, a batch ``every`` so often, or, without it, over what is there now."""
    writer = live_stream(posts, **options).writeStream.foreachBatch(live_sink(path, hook)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
