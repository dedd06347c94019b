"""Streaming twins of the order-sensitive operators.

State is one small value per key. With ``ttl`` it goes when a key has not been seen for so many seconds of processing
time; such a query runs on, as it waits for keys to expire, so leave it out where a query is to end. Within a micro-batch the rows of a key are sorted by arrival; batches follow arrival,
as a queue or a growing folder gives them. Checkpoints restore the state after a restart, so no decision is taken twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import columns as C
from ..functions import profiles as P


def with_lateness(stream: DataFrame, event: str = "event_time", arrival: str = "arrival_time", delay: str = "120 seconds") -> DataFrame:
    """Adds ``lag_s`` and ``lateness`` (future, late or null) by wall clock, and a watermark that only bounds state."""
    lag = F.unix_micros(arrival) / 1e6 - F.unix_micros(event) / 1e6
    late = F.when(lag < 0, "future").when(lag > C.by_source(F.col("source"), P.MAX_DELAY), "late")
    return stream.withWatermark(event, delay).withColumn("lag_s", lag).withColumn("lateness", late)


def dedupe_stream(stream: DataFrame, key: str = "fingerprint", event: str = "event_time", window: str = "30 minutes") -> DataFrame:
    """The first row of each key; a key is remembered for the window, the longest of the sources'."""
    return stream.withWatermark(event, window).dropDuplicatesWithinWatermark([key])


def _stateful(stream: DataFrame, by: list[str], order: list[str], flag: str, state: str, decide, ttl: int | None) -> DataFrame:
    """Adds the boolean ``flag`` that ``decide(state, rows)`` gives for a key's rows in order, and its new state."""
    names = stream.columns

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        flags, kept = decide(group.get if group.exists else None, rows)
        group.update(kept)
        if ttl:
            group.setTimeoutDuration(ttl * 1000)
        yield rows[names].assign(**{flag: flags})

    schema = ", ".join(f"`{n}` {t}" for n, t in stream.dtypes) + f", {flag} boolean"
    return stream.groupBy(*by).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout)


def order_guard_stream(stream: DataFrame, event: str = "event_s", order: tuple[str, ...] = ("arrival_s", "event_id"), ttl: int | None = None) -> DataFrame:
    """Adds ``out_of_order``: below the largest earlier event time of the source and asset, less the source's tolerance."""

    def decide(state, rows):
        seen, flags = (state[0] if state else None), []
        tolerance = P.ORDER_TOLERANCE.get(rows["source"].iloc[0], 0)
        for t in rows[event]:
            flags.append(seen is not None and t < seen - tolerance)
            seen = t if seen is None else max(seen, t)
        return flags, (int(seen),)

    return _stateful(stream, ["source", "asset"], list(order), "out_of_order", "seen bigint", decide, ttl)


def admit_stream(stream: DataFrame, by: str, limit: int, window: int = 60, ts: str = "arrival_s", order: tuple[str, ...] = ("arrival_s", "event_id"), ttl: int | None = None) -> DataFrame:
    """Adds ``admitted`` as the batch operator does; the state is the times admitted within the window, ``limit`` at most.

    ``ttl`` must be longer than the window.
    """

    def decide(state, rows):
        kept, flags = (list(state[0]) if state else []), []
        for t in rows[ts]:
            kept = [x for x in kept if x > t - window]
            flags.append(len(kept) < limit)
            if flags[-1]:
                kept.append(int(t))
        return flags, (kept,)

    return _stateful(stream, [by], list(order), "admitted", "kept array<bigint>", decide, ttl)


def suppress_stream(stream: DataFrame, by: str = "alert_key", quiet: int = 600, ts: str = "arrival_s", order: tuple[str, ...] = ("arrival_s", "event_id")) -> DataFrame:
    """Adds ``sent``: no alert of the key was sent in the last ``quiet`` seconds."""
    return admit_stream(stream, by, 1, quiet, ts, order).withColumnRenamed("admitted", "sent")


def signal_stream(stream: DataFrame, event: str = "event_time", size: str = "30 minutes", slide: str | None = None, delay: str = "2 minutes") -> DataFrame:
    """Scored rows per asset and window, tumbling or sliding, final once the watermark has passed."""
    w = F.window(event, size, slide) if slide else F.window(event, size)
    out = stream.withWatermark(event, delay).groupBy(w.alias("w"), "asset").agg(F.count("*").alias("total"), F.avg("score").alias("avg_score"))
    return out.select(F.col("w.start").alias("window_start"), "asset", "total", "avg_score")
