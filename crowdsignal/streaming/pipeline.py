"""The continuous pipeline under the guard's limits: validated posts to raw, sentiment and risk tables, one query per source.

The worker's live path, with its own time rule, repeats, weights and one commit a batch, is in ``worker``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import columns as C
from ..functions import profiles as P
from ..operators import products, scoring, validation
from .stateful import dedupe_stream


def dispatch_batch(path: str, keywords: tuple[str, ...] = ("btc", "bitcoin", "$btc"), hook: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A batch function that writes raw, sentiment, risk, drop counts and the batch's quality, in this order.

    Rows are validated, then guarded: future and late ones, by their source's limits, are dropped. Every table has a
    folder per batch, overwritten if the batch is run again, so a restart writes nothing twice. The batch is kept while
    its writes run. ``hook`` may change accepted rows before they are scored.
    """
    lag = F.col("arrival_s") - F.col("event_s")
    guard = F.when(lag < 0, "future").when(lag > C.by_source(F.lower("source"), P.MAX_DELAY), "late")

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = validation.validate_raw(batch, keywords).withColumn("drop_reason", F.coalesce("drop_reason", guard)).persist()
        try:
            accepted = validation.keep_accepted(checked).drop("drop_reason")
            accepted = accepted.transform(hook) if hook else accepted
            scored = scoring.sentiment(accepted, "tokens")
            risk = scoring.risk_indicators(scored.withColumn("velocity", F.lit(0.0)), "worker")
            each = checked.groupBy("source").agg(F.count("*").alias("c"), F.count("drop_reason").alias("d"), F.max(lag).alias("lag"))
            counts = each.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("collected"), F.coalesce(F.sum("d"), F.lit(0)).alias("dropped"), F.coalesce(F.sum(F.col("c") - F.col("d")), F.lit(0)).alias("inserted"), F.max("lag").alias("max_lag"), F.max(F.col("c") - F.col("d")).alias("max_source"), F.lit(0).alias("errors"))
            put = lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
            put(accepted, "raw")
            put(scored.select("event_id", "event_s", "label", "confidence"), "sentiment")
            put(risk.select("event_id", "event_s", "social_overheat", "panic_risk", "fomo_risk", "fear_greed_index", "fear_greed_zone"), "risk")
            put(checked.groupBy(F.coalesce("drop_reason", F.lit("accepted")).alias("reason")).count(), "drops")
            put(products.worker_quality(counts), "quality")
        finally:
            checked.unpersist()

    return write


def start_pipeline(streams: dict[str, DataFrame], path: str, checkpoint: str, every: str | None = None, dedupe: str | None = None, **options) -> dict[str, StreamingQuery]:
    """One query per source; a source that fails does not stop the others.

    Runs on, a batch ``every`` so often ("10 seconds"), or, without it, over what is there now. With ``dedupe`` the first
    row of each value of that column goes on to the rules, by an ``event_time`` within the longest window of the sources.
    """
    out = {}
    for name, stream in streams.items():
        stream = dedupe_stream(stream, dedupe) if dedupe else stream
        writer = stream.writeStream.foreachBatch(dispatch_batch(f"{path}/{name}", **options)).option("checkpointLocation", f"{checkpoint}/{name}")
        out[name] = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    return out
