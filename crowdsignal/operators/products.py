"""Aggregated products: signals, reports, context answers, quality reports, run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import profiles as P

SOURCES = tuple(P.RELIABILITY)


def signal_type(weighted: Column) -> Column:
    return F.when(weighted > 0.1, "BULLISH").when(weighted < -0.1, "BEARISH").otherwise("NEUTRAL")


def _signal() -> list[Column]:
    n = lambda x: F.count_if(F.col("label") == x)
    return [F.count("*").alias("total"), n(1).alias("bullish"), n(-1).alias("bearish"), n(0).alias("neutral"), F.avg("score").alias("avg_score"), F.avg("weighted_score").alias("avg_weighted"), F.avg("signal_strength").alias("avg_strength")]


def aggregate_signal(df: DataFrame, as_of: int, minutes: int = 30, ts: str = "event_s") -> DataFrame:
    """Per asset over the trailing window up to ``as_of`` (no upper bound, as future rows count): counts, means, type, velocity."""
    out = df.where(F.col(ts) >= as_of - 60 * minutes).groupBy("asset").agg(*_signal())
    return out.withColumns({"signal": signal_type(F.col("avg_weighted")), "velocity": F.col("total") / F.lit(float(minutes))})


def rolling_signal(df: DataFrame, minutes: int = 30, ts: str = "ts") -> DataFrame:
    """The same per asset and tumbling window of event time."""
    out = df.groupBy("asset", F.window(ts, f"{minutes} minutes").alias("w")).agg(*_signal())
    return out.select("asset", F.col("w.start").alias("window_start"), *[c for c in out.columns if c not in ("asset", "w")]).withColumns({"signal": signal_type(F.col("avg_weighted")), "velocity": F.col("total") / F.lit(float(minutes))})


def sources_breakdown(df: DataFrame) -> DataFrame:
    """Per asset a map source -> (count, mean weighted score); two levels, so no row list is built."""
    one = df.groupBy("asset", "source").agg(F.count("*").alias("n"), F.avg("weighted_score").alias("avg_score"))
    return one.groupBy("asset").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", F.struct(F.col("n").alias("count"), "avg_score"))))).alias("breakdown"))


def periodic_report(messages: DataFrame, scores: DataFrame, since: int, minutes: int = 30, ts: str = "arrival_s") -> DataFrame:
    """One row: totals by label, count-weighted means (null scores count in the number), type, strength, velocity; none without messages."""
    m = messages.where(F.col(ts) >= since).agg(F.count("*").alias("total_messages"))
    s = scores.where(F.col(ts) >= since).agg(F.count("*").alias("analyzed"), F.count_if(F.col("label") == 1).alias("bullish"), F.count_if(F.col("label") == -1).alias("bearish"), F.count_if(F.col("label") == 0).alias("neutral"), (F.coalesce(F.sum("score"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_score"), (F.coalesce(F.sum("weighted_score"), F.lit(0.0)) / F.greatest(F.count("*"), F.lit(1))).alias("avg_weighted"))
    out = m.crossJoin(s).where("total_messages > 0")  # one row each
    w = F.col("avg_weighted")
    return out.withColumns({"signal": signal_type(w), "strength": F.least(F.lit(1.0), F.abs(w) * 2), "velocity": F.col("total_messages") / F.lit(float(minutes))})


def context_sentiment(df: DataFrame, by: list[str]) -> DataFrame:
    """The label of the largest sum of reliability x confidence (a tie goes to -1, then 0, then 1), and the mean confidence within 0 and 1."""
    label = F.when(F.col("label").isin(-1, 0, 1), F.col("label")).otherwise(0)
    sure = F.coalesce("confidence", F.lit(0.5))
    weight = C.reliability(F.col("source")) * sure
    w = lambda x: F.sum(F.when(label == x, weight).otherwise(0.0))
    out = df.groupBy(*by).agg(w(-1).alias("w_down"), w(0).alias("w_flat"), w(1).alias("w_up"), F.avg(sure).alias("c"))
    pick = F.when((F.col("w_down") >= F.col("w_flat")) & (F.col("w_down") >= F.col("w_up")), -1).when(F.col("w_flat") >= F.col("w_up"), 0).otherwise(1)
    return out.select(*by, pick.alias("label"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("c"))), 4).alias("confidence"))


def context_risk(df: DataFrame, by: list[str], ts: str, tie: str) -> DataFrame:
    """Flags: any record's. Zone and index: the newest record's. Reliability: low if overheated or in panic, else the newest's."""
    last = F.max_by(F.struct("fear_greed_index", "fear_greed_zone", "sentiment_reliability"), F.struct(ts, tie))
    out = df.groupBy(*by).agg(F.bool_or("social_overheat").alias("social_overheat"), F.bool_or("panic_risk").alias("panic_risk"), F.bool_or("fomo_risk").alias("fomo_risk"), last.alias("last"))
    return out.select(*by, "social_overheat", "panic_risk", "fomo_risk", "last.fear_greed_index", "last.fear_greed_zone", F.when(F.col("social_overheat") | F.col("panic_risk"), "low").otherwise(F.col("last.sentiment_reliability")).alias("sentiment_reliability"))


def _worst(column: str, order: list[str]) -> Column:
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(column))
    return F.element_at(F.array(*map(F.lit, order)), F.greatest(F.max(rank), F.lit(1)).cast("int"))


def context_quality(df: DataFrame, by: list[str]) -> DataFrame:
    """The worst of overall, availability and time; the most frequent volume, balance and anomaly (a tie: the first by name)."""
    out = df.groupBy(*by).agg(_worst("overall", ["healthy", "degraded", "critical"]).alias("overall"), _worst("availability", ["ok", "degraded", "down"]).alias("availability"), _worst("time_integrity", ["ok", "unstable", "critical"]).alias("time_integrity"), *[F.mode(c, True).alias(c) for c in ("volume", "source_balance", "anomaly_frequency")])
    return out


def social_context(requests: DataFrame, messages: DataFrame, most: int = 1000, ts: str = "event_s", tie: tuple[str, ...] = ("event_id", "replay"), bucket_s: int = 300) -> DataFrame:
    """Per request (request_id, asset, since, until, sources) sentiment, risk and quality of its newest ``most`` rows; 204 without any.

    Rows carry the columns of ``context_sentiment``, ``context_risk`` and ``context_quality``; quality columns that they
    lack are as healthy as can be. A request stands in each stretch of ``bucket_s`` that its window touches, so that rows
    meet requests of their own asset and time only, and one job answers all windows.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_s)
    healthy = {"overall": "healthy", "availability": "ok", "time_integrity": "ok", "volume": "normal", "source_balance": "normal", "anomaly_frequency": "normal"}
    messages = messages.withColumns({c: F.lit(v) for c, v in healthy.items() if c not in messages.columns})
    r = requests.where("since <= until").select("request_id", F.col("asset").alias("r_asset"), "since", "until", "sources", F.explode(F.sequence(bucket("since"), bucket("until"))).alias("r_bucket"))
    hit = messages.join(r, (F.col("asset") == F.col("r_asset")) & (bucket(ts) == F.col("r_bucket")) & F.col(ts).between(F.col("since"), F.col("until")) & F.array_contains("sources", F.col("source")))
    n = F.row_number().over(Window.partitionBy("request_id").orderBy(F.desc(ts), *[F.desc(t) for t in tie]))
    top = hit.withColumn("_n", n).where(F.col("_n") <= most)
    top = top.withColumn("_tie", F.struct(*tie))
    by = ["request_id"]
    out = requests.select("request_id").join(context_sentiment(top, by), by, "left").join(context_risk(top, by, ts, "_tie"), by, "left").join(context_quality(top, by), by, "left")
    out = out.join(top.groupBy(*by).agg(F.count("*").alias("records")), by, "left")
    return out.withColumn("records", F.coalesce("records", F.lit(0))).withColumn("status", F.when(F.col("records") > 0, 200).otherwise(204))


def ticks(df: DataFrame, step: int, window: int, ts: str = "event_s") -> DataFrame:
    """Each row once for every report tick whose trailing window holds it: an equi-join's work without a range join."""
    first = F.ceil(F.col(ts) / step) * step
    last = F.floor((F.col(ts) + window) / step) * step
    return df.where(F.col(ts).isNotNull()).withColumn("tick", F.explode(F.when(first <= last, F.sequence(first, last, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))))


def _silence(age: Column, source: Column) -> Column:
    """0, 1 or 2: a source that was silent for so many seconds is ok, degraded or down."""
    return F.when(age >= C.by_source(source, P.AVAILABILITY_DOWN), 2).when(age >= C.by_source(source, P.AVAILABILITY_DEGRADED), 1).otherwise(0)


def _availability(seen: Column, level: Column) -> Column:
    worst = F.when(seen < len(SOURCES), 2).otherwise(level)
    return F.element_at(F.array(F.lit("ok"), F.lit("degraded"), F.lit("down")), worst + 1)


def availability(df: DataFrame, as_of: int, by: list[str], ts: str = "event_s", order: tuple[str, ...] = ("arrival_s", "event_id")) -> DataFrame:
    """Per key the worst source: seconds since its last recorded event against its limits; a source never seen is down."""
    last = df.groupBy(*by, "source").agg(F.max_by(ts, F.struct(*order)).alias("last"))
    out = last.groupBy(*by).agg(F.max(_silence(as_of - F.col("last"), F.col("source"))).alias("level"), F.count_if(F.col("source").isin(*SOURCES)).alias("seen"))
    return out.select(*by, _availability(F.col("seen"), F.col("level")).alias("availability"))


def quality_report(df: DataFrame, by: list[str], window: int = 300, baseline: int = 3600, as_of: Column | None = None, ts: str = "event_s", rate: float | None = None) -> DataFrame:
    """Availability, time integrity, volume, balance and anomaly frequency per key, in one aggregate.

    ``as_of`` defaults to the key column ``tick``; rows must cover the baseline window. Availability: the worst source's
    time since its last event against its limits, down where a source has none. Late share: above 0.15 critical, 0.05
    unstable. Volume against the baseline's (or against ``rate`` events a second, if given): under 0.30 low, above 3.00
    high. One source above 0.70: imbalanced. Anomalies at or above half: persistent. Any dimension off: degraded; critical
    time or availability down: critical.
    """
    tick = F.col("tick") if as_of is None else as_of
    recent = F.col(ts) >= tick - window
    each = df.groupBy(*by, "source").agg(F.max(ts).alias("last"), F.count_if(recent).alias("n"), F.count("*").alias("b"), F.count_if(recent & (F.col("guard_reason") == "late")).alias("late"), F.count_if(recent & F.col("anomalous")).alias("odd"))
    each = each.withColumn("level", _silence(tick - F.col("last"), F.col("source")))
    seen = F.count_if(F.col("source").isin(*SOURCES))
    out = each.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.sum("late").alias("late"), F.sum("odd").alias("odd"), F.max("n").alias("most"), F.max("level").alias("level"), seen.alias("seen"))
    share = lambda x: F.when(F.col("n") > 0, F.col(x) / F.col("n")).otherwise(0.0)
    ratio = F.col("n") / F.lit(rate * window) if rate else F.when(F.col("b") > 0, F.col("n") / (F.col("b") * F.lit(window / baseline))).otherwise(1.0)
    out = out.withColumns({
        "late_share": share("late"), "volume_ratio": ratio, "top_share": share("most"), "anomaly_share": share("odd"),
    }).withColumns({
        "availability": _availability(F.col("seen"), F.col("level")),
        "time_integrity": F.when(F.col("late_share") > 0.15, "critical").when(F.col("late_share") > 0.05, "unstable").otherwise("ok"),
        "volume": F.when(F.col("volume_ratio") < 0.30, "abnormally_low").when(F.col("volume_ratio") > 3.0, "abnormally_high").otherwise("normal"),
        "source_balance": F.when(F.col("top_share") > 0.70, "imbalanced").otherwise("normal"),
        "anomaly_frequency": F.when((F.col("n") > 0) & (F.col("anomaly_share") >= 0.5), "persistent").otherwise("normal"),
    })
    bad = (F.col("availability") != "ok") | (F.col("time_integrity") != "ok") | (F.col("volume") != "normal") | (F.col("source_balance") != "normal") | (F.col("anomaly_frequency") != "normal")
    return out.withColumn("overall", F.when((F.col("time_integrity") == "critical") | (F.col("availability") == "down"), "critical").when(bad, "degraded").otherwise("healthy")).drop("most", "level", "seen")


def worker_quality(metrics: DataFrame) -> DataFrame:
    """Per minute from counters (collected, dropped, inserted, max_lag, errors, max_source): the snapshot's statuses."""
    drop = F.col("dropped") / F.greatest(F.lit(1), F.col("collected"))
    return metrics.withColumns({
        "overall": F.when((F.col("collected") == 0) | (drop > 0.5), "degraded").otherwise("healthy"),
        "availability": F.when(F.col("collected") == 0, "down").when(drop > 0.5, "degraded").otherwise("ok"),
        "time_integrity": F.when(F.col("max_lag") > 120, "critical").when(F.col("max_lag") > 60, "unstable").otherwise("ok"),
        "volume": F.when(F.col("inserted") == 0, "abnormally_low").when(F.col("inserted") > 100, "abnormally_high").otherwise("normal"),
        "source_balance": F.when(F.col("max_source") > 3, "imbalanced").otherwise("normal"),
        "anomaly_frequency": F.when(F.col("errors") > 10, "persistent").otherwise("normal"),
    })


def drop_metrics(df: DataFrame, reason: str, by: tuple[str, ...] = ("source",)) -> DataFrame:
    """Rows by key and reason; a null reason is accepted."""
    return df.groupBy(*by, F.coalesce(F.col(reason), F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


def top_accounts(df: DataFrame, account: str, k: int) -> DataFrame:
    return df.groupBy(account).agg(F.count("*").alias("n")).orderBy(F.desc("n"), account).limit(k)


def evaluate_alerts(df: DataFrame) -> DataFrame:
    """One row per triggered alert: the eight rules over risk, quality and source status, with a details map."""
    text = lambda c: F.col(c).cast("string")

    def rule(when: Column, kind: str, source: Column, **details: Column) -> Column:
        pairs = [x for k, v in details.items() for x in (F.lit(k), v)]
        return F.when(when, F.struct(F.lit(kind).alias("alert_type"), source.alias("alert_source"), F.create_map(*pairs).alias("details")))

    none = F.lit(None).cast("string")
    rules = [
        rule(F.col("social_overheat"), "SOCIAL_OVERHEAT", none, velocity=text("velocity")),
        rule(F.col("panic_risk"), "PANIC_RISK", none, sentiment_label=text("label")),
        rule(F.col("fomo_risk"), "FOMO_RISK", none, sentiment_label=text("label")),
        rule(F.col("fear_greed_zone").isin("extreme_fear", "extreme_greed"), "EXTREME_MARKET_EMOTION", none, fear_greed_zone=text("fear_greed_zone")),
        rule(F.col("overall") == "degraded", "DATA_QUALITY_DEGRADED", none, overall=text("overall")),
        rule(F.col("overall") == "critical", "DATA_QUALITY_CRITICAL", none, overall=text("overall")),
        rule(F.col("status") == "delayed", "SOURCE_DELAY", F.col("source"), status=text("status")),
        rule(F.col("status") == "down", "SOURCE_DOWN", F.col("source"), status=text("status")),
    ]
    return df.withColumn("alert", F.explode(F.array_compact(F.array(*rules)))).select(*df.columns, "alert.*")


def format_alert(df: DataFrame) -> DataFrame:
    """Adds ``message``: the type, the asset, the details in order of name."""
    lines = F.transform(F.array_sort(F.map_keys("details")), lambda k: F.concat(k, F.lit(": "), F.coalesce(F.element_at("details", k), F.lit("n/a"))))
    return df.withColumn("message", F.concat_ws("\n", F.concat(F.lit("ALERT "), F.col("alert_type")), F.concat(F.lit("asset: "), F.col("asset")), F.array_join(lines, "\n")))
