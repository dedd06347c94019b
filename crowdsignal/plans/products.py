"""Queries of the aggregated products: signals, reports, context, quality, alerts, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import profiles as P
from ..operators import normalise, ordered, products, scoring, tables, validation
from ..sources import records
from .core import ID, SENT, scored_messages
from .inputs import messages, table, with_messages
from .ordered import _CASES, _REG, _REG_COLUMNS, GUARD, _last, guarded, registry
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
_SIGNAL = "count(*) AS total, count(*) FILTER (label = 1) AS bullish, count(*) FILTER (label = -1) AS bearish, count(*) FILTER (label = 0) AS neutral, round(avg(score), 6) AS avg_score, round(avg(weighted_score), 6) AS avg_weighted, round(avg(signal_strength), 6) AS avg_strength, CASE WHEN avg(weighted_score) > 0.1 THEN 'BULLISH' WHEN avg(weighted_score) < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal, count(*) / 30.0::DOUBLE AS velocity"


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


@register("ag1_signal", with_messages(f", {SENT}, n AS (SELECT max(event_s) AS t FROM m) SELECT asset, {_SIGNAL} FROM weighted, n WHERE event_s >= t - 1800 GROUP BY asset"))
def ag1(spark, sf_dir):
    m = scored_messages(spark, sf_dir)
    return _rounded(products.aggregate_signal(m, _last(messages(spark, sf_dir))), "avg_score", "avg_weighted", "avg_strength")


@register("str6_rolling_signal", with_messages(f", {SENT} SELECT asset, CAST(time_bucket(INTERVAL 30 MINUTE, ts) AS TIMESTAMP) AS window_start, {_SIGNAL} FROM weighted GROUP BY 1, 2"))
def str6(spark, sf_dir):
    out = products.rolling_signal(scored_messages(spark, sf_dir)).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
    return _rounded(out, "avg_score", "avg_weighted", "avg_strength")


@register("str5_sliding_counts", with_messages("SELECT asset, CAST(time_bucket(INTERVAL 60 SECOND, ts) - k * INTERVAL 60 SECOND AS TIMESTAMP) AS window_start, count(*) AS n FROM m, (SELECT unnest(range(5)) AS k) GROUP BY 1, 2"))
def str5(spark, sf_dir):
    w = F.window("ts", "300 seconds", "60 seconds").alias("w")
    return messages(spark, sf_dir).groupBy("asset", w).agg(F.count("*").alias("n")).select("asset", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


@register("ag2_sources_breakdown", with_messages(f", {SENT} SELECT asset, source, count(*) AS n, round(avg(weighted_score), 6) AS avg_score FROM weighted GROUP BY 1, 2"))
def ag2(spark, sf_dir):
    out = products.sources_breakdown(scored_messages(spark, sf_dir)).select("asset", F.explode("breakdown").alias("source", "v"))
    return out.select("asset", "source", F.col("v.count").alias("n"), F.round("v.avg_score", 6).alias("avg_score"))


@register("ag3_periodic_report", with_messages(f""", {SENT}, n AS (SELECT max(arrival_s) - 86400 AS t FROM m), q AS (SELECT *, CASE WHEN event_id % 8 = 0 THEN NULL ELSE score END AS sc FROM weighted, n WHERE arrival_s >= t)
 SELECT count(*) AS total_messages, count(*) AS analyzed, count(*) FILTER (label = 1) AS bullish, count(*) FILTER (label = -1) AS bearish, count(*) FILTER (label = 0) AS neutral, round(sum(sc) / count(*), 6) AS avg_score, round(sum(weighted_score) / count(*), 6) AS avg_weighted,
 CASE WHEN sum(weighted_score) / count(*) > 0.1 THEN 'BULLISH' WHEN sum(weighted_score) / count(*) < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal, round(least(1.0, abs(sum(weighted_score) / count(*)) * 2), 6) AS strength, count(*) / 30.0::DOUBLE AS velocity FROM q"""))
def ag3(spark, sf_dir):
    m = messages(spark, sf_dir)
    scores = scored_messages(spark, sf_dir).withColumn("score", F.when(F.col("event_id") % 8 != 0, F.col("score")))
    return _rounded(products.periodic_report(m, scores, _last(m, "arrival_s") - 86_400), "avg_score", "avg_weighted", "strength")


_CTX = f""", {SENT}, c AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN NULL ELSE confidence END AS sure FROM scored)"""


@register("ag4_context_sentiment", with_messages(_CTX + """, w AS (SELECT channel, sum(CASE WHEN label = -1 THEN source_reliability * coalesce(sure, 0.5) ELSE 0 END) AS d, sum(CASE WHEN label = 0 THEN source_reliability * coalesce(sure, 0.5) ELSE 0 END) AS f, sum(CASE WHEN label = 1 THEN source_reliability * coalesce(sure, 0.5) ELSE 0 END) AS u, avg(coalesce(sure, 0.5)) AS a FROM c GROUP BY channel)
 SELECT channel, CASE WHEN d >= f AND d >= u THEN -1 WHEN f >= u THEN 0 ELSE 1 END AS label, round(greatest(0.0, least(1.0, a)), 4) AS confidence FROM w"""))
def ag4(spark, sf_dir):
    m = scored_messages(spark, sf_dir).withColumn("confidence", F.when(F.col("event_id") % 9 != 0, F.col("confidence")))
    return products.context_sentiment(m, ["channel"])


@register("ag5_context_risk", with_messages(""", r AS (SELECT *, replies > 3 AS so, reposts = 6 AND replies = 4 AS pr, likes > 90 AS fo, (event_id % 101)::DOUBLE AS fg FROM m) SELECT channel, bool_or(so) AS social_overheat, bool_or(pr) AS panic_risk, bool_or(fo) AS fomo_risk, arg_max(fg, (event_s, event_id, replay)) AS fear_greed_index,
 CASE WHEN bool_or(so) OR bool_or(pr) THEN 'low' ELSE 'normal' END AS sentiment_reliability FROM r GROUP BY channel"""))
def ag5(spark, sf_dir):
    c = F.col
    m = messages(spark, sf_dir).withColumns({"social_overheat": c("replies") > 3, "panic_risk": (c("reposts") == 6) & (c("replies") == 4), "fomo_risk": c("likes") > 90, "fear_greed_index": (c("event_id") % 101).cast("double"), "fear_greed_zone": F.lit("normal"), "sentiment_reliability": F.lit("normal"), "tie": F.struct("event_id", "replay")})
    return products.context_risk(m, ["channel"], "event_s", "tie").drop("fear_greed_zone")


@register("ag6_context_quality", with_messages(""", q AS (SELECT *, CASE event_id % 50 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS o, CASE WHEN reposts > 2 THEN 'normal' ELSE 'abnormally_low' END AS v FROM m), k AS (SELECT channel, v, count(*) AS n FROM q GROUP BY 1, 2)
 SELECT channel, (SELECT CASE max(o) WHEN 2 THEN 'critical' WHEN 1 THEN 'degraded' ELSE 'healthy' END FROM q WHERE q.channel = x.channel) AS overall, (SELECT v FROM k WHERE k.channel = x.channel ORDER BY n DESC, v LIMIT 1) AS volume FROM (SELECT DISTINCT channel FROM m) AS x"""))
def ag6(spark, sf_dir):
    e = F.col("event_id") % 50
    m = messages(spark, sf_dir).withColumns({"overall": F.when(e == 0, "critical").when(e == 1, "degraded").otherwise("healthy"), "availability": F.lit("ok"), "time_integrity": F.lit("ok"), "volume": F.when(F.col("reposts") > 2, "normal").otherwise("abnormally_low"), "source_balance": F.lit("normal"), "anomaly_frequency": F.lit("normal")})
    return products.context_quality(m, ["channel"]).select("channel", "overall", "volume")


def requests(spark, sf_dir):
    """One request per asset and 600 seconds: the last 300, two or three of the sources."""
    m = messages(spark, sf_dir)
    slots = m.select("asset", F.floor(F.col("event_s") / 600).alias("slot")).distinct()
    three = F.when(F.col("slot") % 2 == 0, F.array(F.lit("twitter"), F.lit("reddit"))).otherwise(F.array(F.lit("twitter"), F.lit("reddit"), F.lit("telegram")))
    return slots.select(F.concat_ws("-", "asset", F.col("slot").cast("string")).alias("request_id"), "asset", (F.col("slot") * 600).alias("since"), (F.col("slot") * 600 + 300).alias("until"), three.alias("sources"))


AG7 = f""", {SENT}, q AS (SELECT DISTINCT asset, event_s // 600 - CASE WHEN event_s < 0 AND event_s % 600 <> 0 THEN 1 ELSE 0 END AS slot FROM m), r AS (SELECT asset || '-' || slot AS request_id, * FROM q),
 h AS (SELECT r.request_id, s.* FROM r JOIN scored s ON r.asset = s.asset AND s.event_s BETWEEN slot * 600 AND slot * 600 + 300 AND (source <> 'telegram' OR slot % 2 <> 0)),
 t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY event_s DESC, event_id DESC, replay DESC) AS n FROM h) WHERE n <= 1000),
 w AS (SELECT request_id, count(*) AS records, sum(CASE WHEN label = -1 THEN source_reliability * confidence ELSE 0 END) AS d, sum(CASE WHEN label = 0 THEN source_reliability * confidence ELSE 0 END) AS f, sum(CASE WHEN label = 1 THEN source_reliability * confidence ELSE 0 END) AS u,
  bool_or(likes / 15.0::DOUBLE > 5) AS social_overheat, bool_or(likes / 15.0::DOUBLE > 3) AS fomo_risk, max(CASE event_id % 50 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END) AS o, count(*) FILTER (reposts > 4) AS odd FROM t GROUP BY 1),
 ctx AS (SELECT r.request_id, coalesce(records, 0) AS records, CASE WHEN records IS NULL THEN NULL WHEN d >= f AND d >= u THEN -1 WHEN f >= u THEN 0 ELSE 1 END AS label, CASE WHEN records > 0 THEN 200 ELSE 204 END AS status, social_overheat, fomo_risk, CASE WHEN records IS NULL THEN NULL WHEN social_overheat THEN 'low' ELSE 'normal' END AS sentiment_reliability,
  CASE o WHEN 3 THEN 'critical' WHEN 2 THEN 'degraded' WHEN 1 THEN 'healthy' END AS overall, CASE WHEN records IS NULL THEN NULL WHEN odd >= records - odd THEN 'abnormally_high' ELSE 'normal' END AS volume FROM r LEFT JOIN w USING (request_id))"""


def contexts(spark, sf_dir):
    e = F.col("event_id") % 50
    m = scored_messages(spark, sf_dir).withColumns({"velocity": F.col("likes") / F.lit(15.0), "overall": F.when(e == 0, "critical").when(e == 1, "degraded").otherwise("healthy"), "volume": F.when(F.col("reposts") > 4, "abnormally_high").otherwise("normal")})
    return products.social_context(requests(spark, sf_dir), scoring.risk_indicators(m, "context"))


@register("ag7_social_context", with_messages(f"{AG7} SELECT * FROM ctx"))
def ag7(spark, sf_dir):
    """Sentiment, risk and quality of every request's window."""
    return contexts(spark, sf_dir).select("request_id", "records", "label", "status", "social_overheat", "fomo_risk", "sentiment_reliability", "overall", "volume")


@register("prj7_context_json", with_messages(f"{AG7} SELECT request_id, records, label, overall, social_overheat, split_part(request_id, '-', 1) AS asset FROM ctx WHERE records > 0"))
def prj7_context(spark, sf_dir):
    """The answers as nested JSON, read back."""
    found = contexts(spark, sf_dir).where("records > 0").join(requests(spark, sf_dir).select("request_id", "asset", "since", "until"), "request_id")
    get = lambda path, kind="string": F.get_json_object("output", f"$.{path}").cast(kind)
    return normalise.as_output(found, "context").select("request_id", get("social_context.record_count", "long").alias("records"), get("social_context.sentiment.label", "int").alias("label"), get("social_context.data_quality.overall").alias("overall"), get("social_context.risk_indicators.social_overheat", "boolean").alias("social_overheat"), get("asset").alias("asset"))


@register("fil14_context_requests", with_messages(", q AS (SELECT DISTINCT asset, event_s // 600 - CASE WHEN event_s < 0 AND event_s % 600 <> 0 THEN 1 ELSE 0 END AS slot FROM m), r AS (SELECT asset || '-' || slot AS request_id, slot, (slot % 7) * 60 - 60 AS len FROM q) SELECT request_id, CASE WHEN slot % 5 = 0 THEN 'unknown_source' WHEN len <= 0 THEN 'empty_window' WHEN len < 30 THEN 'window_too_short' WHEN len > 300 THEN 'window_too_long' END AS request_error FROM r"))
def fil14(spark, sf_dir):
    r = requests(spark, sf_dir).withColumn("slot", F.floor(F.col("since") / 600))
    r = r.withColumns({"until": F.col("since") + (F.col("slot") % 7) * 60 - 60, "sources": F.when(F.col("slot") % 5 == 0, F.array(F.lit("forum"))).otherwise(F.col("sources"))})
    return validation.validate_context_requests(r).select("request_id", "request_error")


@register("ag8_availability", with_messages(f""", n AS (SELECT max(event_s) + 100 AS t FROM m), l AS (SELECT channel, source, arg_max(event_s, (arrival_s, event_id)) AS s FROM m WHERE NOT (channel = 'ch1' AND source = 'reddit') GROUP BY 1, 2),
 v AS (SELECT channel, CASE WHEN t - s >= CASE source WHEN 'twitter' THEN 300 WHEN 'reddit' THEN 3600 ELSE 600 END THEN 2 WHEN t - s >= CASE source WHEN 'twitter' THEN 60 WHEN 'reddit' THEN 900 ELSE 120 END THEN 1 ELSE 0 END AS lv FROM l, n)
 SELECT channel, CASE WHEN count(*) < 3 THEN 'down' WHEN max(lv) = 2 THEN 'down' WHEN max(lv) = 1 THEN 'degraded' ELSE 'ok' END AS availability FROM v GROUP BY channel"""))
def ag8(spark, sf_dir):
    m = messages(spark, sf_dir)
    return products.availability(m.where("NOT (channel = 'ch1' AND source = 'reddit')"), _last(m) + 100, ["channel"])


@register("ag13_quality_report", with_messages(f""", {GUARD}, k AS (SELECT *, unnest(range(CAST(ceil(event_s / 600.0) * 600 AS BIGINT), CAST(floor((event_s + 3600) / 600.0) * 600 AS BIGINT) + 1, 600)) AS tick FROM guarded),
 e AS (SELECT asset, tick, source, CASE WHEN tick - max(event_s) >= {_CASES(P.AVAILABILITY_DOWN)} THEN 2 WHEN tick - max(event_s) >= {_CASES(P.AVAILABILITY_DEGRADED)} THEN 1 ELSE 0 END AS lv, count(*) FILTER (event_s >= tick - 300) AS n, count(*) AS b, count(*) FILTER (event_s >= tick - 300 AND guard_reason = 'late') AS late, count(*) FILTER (event_s >= tick - 300 AND replies > 2) AS odd FROM k GROUP BY 1, 2, 3),
 s AS (SELECT asset, tick, CAST(sum(n) AS BIGINT) AS n, CAST(sum(b) AS BIGINT) AS b, CAST(sum(late) AS BIGINT) AS late, CAST(sum(odd) AS BIGINT) AS odd, max(n) AS most, CASE WHEN count(*) < 3 OR max(lv) = 2 THEN 'down' WHEN max(lv) = 1 THEN 'degraded' ELSE 'ok' END AS availability FROM e GROUP BY 1, 2),
 f AS (SELECT *, CASE WHEN n > 0 THEN late / n::DOUBLE ELSE 0.0 END AS ls, CASE WHEN b > 0 THEN n / (b * (300 / 3600.0::DOUBLE)) ELSE 1.0 END AS vr, CASE WHEN n > 0 THEN most / n::DOUBLE ELSE 0.0 END AS tp, CASE WHEN n > 0 THEN odd / n::DOUBLE ELSE 0.0 END AS an FROM s),
 d AS (SELECT *, CASE WHEN ls > 0.15 THEN 'critical' WHEN ls > 0.05 THEN 'unstable' ELSE 'ok' END AS time_integrity, CASE WHEN vr < 0.30 THEN 'abnormally_low' WHEN vr > 3.0 THEN 'abnormally_high' ELSE 'normal' END AS volume, CASE WHEN tp > 0.70 THEN 'imbalanced' ELSE 'normal' END AS source_balance, CASE WHEN n > 0 AND an >= 0.5 THEN 'persistent' ELSE 'normal' END AS anomaly_frequency FROM f)
 SELECT asset, tick, n, b, late, odd, availability, time_integrity, volume, source_balance, anomaly_frequency, CASE WHEN time_integrity = 'critical' OR availability = 'down' THEN 'critical' WHEN availability <> 'ok' OR time_integrity <> 'ok' OR volume <> 'normal' OR source_balance <> 'normal' OR anomaly_frequency <> 'normal' THEN 'degraded' ELSE 'healthy' END AS overall FROM d"""))
def ag13(spark, sf_dir):
    """Availability, time, volume, balance and anomaly (AG-8 to AG-13) for every ten-minute tick and asset."""
    g = guarded(spark, sf_dir).withColumn("anomalous", F.col("replies") > 2)
    out = products.quality_report(products.ticks(g, 600, 3600), ["asset", "tick"])
    return out.select("asset", "tick", "n", "b", "late", "odd", "availability", "time_integrity", "volume", "source_balance", "anomaly_frequency", "overall")


@register("jn11_ticks", with_messages(", k AS (SELECT *, unnest(range(CAST(ceil(event_s / 300.0) * 300 AS BIGINT), CAST(floor((event_s + 600) / 300.0) * 300 AS BIGINT) + 1, 300)) AS tick FROM m) SELECT channel, tick, count(*) AS n FROM k GROUP BY 1, 2"))
def jn11(spark, sf_dir):
    return products.ticks(messages(spark, sf_dir), 300, 600).groupBy("channel", "tick").agg(F.count("*").alias("n"))


@register("ag15_worker_quality", with_messages(f""", {GUARD}, c AS (SELECT arrival_s // 3600 AS hour, source, count(*) AS c, count(guard_reason) AS d, count(*) - count(guard_reason) AS i, max(arrival_s - event_s) AS lag FROM guarded GROUP BY 1, 2),
 x AS (SELECT hour, CAST(sum(c) AS BIGINT) AS collected, CAST(sum(d) AS BIGINT) AS dropped, CAST(sum(i) AS BIGINT) AS inserted, max(lag) AS max_lag, max(i) AS max_source FROM c GROUP BY hour)
 SELECT hour, collected, dropped, inserted, CASE WHEN dropped / greatest(1, collected)::DOUBLE > 0.5 THEN 'degraded' ELSE 'healthy' END AS overall, CASE WHEN max_lag > 120 THEN 'critical' WHEN max_lag > 60 THEN 'unstable' ELSE 'ok' END AS time_integrity, CASE WHEN inserted = 0 THEN 'abnormally_low' WHEN inserted > 100 THEN 'abnormally_high' ELSE 'normal' END AS volume, CASE WHEN max_source > 3 THEN 'imbalanced' ELSE 'normal' END AS source_balance FROM x"""))
def ag15(spark, sf_dir):
    g = guarded(spark, sf_dir).withColumn("hour", F.floor(F.col("arrival_s") / 3600))
    each = g.groupBy("hour", "source").agg(F.count("*").alias("c"), F.count("guard_reason").alias("d"), F.max(F.col("arrival_s") - F.col("event_s")).alias("lag"))
    metrics = each.groupBy("hour").agg(F.sum("c").alias("collected"), F.sum("d").alias("dropped"), F.sum(F.col("c") - F.col("d")).alias("inserted"), F.max("lag").alias("max_lag"), F.max(F.col("c") - F.col("d")).alias("max_source"), F.lit(0).alias("errors"))
    return products.worker_quality(metrics).select("hour", "collected", "dropped", "inserted", "overall", "time_integrity", "volume", "source_balance")


@register("ag16_ingest_lag", with_messages(f", {GUARD}, n AS (SELECT max(arrival_s) AS t FROM m) SELECT source, max(t) - max(event_s) AS lag FROM guarded, n WHERE guard_reason IS NULL GROUP BY source"))
def ag16(spark, sf_dir):
    g = guarded(spark, sf_dir)
    return g.where("guard_reason IS NULL").groupBy("source").agg((F.lit(_last(messages(spark, sf_dir), "arrival_s")) - F.max("event_s")).alias("lag"))


@register("ag17_top_accounts", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def ag17(spark, sf_dir):
    return products.top_accounts(table(spark, sf_dir, "events"), "user_id", 10)


@register("ag18_channel_span", with_messages("SELECT channel, count(*) AS n, min(event_s) AS first, max(event_s) AS last FROM m GROUP BY channel"))
def ag18(spark, sf_dir):
    return messages(spark, sf_dir).groupBy("channel").agg(F.count("*").alias("n"), F.min("event_s").alias("first"), F.max("event_s").alias("last"))


_LIVE = f", reg AS (SELECT * FROM {_REG} AS {_REG_COLUMNS}), act AS (SELECT reg.*, count(message_id) AS posts FROM reg LEFT JOIN m ON lower(source_id) = channel GROUP BY ALL)"


def _live(spark, sf_dir):
    """The registry with each source's number of posts."""
    posts = messages(spark, sf_dir).groupBy(F.upper("channel").alias("c")).agg(F.count("*").alias("p"))
    reg = registry(spark)
    return reg.join(posts, reg.source_id == posts.c, "left").withColumn("posts", F.coalesce("p", F.lit(0))).drop("c", "p")


@register("ag19_sources_by_role", with_messages(_LIVE + " SELECT role, count(*) AS n, string_agg(source_id, ', ' ORDER BY registry_priority DESC, source_id) AS names FROM act WHERE enabled AND posts > 0 GROUP BY role"))
def ag19(spark, sf_dir):
    return tables.sources_by_role(_live(spark, sf_dir).where("posts > 0"))


@register("ag20_status_summary", with_messages(_LIVE + " SELECT coalesce(status, 'unknown') AS status, count(*) AS n FROM act WHERE posts > 0 GROUP BY 1"))
def ag20(spark, sf_dir):
    return tables.status_summary(_live(spark, sf_dir).where("posts > 0"))


@register("jn10_eligible_channels", with_messages(_LIVE + " SELECT source_id, posts FROM act WHERE enabled AND (status IS NULL OR status IN ('alive', 'unknown'))"))
def jn10(spark, sf_dir):
    return tables.eligible_channels(_live(spark, sf_dir)).select("source_id", "posts")


@register("jn12_thresholds", with_messages(_LIVE + " SELECT source_id, posts, CASE type WHEN 'whale' THEN 12 WHEN 'price' THEN 12 WHEN 'community' THEN 48 ELSE 24 END AS hours FROM act"))
def jn12(spark, sf_dir):
    return _live(spark, sf_dir).select("source_id", "posts", tables.activity_hours(F.col("type")).alias("hours"))


@register("jn9_resolve_channel", with_messages(_LIVE + ", w AS (SELECT event_id, replay, CASE event_id % 4 WHEN 0 THEN 'ch0' WHEN 1 THEN 'whale' WHEN 2 THEN 'ch' ELSE 'nobody' END AS wanted FROM m) SELECT event_id, replay, CASE wanted WHEN 'ch0' THEN 'CH0' WHEN 'whale' THEN 'CH1' WHEN 'ch' THEN 'CH0' END AS resolved FROM w"))
def jn9(spark, sf_dir):
    n = F.col("event_id") % 4
    wanted = F.when(n == 0, "ch0").when(n == 1, "whale").when(n == 2, "ch").otherwise("nobody")
    return tables.resolve_channel(messages(spark, sf_dir).withColumn("wanted", wanted), registry(spark)).select(*ID, "resolved")


@register("ag22_run_metrics", with_messages(f", {GUARD} SELECT source, count(*) AS received, count(*) FILTER (guard_reason IS NULL) AS passed, count(*) FILTER (guard_reason = 'late') AS late, count(*) FILTER (guard_reason = 'duplicate') AS duplicate FROM guarded GROUP BY source"))
def ag22(spark, sf_dir):
    r = F.col("guard_reason")
    return guarded(spark, sf_dir).groupBy("source").agg(F.count("*").alias("received"), F.count_if(r.isNull()).alias("passed"), F.count_if(r == "late").alias("late"), F.count_if(r == "duplicate").alias("duplicate"))


@register("al1_alerts", with_messages(""", a AS (SELECT *, replies > 3 AS so, event_id % 100 AS fg FROM m) SELECT event_id, replay, 'SOCIAL_OVERHEAT' AS alert_type FROM a WHERE so UNION ALL SELECT event_id, replay, 'EXTREME_MARKET_EMOTION' FROM a WHERE fg <= 20 OR fg >= 80
 UNION ALL SELECT event_id, replay, 'DATA_QUALITY_DEGRADED' FROM a WHERE event_id % 5 = 1 UNION ALL SELECT event_id, replay, 'DATA_QUALITY_CRITICAL' FROM a WHERE event_id % 5 = 2 UNION ALL SELECT event_id, replay, 'SOURCE_DELAY' FROM a WHERE reposts = 1 UNION ALL SELECT event_id, replay, 'SOURCE_DOWN' FROM a WHERE reposts = 2"""))
def al1(spark, sf_dir):
    return alerts(spark, sf_dir).select(*ID, "alert_type")


def alerts(spark, sf_dir):
    c = F.col
    m = messages(spark, sf_dir).withColumns({"social_overheat": c("replies") > 3, "panic_risk": F.lit(False), "fomo_risk": F.lit(None).cast("boolean"), "label": F.lit(0), "velocity": c("replies").cast("double"), "fear_greed_zone": scoring.zone(c("event_id") % 100), "overall": F.when(c("event_id") % 5 == 1, "degraded").when(c("event_id") % 5 == 2, "critical"), "status": F.when(c("reposts") == 1, "delayed").when(c("reposts") == 2, "down")})
    return products.evaluate_alerts(m)


@register("al3_alert_text", with_messages("SELECT event_id, replay, 'ALERT SOURCE_DOWN' || chr(10) || 'asset: ' || asset || chr(10) || 'status: down' AS message FROM m WHERE reposts = 2"))
def al3(spark, sf_dir):
    return products.format_alert(alerts(spark, sf_dir).where("alert_type = 'SOURCE_DOWN'")).select(*ID, "message")


@register("so1_sort_by_time", with_messages("SELECT event_id, replay, row_number() OVER (ORDER BY event_s NULLS FIRST, event_id, replay) AS place FROM m"))
def so1(spark, sf_dir):
    """Every message's place by time."""
    return ordered.with_places(messages(spark, sf_dir)).select(*ID, "place")


@register("so1_sort_whole", with_messages("SELECT event_id, replay, event_s FROM m ORDER BY event_s NULLS FIRST, event_id, replay"))
def so1_whole(spark, sf_dir):
    """All messages in order."""
    return ordered.sort_by_event_time(messages(spark, sf_dir).select(*ID, "event_s"))


@register("ac2_keyword_index", "SELECT n_name AS keyword, r_name AS symbol FROM nation JOIN region ON n_regionkey = r_regionkey")
def ac2(spark, sf_dir):
    """Nations as keywords of their region: the catalog's index."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    catalog = n.join(r, n.n_regionkey == r.r_regionkey).groupBy(F.col("r_name").alias("symbol")).agg(F.collect_list("n_name").alias("keywords"), F.lit(True).alias("is_active"), F.max("r_regionkey").alias("priority"))
    return tables.keyword_index(catalog).select(F.upper("keyword").alias("keyword"), "symbol")


@register("src5_flatten_thread", "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS depth, role AS author, md5(text) AS body FROM conversations")
def src5(spark, sf_dir):
    """Each conversation as a thread in which every turn answers the one before, flattened again."""
    found = records.flatten_thread(records.as_thread(table(spark, sf_dir, "conversations")), "thread", "conv_id")
    return found.select("conv_id", "depth", "author", F.md5("body").alias("body"))


@register("src4_tweet_json", with_messages("SELECT event_id, replay, message_id AS tweet_id, CASE WHEN event_id % 2 = 0 THEN 'RT @' || text ELSE text END AS text, likes, event_id % 2 = 0 AS is_retweet FROM m"))
def src4(spark, sf_dir):
    c = F.col
    text = F.when(c("event_id") % 2 == 0, F.concat(F.lit("RT @"), "text")).otherwise(c("text"))
    spelt = F.when(c("event_id") % 3 == 0, F.to_json(F.struct(c("message_id").alias("id_str"), text.alias("full_text"), c("likes").alias("favorite_count")))).otherwise(F.to_json(F.struct(c("message_id").alias("id"), text.alias("text"), c("likes").alias("favorite_count"))))
    return messages(spark, sf_dir).withColumn("t", records.parse_tweet_json(spelt)).select(*ID, "t.tweet_id", "t.text", "t.likes", "t.is_retweet")


@register("src6_flatten_listing", "SELECT conv_id, turn AS score, role AS author FROM conversations")
def src6(spark, sf_dir):
    """Each conversation as a listing of posts, taken apart again."""
    child = F.struct(F.lit("t3").alias("kind"), F.struct(F.col("role").alias("author"), F.col("turn").alias("score")).alias("data"))
    whole = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.collect_list(child).alias("children")).alias("data"))).alias("listing"))
    return records.flatten_listing(whole, "listing", "author: string, score: long")


@register("src3_harvest_pages", r"SELECT page_id, CAST(len(regexp_extract_all(html, '<a href=.([^>]*).>')) AS BIGINT) AS links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def src3(spark, sf_dir):
    found = records.harvest_pages(table(spark, sf_dir, "pages"), [r'<a href="([^"]*)">', r"<b>([^<]*)</b>"])
    return found.select("page_id", F.size("harvested").cast("long").alias("links"), F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


@register("js1_json_fields", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def js1(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@register("src8_pipeline_events", with_messages("SELECT event_id, replay, CASE source WHEN 'twitter' THEN 'tw_' || message_id WHEN 'reddit' THEN 'reddit_' || message_id ELSE 'tg_' || channel || '_' || message_id END AS pipeline_id FROM m"))
def src8(spark, sf_dir):
    return records.to_pipeline_event(messages(spark, sf_dir)).select(*ID, "pipeline_id")


@register("src7_union_sources", with_messages("SELECT source, count(*) AS n FROM m WHERE source <> 'telegram' GROUP BY source"))
def src7(spark, sf_dir):
    """Three loaders, one of which fails: its rows are missing, the others' whole."""
    m = messages(spark, sf_dir)

    def broken():
        raise OSError("source is away")

    df, _ = records.union_sources(spark, {"twitter": lambda: m.where("source = 'twitter'"), "reddit": lambda: m.where("source = 'reddit'"), "telegram": broken})
    return df.groupBy("source").agg(F.count("*").alias("n"))
