"""Queries of stored and replayed events, scraped and enriched records, and small column operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import profiles as P
from ..operators import normalise, products, scoring, tables, validation
from ..sources import records
from .core import ID, SENT, _subs, _tokens, scored_messages
from .inputs import messages, scratch, table, with_messages
from .ordered import ORACLES as ORDERED
from .ordered import _last, registry
from .products import _LIVE, _live, alerts
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register("snk2_append_events", with_messages(f", {SENT} SELECT event_id, replay, label FROM scored WHERE event_s BETWEEN 100 AND 100000"))
def snk2(spark, sf_dir):
    """Scores appended in two batches to a table by day, and a range of it read again."""
    path = scratch(spark, "events")
    scores = scored_messages(spark, sf_dir).select(*ID, "event_s", "label")
    for part in ("event_id % 2 = 0", "event_id % 2 = 1"):
        tables.append_events(scores.where(part), path)
    return tables.read_table(spark, path, 100, 100_000).where("event_s BETWEEN 100 AND 100000").select(*ID, "label")


@register("snk7_write_json", with_messages(f", {SENT} SELECT event_id, replay, label, round(score, 6) AS score FROM scored"))
def snk7(spark, sf_dir):
    path = scratch(spark, "json")
    tables.write_json(scored_messages(spark, sf_dir).select(*ID, "label", F.round("score", 6).alias("score")), path)
    return spark.read.schema("event_id bigint, replay int, label int, score double").json(path)


@register("src1_read_records", with_messages("SELECT source, asset, count(*) AS n, CAST(sum(likes) AS BIGINT) AS likes, max(followers) AS followers FROM m GROUP BY 1, 2"))
def src1(spark, sf_dir):
    """Messages written as files of JSON arrays, about a thousand records each, and read again."""
    c = F.col
    one = F.struct("source", "asset", "text", C.format_ts(c("ts")).alias("timestamp"), F.struct(c("likes").alias("like"), c("replies").alias("reply"), c("reposts").alias("share")).alias("engagement"), F.struct(c("followers"), F.lit(0.5).alias("reputation_score")).alias("author"))
    path = scratch(spark, "records")
    arrays = messages(spark, sf_dir).groupBy(F.floor(c("event_id") / 1000)).agg(F.to_json(F.collect_list(one)).alias("value")).select("value")
    arrays.write.option("maxRecordsPerFile", 1).text(path)
    found = records.read_records(spark, path)
    return found.groupBy("source", "asset").agg(F.count("*").alias("n"), F.sum("engagement.like").alias("likes"), F.max("author.followers").alias("followers"))


@register("src3_embedded_records", with_messages("""SELECT event_id, replay, CASE WHEN event_id % 3 = 0 THEN 'state' WHEN event_id % 3 = 1 THEN 'records' WHEN length(text) >= 20 THEN 'texts' END AS tier,
 CASE WHEN event_id % 3 < 2 OR length(text) >= 20 THEN text END AS text, CASE WHEN event_id % 3 < 2 THEN message_id_n WHEN length(text) >= 20 THEN 'syn_' || channel || '_0' END AS tweet_id, CASE WHEN event_id % 3 < 2 THEN likes WHEN length(text) >= 20 THEN 0 END AS likes FROM (SELECT *, CAST(event_id AS VARCHAR) AS message_id_n FROM m)"""))
def src3_embedded(spark, sf_dir):
    """Each message inside a page: in its embedded state, as a single record, or as a bare text."""
    c = F.col
    tweet = F.to_json(F.struct(c("event_id").cast("string").alias("id_str"), "text", c("likes").alias("favorite_count"), c("reposts").alias("retweet_count")))
    state = F.concat(F.lit('<script>window.__INITIAL_STATE__ = {"timeline":{"entries":[{"content":{"tweet":'), tweet, F.lit("}},{\"content\":{}}]}};</script>"))
    n = c("event_id") % 3
    html = F.when(n == 0, state).when(n == 1, F.concat(F.lit("<p>"), tweet, F.lit("</p>"))).otherwise(F.concat(F.lit('<i>{"text":"'), c("text"), F.lit('"}</i>')))
    found = records.harvest_records(messages(spark, sf_dir).withColumn("html", html), name_col="channel")
    first = F.get("records", F.lit(0))
    return found.select(*ID, "tier", first["text"].alias("text"), first["tweet_id"].alias("tweet_id"), first["likes"].alias("likes"))


@register("snk5_risk_rows", with_messages("SELECT event_id, replay, CASE WHEN event_id % 4 = 0 THEN 'BTC' ELSE asset END AS asset, CASE WHEN event_id % 3 = 0 THEN 'unknown' ELSE 'normal' END AS fear_greed_zone, event_id % 5 = 1 AS panic_risk, 'healthy' AS data_quality_overall, 'normal' AS sentiment_reliability FROM m"))
def snk5_risk(spark, sf_dir):
    e = F.col("event_id")
    m = messages(spark, sf_dir).withColumns({"asset": F.when(e % 4 != 0, F.col("asset")), "fear_greed_zone": F.when(e % 3 != 0, "normal"), "panic_risk": F.when(e % 5 < 2, e % 5 == 1)})
    return tables.prepare_risk_rows(m).select(*ID, "asset", "fear_greed_zone", "panic_risk", "data_quality_overall", "sentiment_reliability")


@register("snk5_quality_rows", with_messages("SELECT event_id, replay, source AS source_type, CASE WHEN event_id % 4 = 1 THEN 'down' ELSE 'ok' END AS availability, 'healthy' AS overall, '{\"likes\":' || likes || ',\"replies\":' || replies || '}' AS metrics_detail FROM m"))
def snk5_quality(spark, sf_dir):
    m = messages(spark, sf_dir).withColumns({"source_type": F.col("source"), "availability": F.when(F.col("event_id") % 4 == 1, "down")})
    return tables.prepare_quality_rows(m, ("likes", "replies")).select(*ID, "source_type", "availability", "overall", "metrics_detail")


@register("snk10_alert_history", with_messages("SELECT asset, 'SOURCE_DOWN' AS alert_type, 'ALERT SOURCE_DOWN' || chr(10) || 'asset: ' || asset || chr(10) || 'status: down' AS message, CASE WHEN event_id % 2 = 0 THEN message_id END AS message_id, event_id % 2 = 0 AS success FROM m WHERE reposts = 2"))
def snk10(spark, sf_dir):
    a = products.format_alert(alerts(spark, sf_dir).where("alert_type = 'SOURCE_DOWN'"))
    return tables.alert_history_rows(a.withColumn("sent_id", F.when(F.col("event_id") % 2 == 0, F.col("message_id"))))


@register("so3_replay_scores", with_messages(f", {SENT} SELECT event_id, replay, label FROM scored WHERE asset = 'BTC' AND event_s BETWEEN 1000 AND 500000"))
def so3(spark, sf_dir):
    return tables.replay(scored_messages(spark, sf_dir), 1000, 500_000, "BTC", order=("event_id", "replay")).select(*ID, "label")


@register("so4_enabled_sources", with_messages(_LIVE + " SELECT source_id, type, posts FROM act WHERE enabled AND role = 'primary'"))
def so4(spark, sf_dir):
    return tables.enabled_sources(_live(spark, sf_dir), role="primary").select("source_id", "type", "posts")


@register("ag23_health_summary", f"SELECT status, count(*) AS n, count(*) FILTER (status = 'dead' OR (status = 'error' AND error_count >= 3)) AS disabled FROM ({ORDERED['hl1_channel_health']}) GROUP BY status")
def ag23(spark, sf_dir):
    m = messages(spark, sf_dir)
    reg = registry(spark).withColumn("observed", F.when(F.col("source_id") == "CH3", "dead").when(F.col("source_id") == "CH2", "error"))
    health = tables.channel_health(reg, m.withColumn("channel", F.upper("channel")), _last(m) + 44_000)
    return tables.health_run_summary(tables.apply_health(health))


_GONE = "CASE event_id % 10 WHEN 0 THEN '[deleted]' WHEN 1 THEN NULL ELSE 'someone' END AS author, CASE WHEN event_id % 7 = 0 THEN '[removed]' WHEN event_id % 11 = 0 THEN ' ' ELSE text END AS body"


@register("fil7_reddit_comment", with_messages(f"SELECT event_id, replay, CASE WHEN author IS NULL OR author = '[deleted]' THEN 'author_deleted' WHEN trim(body) = '' THEN 'missing_text' WHEN body = '[removed]' THEN 'text_removed' WHEN NOT contains(body, 'moon') THEN 'no_asset' END AS drop_reason FROM (SELECT *, {_GONE} FROM m)"))
def fil7(spark, sf_dir):
    e = F.col("event_id")
    m = messages(spark, sf_dir).withColumns({"author": F.when(e % 10 == 0, "[deleted]").when(e % 10 != 1, "someone"), "text": F.when(e % 7 == 0, "[removed]").when(e % 11 == 0, " ").otherwise(F.col("text"))})
    return validation.validate_comment(m, F.contains("text", F.lit("moon"))).select(*ID, "drop_reason")


@register("prj3_reddit_comment", with_messages("SELECT event_id, replay, text, round(ln(1 + likes + greatest(1, reposts)), 6) AS engagement_weight, round(ln(1 + followers), 6) AS author_weight FROM m"))
def prj3(spark, sf_dir):
    c = F.col
    m = messages(spark, sf_dir).withColumns({"velocity": F.lit(1.0), "title": F.lit(None).cast("string"), "score": c("likes"), "comments": F.lit(None).cast("bigint"), "depth": c("reposts"), "karma": c("followers")})
    return normalise.normalize(m, "reddit").select(*ID, "record.text", F.round("record.metrics.engagement_weight", 6).alias("engagement_weight"), F.round("record.metrics.author_weight", 6).alias("author_weight"))


@register("prj5_scraped_tweets", with_messages("SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, message_id AS tweet_id, substr(sha256(message_id || ':' || substr(text, 1, 100)), 1, 16) AS fingerprint, likes + reposts + replies AS total_engagement, round(ln(1 + likes + 2 * reposts + replies), 6) AS engagement_weight FROM m WHERE event_id % 8 <> 0"))
def prj5(spark, sf_dir):
    c = F.col
    m = messages(spark, sf_dir).withColumns({"message_id": F.when(c("event_id") % 8 != 0, c("message_id")).when(c("event_id") % 16 == 0, ""), "username": c("channel"), "posted_at": c("ts"), "velocity": F.lit(1.0), "is_retweet": F.lit(False)})
    return normalise.normalize_scraped(m).select("timestamp", "metadata.tweet_id", "fingerprint", "metadata.total_engagement", F.round("engagement_weight", 6).alias("engagement_weight"))


@register("prj8_enrich", with_messages(f", {SENT} SELECT event_id, replay, text, source, label, round(score, 6) AS score, label = -1 AND replies >= 2 AS panic_risk, 'normal' AS fear_greed_zone FROM scored"))
def prj8(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("velocity", F.col("replies").cast("double"))
    return scoring.enrich(m).select(*ID, "text", "source", "label", F.round("score", 6).alias("score"), "panic_risk", "fear_greed_zone")


@register("ud1_own_analyser", with_messages("SELECT event_id, replay, text, CASE WHEN contains(text, 'moon') THEN 1 ELSE 0 END AS label, FALSE AS panic_risk FROM m"))
def ud1(spark, sf_dir):
    """An analyser of the caller's own in place of the lexicon; the columns that came in stay as they were."""
    own = lambda d: d.withColumns({"label": F.contains("text", F.lit("moon")).cast("int"), "confidence": F.lit(1.0), "text": F.upper("text")})
    return scoring.enrich(messages(spark, sf_dir), own, lambda d: scoring.risk_indicators(d, "orchestrated")).select(*ID, "text", "label", "panic_risk")


@register("vl8_events_per_minute", with_messages("SELECT channel, arrival_s // 3600 AS hour, count(*) / 3600.0::DOUBLE * 60.0 AS per_minute FROM m GROUP BY 1, 2"))
def vl8(spark, sf_dir):
    n = messages(spark, sf_dir).groupBy("channel", F.floor(F.col("arrival_s") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    return n.select("channel", "hour", C.events_per_minute(F.col("n"), 3600.0).alias("per_minute"))


_MINUTE = "CASE event_id % 3 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('minute', ts) + INTERVAL 500 MILLISECOND ELSE ts END"


@register("ts4_has_seconds", f"SELECT event_id, epoch_us({_MINUTE}) % 60000000 <> 0 AS fine FROM events")
def ts4(spark, sf_dir):
    n = F.col("event_id") % 3
    t = F.when(n == 0, F.date_trunc("minute", "ts")).when(n == 1, F.timestamp_add("MILLISECOND", F.lit(500), F.date_trunc("minute", "ts"))).otherwise(F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", C.has_seconds(t).alias("fine"))


@register("fp2_worker_fingerprint", with_messages(f"SELECT event_id, replay, substr(sha256(source || '|' || text || '|' || strftime(t, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(t) % 1000000 <> 0 THEN strftime(t, '.%f') ELSE '' END || '+00:00'), 1, 32) AS fingerprint FROM (SELECT *, {_MINUTE} AS t FROM m)"))
def fp2(spark, sf_dir):
    n = F.col("event_id") % 3
    t = F.when(n == 0, F.date_trunc("minute", "ts")).when(n == 1, F.timestamp_add("MILLISECOND", F.lit(500), F.date_trunc("minute", "ts"))).otherwise(F.col("ts"))
    return messages(spark, sf_dir).select(*ID, C.fingerprint("worker", source=F.col("source"), text=F.col("text"), event_time=t).alias("fingerprint"))


@register("fp9_alert_fingerprint", with_messages("SELECT event_id, replay, substr(sha256('SOCIAL_OVERHEAT|' || asset || '|none'), 1, 16) AS fingerprint FROM m WHERE replies > 3 UNION ALL SELECT event_id, replay, substr(sha256('SOURCE_DOWN|' || asset || '|' || source), 1, 16) FROM m WHERE reposts = 2"))
def fp9(spark, sf_dir):
    a = alerts(spark, sf_dir).where("alert_type IN ('SOCIAL_OVERHEAT', 'SOURCE_DOWN')")
    return a.select(*ID, C.fingerprint("alert", alert_type=F.col("alert_type"), asset=F.col("asset"), source=F.col("alert_source")).alias("fingerprint"))


# ---- sentiment and rules over whole documents ----------------------------------------------------------------------


@register("sn2_documents", f"SELECT doc_id, {_tokens(P.TOKENS['bullish'])} AS bullish_count, {_tokens(P.TOKENS['bearish'])} AS bearish_count FROM documents")
def sn2_documents(spark, sf_dir):
    return scoring.sentiment(table(spark, sf_dir, "documents"), "tokens").select("doc_id", "bullish_count", "bearish_count")


@register("sn3_documents", f"SELECT doc_id, CAST({_subs(P.SUBSTRINGS['bullish'])} AS BIGINT) AS bullish_count, CAST({_subs(P.SUBSTRINGS['bearish'])} AS BIGINT) AS bearish_count FROM documents")
def sn3_documents(spark, sf_dir):
    return scoring.sentiment(table(spark, sf_dir, "documents"), "substring").select("doc_id", "bullish_count", "bearish_count")


@register("fil12_documents", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 'Missing text content' WHEN NOT (contains(lower(text), 'the') OR contains(lower(text), 'token')) THEN 'No keyword match' END AS drop_reason FROM documents")
def fil12_documents(spark, sf_dir):
    return validation.validate_raw(table(spark, sf_dir, "documents").withColumn("event_s", F.col("doc_id")), ("the", "token")).select("doc_id", "drop_reason")


@register("mn1_documents", "SELECT doc_id, row_number() OVER (PARTITION BY source, substr(lower(trim(text)), 1, 100) ORDER BY doc_id) >= 3 AS repeated FROM documents WHERE text IS NOT NULL")
def mn1_documents(spark, sf_dir):
    """Documents whose first hundred characters came before twice in their source."""
    from ..operators import ordered

    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").withColumn("channel", F.col("source"))
    return ordered.flag_repeats(d, order=("doc_id",)).select("doc_id", "repeated")
