"""Queries of normalised records, crawled forms, stored rows, snapshots and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import profiles as P
from ..operators import normalise, ordered, products, scoring, tables
from .core import ID, SENT, scored_messages
from .inputs import messages, table, with_messages
from .ordered import _FP, GUARD, _last, guarded
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


def _normal(spark, sf_dir, platform):
    c = F.col
    m = messages(spark, sf_dir).withColumns({"velocity": F.lit(1.0), "title": F.concat(F.lit("T "), "channel"), "score": c("likes"), "comments": F.when(c("event_id") % 2 == 0, c("replies")), "depth": c("reposts"), "karma": F.when(c("event_id") % 3 != 0, c("followers")), "repeated": c("replies") > 2})
    return normalise.normalize(m, platform).select(*ID, "record.*").select(*ID, "text", "source_reliability", "fingerprint", "metrics.*")


@register("prj1_twitter", with_messages("SELECT event_id, replay, text, 0.5::DOUBLE AS source_reliability, substr(md5(message_id), 1, 16) AS fingerprint, round(ln(1 + likes + 2 * reposts + replies), 6) AS engagement_weight, round(ln(1 + followers), 6) AS author_weight FROM m"))
def prj1(spark, sf_dir):
    return _normal(spark, sf_dir, "twitter").select(*ID, "text", "source_reliability", "fingerprint", F.round("engagement_weight", 6).alias("engagement_weight"), F.round("author_weight", 6).alias("author_weight"))


@register("prj2_reddit", with_messages("SELECT event_id, replay, 'T ' || channel || ' ' || text AS text, round(ln(1 + likes + CASE WHEN event_id % 2 = 0 THEN replies ELSE greatest(1, reposts) END), 6) AS engagement_weight, round(ln(1 + CASE WHEN event_id % 3 <> 0 THEN followers ELSE greatest(1, likes * 10) END), 6) AS author_weight FROM m"))
def prj2(spark, sf_dir):
    """Posts, and comments where the number of comments is null."""
    return _normal(spark, sf_dir, "reddit").select(*ID, "text", F.round("engagement_weight", 6).alias("engagement_weight"), F.round("author_weight", 6).alias("author_weight"))


@register("prj4_telegram", with_messages("SELECT event_id, replay, 0.3::DOUBLE AS source_reliability, replies > 2 AS manipulation_flag FROM m"))
def prj4(spark, sf_dir):
    return _normal(spark, sf_dir, "telegram").select(*ID, "source_reliability", "manipulation_flag")


@register("prj6_reliability", with_messages("SELECT event_id, replay, CASE WHEN event_id % 7 = 0 THEN 0.5::DOUBLE ELSE CASE source WHEN 'twitter' THEN 0.5 WHEN 'reddit' THEN 0.7 ELSE 0.3 END END AS reliability FROM m"))
def prj6(spark, sf_dir):
    return messages(spark, sf_dir).select(*ID, C.reliability(F.when(F.col("event_id") % 7 == 0, "forum").otherwise(F.col("source"))).alias("reliability"))


@register("prj7_output_json", with_messages(f", {SENT} SELECT event_id, replay, bullish_count, label FROM scored"))
def prj7(spark, sf_dir):
    out = normalise.as_output(scoring.sentiment(messages(spark, sf_dir)), "sentiment")
    return out.select(*ID, F.get_json_object("output", "$.sentiment.bullish_count").cast("long").alias("bullish_count"), F.get_json_object("output", "$.sentiment.label").cast("int").alias("label"))


@register("fil5_crawled_tweet", with_messages("SELECT event_id, replay, CASE WHEN event_id % 4 = 0 AND event_id % 8 <> 0 THEN 'retweet_without_original' WHEN reposts = 3 THEN 'protected' WHEN replies = 2 THEN 'promoted' WHEN event_id % 11 = 0 THEN 'missing_account_age' END AS drop_reason FROM m"))
def fil5(spark, sf_dir):
    c = F.col
    e = c("event_id")
    m = messages(spark, sf_dir).withColumns({"is_retweet": e % 4 == 0, "original_text": F.when(e % 8 == 0, "x"), "is_protected": c("reposts") == 3, "is_promoted": c("replies") == 2, "account_created": F.when((e % 11 != 0) & (e % 2 == 0), e), "author_created": F.when((e % 11 != 0) & (e % 2 == 1), e)})
    return normalise.validate_crawled_tweet(m).select(*ID, "drop_reason")


@register("fil6_reddit_post", with_messages("SELECT event_id, replay, CASE WHEN event_id % 10 = 0 THEN 'author_deleted' WHEN likes <= 0 THEN 'low_score' WHEN replies <= 0 THEN 'no_comments' WHEN event_id % 6 = 1 THEN 'missing_text' END AS drop_reason FROM m"))
def fil6(spark, sf_dir):
    c = F.col
    m = messages(spark, sf_dir).withColumns({"author": F.when(c("event_id") % 10 == 0, "[deleted]").otherwise("someone"), "score": c("likes"), "comments": c("replies"), "is_self": c("event_id") % 2 == 0, "title": F.when(c("event_id") % 6 == 1, " ").otherwise("title")})
    return normalise.validate_post(m).select(*ID, "drop_reason")


@register("fil8_telegram_message", with_messages("SELECT event_id, replay, CASE WHEN event_id % 9 = 0 THEN 'not_public' WHEN reposts = 1 AND replies = 1 THEN 'forward_without_source' WHEN event_id % 5 = 0 THEN 'bot' END AS drop_reason FROM m"))
def fil8(spark, sf_dir):
    c = F.col
    m = messages(spark, sf_dir).withColumns({"is_public": F.when(c("event_id") % 9 == 0, False), "is_forwarded": c("reposts") == 1, "forward_source": F.when(c("replies") != 1, "chan"), "is_bot": c("event_id") % 5 == 0})
    return normalise.validate_message(m).select(*ID, "drop_reason")


@register("fil16_content_filters", with_messages("SELECT event_id, replay FROM m WHERE ln(1 + likes + 2 * reposts + replies) > 1.0 AND contains(text, 'moon')"))
def fil16(spark, sf_dir):
    weight = C.engagement_log(F.col("likes"), F.col("reposts"), F.col("replies"))
    return messages(spark, sf_dir).where((weight > 1.0) & F.contains("text", F.lit("moon"))).select(*ID)


@register("tx6_mentions_asset", r"SELECT doc_id, regexp_matches(text, '(?i)\$BTC\b|#BTC\b|\bbitcoin\b') AS mentioned FROM documents")
def tx6(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.mentions_asset(F.col("text")).alias("mentioned"))


@register("tx9_report_text", with_messages(f""", {SENT}, n AS (SELECT max(arrival_s) - 86400 AS t FROM m), q AS (SELECT * FROM weighted, n WHERE arrival_s >= t)
 SELECT 'SIGNAL ' || CASE WHEN sum(weighted_score) / count(*) > 0.1 THEN 'BULLISH' WHEN sum(weighted_score) / count(*) < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END || chr(10) || 'messages: ' || count(*) || chr(10) || 'bullish ' || count(*) FILTER (label = 1) || ', bearish ' || count(*) FILTER (label = -1) || ', neutral ' || count(*) FILTER (label = 0) AS message FROM q"""))
def tx9(spark, sf_dir):
    m = messages(spark, sf_dir)
    return normalise.format_report(products.periodic_report(m, scored_messages(spark, sf_dir), _last(m, "arrival_s") - 86_400)).select("message")


@register("ag14_quality_details", with_messages(f", {GUARD}, n AS (SELECT max(event_s) AS t FROM m) SELECT asset, source, max(t) - max(event_s) AS seconds_since, count(*) FILTER (event_s >= t - 3600) AS recent, count(*) FILTER (event_s >= t - 3600 AND guard_reason = 'late') AS late FROM guarded, n GROUP BY 1, 2"))
def ag14(spark, sf_dir):
    g = guarded(spark, sf_dir)
    now = _last(messages(spark, sf_dir))
    recent = F.col("event_s") >= now - 3600
    return g.groupBy("asset", "source").agg((F.lit(now) - F.max("event_s")).alias("seconds_since"), F.count_if(recent).alias("recent"), F.count_if(recent & (F.col("guard_reason") == "late")).alias("late"))


@register("cur2_skip_last_id", with_messages(", p AS (SELECT *, lag(message_id) OVER (PARTITION BY channel ORDER BY arrival_s, event_id, replay) AS before FROM m) SELECT event_id, replay FROM p WHERE before IS NULL OR before <> message_id"))
def cur2(spark, sf_dir):
    """Rows whose id is not the one handled just before in their channel."""
    before = F.lag("message_id").over(Window.partitionBy("channel").orderBy("arrival_s", "event_id", "replay"))
    return messages(spark, sf_dir).withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("message_id"))).select(*ID)


@register("snk1_append_rows", with_messages(f", f AS (SELECT *, {_FP} AS fp FROM m), d AS (SELECT *, row_number() OVER (PARTITION BY fp ORDER BY arrival_s, event_id, replay) AS n FROM f) SELECT event_id, replay FROM d WHERE n = 1 AND fp NOT IN (SELECT fp FROM f WHERE event_id % 4 = 0)"))
def snk1(spark, sf_dir):
    """What an append would add: the first row of each fingerprint that the table (every fourth message) lacks."""
    m = messages(spark, sf_dir).withColumn("fingerprint", C.fingerprint("store", source=F.col("source"), message_id=F.col("message_id"), text=F.col("text")))
    rows = ordered.dedupe_first(m, ("fingerprint",), ("arrival_s", "event_id", "replay"))
    return tables.new_only(rows, m.where("event_id % 4 = 0")).select(*ID)


@register("so5_recent_rows", with_messages("SELECT event_id, replay, substr(text, 1, 20) AS shown FROM m ORDER BY event_s DESC, event_id DESC, replay DESC LIMIT 100"))
def so5(spark, sf_dir):
    top = messages(spark, sf_dir).orderBy(F.desc("event_s"), F.desc("event_id"), F.desc("replay")).limit(100)
    return top.select(*ID, F.left("text", F.lit(20)).alias("shown"))


@register("ac1_asset_changes", """WITH b AS (SELECT p_partkey, p_name AS name, p_brand AS brand FROM part), l AS (SELECT l_partkey, arg_max(l_linestatus, (l_orderkey, l_linenumber)) AS mode, arg_max(l_returnflag, (l_orderkey, l_linenumber)) AS flag FROM lineitem GROUP BY 1)
 SELECT p_partkey, name, coalesce(mode, brand) AS brand FROM b LEFT JOIN l ON p_partkey = l_partkey WHERE coalesce(flag <> 'A', TRUE)""")
def ac1(spark, sf_dir):
    """A catalog (parts) under changes (line items): the last status replaces the brand, a last flag of A removes the part."""
    base = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    changes = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.lit(None).cast("string").alias("name"), F.col("l_linestatus").alias("brand"), F.struct("l_orderkey", "l_linenumber").alias("seq"), (F.col("l_returnflag") == "A").alias("gone"))
    return tables.upsert_latest(base, changes, "p_partkey", ["name", "brand"], delete="gone").where("name IS NOT NULL OR brand IS NOT NULL")


@register("vl9_scraper_velocity", with_messages(", v AS (SELECT *, count(*) OVER (PARTITION BY source ORDER BY event_s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) - (count(*) OVER (PARTITION BY source, event_s) - row_number() OVER (PARTITION BY source, event_s ORDER BY event_id, replay)) AS n FROM m) SELECT event_id, replay, CAST(n AS BIGINT) AS in_minute FROM v"))
def vl9(spark, sf_dir):
    """Events of the last minute so far, itself among them."""
    return ordered.recent_count(messages(spark, sf_dir), ("source",), 60, order=("event_id", "replay")).select(*ID, F.col("recent").alias("in_minute"))
