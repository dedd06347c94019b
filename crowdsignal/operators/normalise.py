"""Normalised records: each platform's fields in one shape, and the rules of the crawled forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from .validation import blank, first_reason


def normalize(df: DataFrame, platform: str) -> DataFrame:
    """Adds ``record``: source, asset, time, text, metrics (weights null for telegram), reliability and fingerprint.

    twitter: log weights of likes, reposts and replies, and of followers. reddit: title and body joined; score and
    comments; karma, or ten times the score where it is null, at least 1; a comment counts its depth as its comments.
    telegram: no weights, the manipulation flag instead.
    """
    c = F.col
    text = F.trim(F.coalesce(c("text"), F.lit("")))
    engagement = author = F.lit(None).cast("double")
    flag = F.lit(None).cast("boolean")
    if platform == "twitter":
        engagement, author = C.engagement_log(c("likes"), c("reposts"), c("replies")), C.author_log(c("followers"))
    elif platform == "reddit":
        text = F.trim(F.concat_ws(" ", c("title"), c("text")))
        engagement = C.safe_log(c("score") + F.coalesce(c("comments"), F.greatest(F.lit(1), c("depth"))))
        author = C.author_log(F.coalesce(c("karma"), F.greatest(F.lit(1), c("score") * 10)))
    else:
        flag = c("repeated")
    metrics = F.struct(engagement.alias("engagement_weight"), author.alias("author_weight"), c("velocity").alias("velocity"), flag.alias("manipulation_flag"))
    return df.withColumn("record", F.struct(F.lit(platform).alias("source"), c("asset").alias("asset"), c("event_s").alias("event_s"), text.alias("text"), metrics.alias("metrics"), C.reliability(F.lit(platform)).alias("source_reliability"), C.fingerprint("id", message_id=c("message_id")).alias("fingerprint")))


def as_output(df: DataFrame, kind: str) -> DataFrame:
    """Adds ``output``, the product's nested shape as JSON: sentiment, risk, quality or context."""
    shapes = {
        "sentiment": ["bullish_count", "bearish_count", "fear_count", "greed_count", "score", "label", "confidence"],
        "risk": ["social_overheat", "panic_risk", "fomo_risk", "fear_greed_zone", "sentiment_reliability"],
        "quality": ["overall", "availability", "time_integrity", "volume", "source_balance", "anomaly_frequency"],
    }
    if kind == "context":
        mood = F.struct("label", "confidence").alias("sentiment")
        risk = F.struct("sentiment_reliability", "fear_greed_index", "fear_greed_zone", "social_overheat", "panic_risk", "fomo_risk").alias("risk_indicators")
        data = F.struct("overall", "availability", "time_integrity", "volume", "source_balance", "anomaly_frequency").alias("data_quality")
        whole = F.struct("asset", F.struct("since", "until").alias("window"), F.struct(mood, risk, data, F.col("records").alias("record_count")).alias("social_context"))
        return df.withColumn("output", F.to_json(whole, {"ignoreNullFields": "false"}))
    return df.withColumn("output", F.to_json(F.struct(F.struct(*shapes[kind]).alias(kind))))


def normalize_scraped(df: DataFrame, asset: str = "BTC") -> DataFrame:
    """One row per scraped tweet with an id, in order of time: the normalised record and ``metadata`` of what was scraped."""
    c = F.col
    rows = df.where(c("message_id").isNotNull() & (c("message_id") != ""))
    engagement = C.engagement_log(c("likes"), c("reposts"), c("replies"))
    metadata = F.struct(c("message_id").alias("tweet_id"), c("username"), c("likes").alias("like_count"), c("reposts").alias("retweet_count"), c("replies").alias("reply_count"), (c("likes") + c("reposts") + c("replies")).alias("total_engagement"), c("is_retweet"))
    record = [F.lit("twitter").alias("source"), F.lit(asset).alias("asset"), C.format_ts(c("posted_at")).alias("timestamp"), c("text"), engagement.alias("engagement_weight"), C.author_log(c("followers")).alias("author_weight"), c("velocity"), C.reliability(F.lit("twitter")).alias("source_reliability"), C.fingerprint("scrape", message_id=c("message_id"), text=c("text")).alias("fingerprint"), metadata.alias("metadata")]
    return rows.orderBy(c("posted_at").asc_nulls_first(), "message_id").select(*record)


def validate_crawled_tweet(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("drop_reason", first_reason((blank(c("text")), "missing_text"), (c("is_retweet") & blank(c("original_text")), "retweet_without_original"), (c("is_protected"), "protected"), (c("is_promoted"), "promoted"), (F.coalesce(c("account_created"), c("author_created")).isNull(), "missing_account_age")))


def validate_post(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("drop_reason", first_reason((c("author").isNull() | c("author").isin("[deleted]", "[removed]"), "author_deleted"), (~(c("score") > 0), "low_score"), (~(c("comments") > 0), "no_comments"), (blank(F.when(c("is_self"), F.concat_ws(" ", "title", "text")).otherwise(c("title"))), "missing_text")))


def validate_message(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("drop_reason", first_reason((~F.coalesce(c("is_public"), F.lit(True)), "not_public"), (c("is_forwarded") & c("forward_source").isNull(), "forward_without_source"), (c("is_bot"), "bot"), (blank(c("text")), "missing_text")))


def format_report(df: DataFrame) -> DataFrame:
    """Adds ``message``: the periodic report's lines."""
    return df.withColumn("message", F.concat_ws("\n", F.concat(F.lit("SIGNAL "), "signal"), F.concat(F.lit("messages: "), F.col("total_messages").cast("string")), F.format_string("bullish %d, bearish %d, neutral %d", "bullish", "bearish", "neutral")))
