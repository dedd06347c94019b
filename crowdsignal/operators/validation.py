"""Validity rules: each adds the reason of the first rule that a row fails, null if it passes; nothing is dropped."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C

# The reasons that differ by platform.
SOURCE_DISABLED = {"twitter": "source_disabled", "reddit": "subreddit_disabled", "telegram": "source_disabled"}
SOURCE_RATE = {"twitter": "source_rate_exceeded", "reddit": "subreddit_rate_exceeded", "telegram": "group_rate_exceeded"}


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The reason of the first rule whose condition holds; a null condition does not."""
    out = F.when(F.coalesce(rules[0][0], F.lit(False)), rules[0][1])
    for failed, reason in rules[1:]:
        out = out.when(F.coalesce(failed, F.lit(False)), reason)
    return out


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def keep_accepted(df: DataFrame, reason: str = "drop_reason") -> DataFrame:
    return df.where(F.col(reason).isNull())


def validate_sentiment_input(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("drop_reason", first_reason((c("source").isNull(), "missing_source"), (~c("source").isin("twitter", "reddit", "telegram"), "unknown_source"), (blank(c("asset")), "missing_asset"), (blank(c("text")), "missing_text"), (c("event_s").isNull(), "missing_timestamp"), (c("likes").isNull(), "missing_engagement"), (c("followers").isNull(), "missing_author")))


def validate_twitter(df: DataFrame, asset: Column | None = None) -> DataFrame:
    c = F.col
    asset = C.mentions_asset(c("text")) if asset is None else asset
    return df.withColumn("drop_reason", first_reason((blank(c("text")), "missing_text"), (~asset, "no_asset"), (c("event_s").isNull(), "missing_timestamp"), (F.coalesce(c("likes"), F.lit(0)) + F.coalesce(c("reposts"), F.lit(0)) + F.coalesce(c("replies"), F.lit(0)) <= 0, "no_engagement"), (c("is_private"), "private"), (c("is_ad"), "ad"), (c("followers").isNull(), "missing_author")))


def validate_reddit(df: DataFrame) -> DataFrame:
    c = F.col
    return df.withColumn("drop_reason", first_reason((blank(c("text")), "missing_text"), (~(c("score") > 0), "low_score"), (~(c("depth") >= 1), "depth"), (c("comments").isNull(), "missing_comments"), (c("karma").isNull(), "missing_karma")))


def validate_telegram(df: DataFrame, asset: Column | None = None) -> DataFrame:
    """A text about the asset, a time, a public place, and a channel or a group (``group_id``, where the table has it)."""
    c = F.col
    asset = C.mentions_asset(c("text")) if asset is None else asset
    place = F.coalesce("channel", "group_id") if "group_id" in df.columns else c("channel")
    return df.withColumn("drop_reason", first_reason((blank(c("text")), "missing_text"), (~asset, "no_asset"), (c("event_s").isNull(), "missing_timestamp"), (~F.coalesce(c("is_public"), F.lit(False)), "not_public"), (place.isNull(), "missing_channel")))


def validate_comment(df: DataFrame, asset: Column | None = None) -> DataFrame:
    """Comments: an author that is still there, a text that was not taken out and is about the asset."""
    c = F.col
    asset = C.mentions_asset(c("text")) if asset is None else asset
    gone = ("[deleted]", "[removed]")
    return df.withColumn("drop_reason", first_reason((c("author").isNull() | c("author").isin(*gone), "author_deleted"), (blank(c("text")), "missing_text"), (c("text").isin(*gone), "text_removed"), (~asset, "no_asset")))


def validate_raw(df: DataFrame, keywords: tuple[str, ...] = ("btc", "bitcoin", "$btc")) -> DataFrame:
    """Worker rules: text, timestamp, a keyword anywhere."""
    c = F.col
    return df.withColumn("drop_reason", first_reason((F.coalesce(c("text"), F.lit("")) == "", "Missing text content"), (c("event_s").isNull(), "Missing timestamp"), (C.substring_hits(c("text"), list(keywords)) == 0, "No keyword match")))


def classify_whitelisted(df: DataFrame, platform: str, keyword: Column, min_score: int = 1) -> DataFrame:
    """Whitelist ingestion after ``attach_registry``: adds the platform's first drop reason, in its own order.

    Whether a row was handled before, is within its source's rate and within that of all are the columns ``seen``,
    ``source_ok`` and ``global_ok`` (from a cursor and from ``admit``). twitter: fields, text, a time finer than a minute
    (``posted_at``), keyword, rates. reddit: fields, text, score, keyword, rates. telegram: rates before text, keyword and
    time. ``keyword`` is a condition on whatever text it should be found in.
    """
    c = F.col
    null = lambda *names: reduce(or_, [c(n).isNull() for n in names])
    listed = [(c("registry_state") == "unknown", "not_whitelisted"), (c("registry_state") == "disabled", SOURCE_DISABLED[platform])]
    rates = [(~c("source_ok"), SOURCE_RATE[platform]), (~c("global_ok"), "global_rate_exceeded")]
    seen, no_id = (c("seen"), "already_processed"), (blank(c("message_id")), "missing_required_field")
    no_text, no_keyword = (blank(c("text")), "empty_text"), (~keyword, "no_asset_keyword")
    if platform == "telegram":
        rules = [*listed, *rates, no_text, no_keyword, (c("event_s").isNull(), "invalid_timestamp")]
    elif platform == "reddit":
        rules = [*listed, seen, no_id, (c("event_s").isNull() | (c("event_s") <= 0), "invalid_timestamp"), (F.coalesce("text", F.lit("")) == "", "empty_text"), (null("likes"), "missing_required_field"), no_text, (c("likes") < min_score, "low_score"), no_keyword, *rates]
    else:
        rules = [*listed, seen, no_id, (c("posted_at").isNull(), "invalid_timestamp"), (F.coalesce("text", F.lit("")) == "", "empty_text"), (null("likes", "reposts", "replies", "followers"), "missing_required_field"), no_text, (~C.has_seconds(c("posted_at")), "low_precision_timestamp"), no_keyword, *rates]
    return df.withColumn("drop_reason", first_reason(*rules))


def validate_risk_input(df: DataFrame) -> DataFrame:
    """``ok`` and a ``note`` that lists every missing or invalid path."""
    c = F.col
    missing = F.array_compact(F.array(F.when(blank(c("asset")), "asset"), F.when(c("event_s").isNull(), "timestamp"), F.when(c("label").isNull(), "sentiment.final.label"), F.when(~c("label").isin(-1, 0, 1), "sentiment.final.label invalid"), F.when(c("velocity").isNull(), "mentions.velocity"), F.when(c("anomaly").isNull(), "mentions.anomaly")))
    return df.withColumn("note", F.array_join(missing, ", ")).withColumn("ok", F.size(missing) == 0)


def validate_context_requests(df: DataFrame, low: int = 30, high: int = 300) -> DataFrame:
    c = F.col
    return df.withColumn("request_error", first_reason((F.size(F.array_except("sources", F.array(*map(F.lit, ("twitter", "reddit", "telegram"))))) > 0, "unknown_source"), (F.size("sources") == 0, "no_source"), (c("since") >= c("until"), "empty_window"), (c("until") - c("since") < low, "window_too_short"), (c("until") - c("since") > high, "window_too_long")))


def batch_summary(df: DataFrame, by: str = "request_id", reason: str = "drop_reason") -> DataFrame:
    """Per request received, processed and dropped rows, and the fallback where none was processed."""
    out = df.groupBy(by).agg(F.count("*").alias("received"), F.count_if(F.col(reason).isNull()).alias("processed"))
    return out.withColumn("dropped", F.col("received") - F.col("processed")).withColumn("fallback", F.when(F.col("processed") == 0, "BLOCK_TRADING"))
