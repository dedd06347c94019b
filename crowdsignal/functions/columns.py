"""Column expressions: text, time, fingerprints, weights. Built-in functions only, so everything stays in codegen."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import profiles as P

#: Code-point ranges taken out with emoji (the wide one takes CJK with it, as specified).
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2600}-\x{26FF}]+"


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0))


def clean_text(c: Column) -> Column:
    """Lower case, without URLs and emoji; nothing is put in their place, so words may join."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"https?://\S+|www\.\S+", ""), EMOJI, "")


def lexicon_counts(c: Column, lexicon: dict[str, list[str]]) -> dict[str, Column]:
    """Whole-word occurrences by category; terms are counted one by one, so overlapping terms all count."""
    return {k: total([F.regexp_count(c, F.lit(rf"(?i)\b{re.escape(t)}\b")) for t in terms]) for k, terms in lexicon.items()}


def regex_counts(c: Column, rules: dict[str, list[str]]) -> dict[str, Column]:
    return {k: total([F.regexp_count(c, F.lit(f"(?i){r}")) for r in rs]) for k, rs in rules.items()}


def token_hits(c: Column, words: list[str]) -> Column:
    """Distinct white-space tokens that are in the word set."""
    tokens = F.split(F.lower(c), r"\s+")
    return F.size(F.array_intersect(tokens, F.array(*map(F.lit, words))))


def substring_hits(c: Column, terms: list[str]) -> Column:
    """How many of the terms occur at least once, anywhere."""
    low = F.lower(c)
    return total([F.contains(low, F.lit(t)).cast("int") for t in terms])


def mentions_asset(c: Column) -> Column:
    return c.rlike(r"(?i)\$BTC\b|#BTC\b|\bbitcoin\b")


def phrase_key_a(c: Column) -> Column:
    """Lower case without digits and signs, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(c), r"\d+", ""), r"(?U)[^\w\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def phrase_key_b(c: Column) -> Column:
    """Lower-case letters and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\s]", ""), r"\s+", " "))


def parse_ts_strict(c: Column) -> Column:
    """ISO with seconds and Z or an offset, in UTC; null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(c))


def parse_ts(c: Column) -> Column:
    """ISO (naive means UTC), Unix seconds, or "EEE MMM dd HH:mm:ss Z yyyy"; null for anything else."""
    iso = F.when(c.rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_timestamp(c))
    unix = F.when(c.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(c.try_cast("double")))
    named = F.when(c.rlike(r"^[A-Z][a-z]{2} [A-Z][a-z]{2} \d\d "), F.try_to_timestamp(F.regexp_replace(c, r"^\S+ ", ""), F.lit("MMM dd HH:mm:ss Z yyyy")))
    return F.coalesce(iso, unix, named)


def format_ts(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def has_seconds(c: Column) -> Column:
    """Whether a timestamp is finer than a minute."""
    return (F.unix_micros(c) % 60_000_000) != 0


def isoformat(c: Column) -> Column:
    """Seconds, then microseconds only where there are any, then the UTC offset."""
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(c) % 1_000_000 != 0, F.date_format(c, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def fingerprint(profile: str, **c: Column) -> Column:
    """A record's fingerprint; the columns that a profile needs are passed by name."""
    text = c.get("text", F.lit(""))
    if profile == "guard":
        return F.sha2(F.concat_ws("|", c["source"], c["asset"], c["timestamp"], F.lower(F.trim(text))), 256)
    if profile == "worker":
        return F.substring(F.sha2(F.concat_ws("|", c["source"], text, isoformat(c["event_time"])), 256), 1, 32)
    if profile == "store":
        return F.md5(F.concat_ws(":", c["source"], c["message_id"], text))
    if profile == "batch":
        return F.substring(F.md5(F.concat_ws(":", c["source"], c["message_id"], F.substring(text, 1, 50))), 1, 16)
    if profile == "id":
        return F.substring(F.md5(c["message_id"]), 1, 16)
    if profile == "scrape":
        return F.substring(F.sha2(F.concat_ws(":", c["message_id"], F.substring(text, 1, 100)), 256), 1, 16)
    if profile == "phrase_a":
        return F.md5(phrase_key_a(text))
    if profile == "phrase_b":
        return F.substring(F.md5(phrase_key_b(text)), 1, 16)
    if profile == "alert":
        return F.substring(F.sha2(F.concat_ws("|", c["alert_type"], c["asset"], F.coalesce(c["source"], F.lit("none"))), 256), 1, 16)
    raise ValueError(f"no fingerprint profile {profile!r}")


def by_source(source: Column, values: dict[str, float], default=None) -> Column:
    """A small fixed table looked up by source."""
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(source == k, v).otherwise(out)
    return out


def reliability(source: Column) -> Column:
    return by_source(source, P.RELIABILITY, P.DEFAULT_RELIABILITY)


def safe_log(c: Column) -> Column:
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def engagement_log(likes: Column, reposts: Column, replies: Column) -> Column:
    return safe_log(likes + 2 * reposts + replies)


def engagement_linear(source: Column, **c: Column) -> Column:
    """Worker weights: likes 1, reposts 2, replies 1.5; score 1, comments 2; views 0.1, forwards 5. Nulls are 0."""
    n = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in c.items()}
    zero = F.lit(0.0)
    tw = n.get("likes", zero) + 2.0 * n.get("reposts", zero) + 1.5 * n.get("replies", zero)
    rd = n.get("score", zero) + 2.0 * n.get("comments", zero)
    tg = 0.1 * n.get("views", zero) + 5.0 * n.get("forwards", zero)
    return F.when(source == "twitter", tw).when(source == "reddit", rd).when(source == "telegram", tg).otherwise(0.0)


def author_log(followers: Column) -> Column:
    return safe_log(followers)


def author_linear(source: Column, followers: Column, verified: Column) -> Column:
    """Ten thousand followers a point, ten at most, half as much again if verified; 1 for telegram and unknown sources."""
    base = F.least(F.lit(10.0), F.coalesce(followers.cast("double"), F.lit(0.0)) / 10000)
    boost = F.when(F.coalesce(verified, F.lit(False)), 1.5).otherwise(1.0)
    return F.when(source == "twitter", base * boost).when(source == "reddit", base).otherwise(1.0)


def events_per_minute(n: Column, seconds: float) -> Column:
    return n / F.lit(float(seconds)) * 60.0 if seconds > 0 else F.lit(0.0)


def velocity_ratio(short: Column, average: Column) -> Column:
    """Null, which means drop, where the average is not positive."""
    return F.when(average > 0, short / average)
