"""Queries of the column operators: text, time, fingerprints, weights, sentiment, risk, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import profiles as P
from ..operators import products, scoring, tables, validation
from .inputs import messages, table, with_messages
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles
ID = ["event_id", "replay"]

# ---- SQL pieces of the oracles -------------------------------------------------------------------------------------


def _words(terms: list[str], text: str = "text") -> str:
    return " + ".join(rf"len(regexp_extract_all({text}, '(?i)\b{t}\b'))" for t in terms)


def _rules(rules: list[str], text: str = "text") -> str:
    return " + ".join(f"len(regexp_extract_all({text}, '(?i){r}'))" for r in rules)


def _subs(terms: list[str], text: str = "lower(text)") -> str:
    return " + ".join(f"CAST(contains({text}, '{t}') AS BIGINT)" for t in terms)


def _tokens(terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return rf"CAST(len(list_intersect(list_distinct(string_split_regex(lower(text), '\s+')), [{listed}])) AS BIGINT)"


LEX = (
    ", ".join(f"CAST({_words(t)}{' + ' + _rules(P.RULES[k]) if k in P.RULES else ''} AS BIGINT) AS {k}_count" for k, t in P.LEXICON.items())
)
SENT = f"""s1 AS (SELECT *, {LEX} FROM m), s2 AS (SELECT *, bullish_count + bearish_count + fear_count + greed_count AS matches,
  bullish_count * 1.0::DOUBLE + greed_count * 0.5::DOUBLE - bearish_count * 1.2::DOUBLE - fear_count * 1.5::DOUBLE AS raw FROM s1),
 s3 AS (SELECT *, CASE WHEN matches = 0 THEN 0.0::DOUBLE ELSE greatest(-1.0, least(1.0, raw / matches)) END AS score FROM s2),
 scored AS (SELECT *, CASE WHEN score >= 0.2 THEN 1 WHEN score <= -0.2 THEN -1 ELSE 0 END AS label, abs(score) AS confidence,
  CASE source WHEN 'twitter' THEN 0.5::DOUBLE WHEN 'reddit' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS source_reliability,
  ln(1 + likes + 2 * reposts + replies) AS engagement_weight, ln(1 + followers)  AS author_weight FROM s3),
 weighted AS (SELECT *, score * source_reliability * (1 + (engagement_weight + author_weight) / 20) AS weighted_score,
  abs(score * source_reliability * (1 + (engagement_weight + author_weight) / 20)) * confidence AS signal_strength FROM scored)"""


def scored_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with lexicon sentiment, logarithmic weights and weighted scores."""
    m = scoring.sentiment(messages(spark, sf_dir), "lexicon")
    m = m.withColumns({"source_reliability": C.reliability(F.col("source")), "engagement_weight": C.engagement_log(F.col("likes"), F.col("reposts"), F.col("replies")), "author_weight": C.author_log(F.col("followers"))})
    return scoring.weighted_score(m)


def _r(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# ---- flagship ------------------------------------------------------------------------------------------------------


@register("flagship", with_messages(f""", {SENT} SELECT asset, CAST(time_bucket(INTERVAL 30 MINUTE, ts) AS TIMESTAMP) AS window_start, count(*) AS total,
 count(*) FILTER (label = 1) AS bullish, count(*) FILTER (label = -1) AS bearish, count(*) FILTER (label = 0) AS neutral,
 count(*) FILTER (label = -1 AND replies >= 2) AS panic, round(avg(score), 6) AS avg_score, round(avg(weighted_score), 6) AS avg_weighted, round(avg(signal_strength), 6) AS avg_strength,
 CASE WHEN avg(weighted_score) > 0.1 THEN 'BULLISH' WHEN avg(weighted_score) < -0.1 THEN 'BEARISH' ELSE 'NEUTRAL' END AS signal FROM weighted GROUP BY 1, 2"""))
def flagship(spark, sf_dir):
    """Sentiment, risk and the signal of each asset and half hour."""
    m = scored_messages(spark, sf_dir).withColumns({"velocity": F.col("replies").cast("double"), "anomaly": F.col("reposts") > 3, "fear_greed_index": F.lit(50.0)})
    out = scoring.risk_indicators(m, "core").groupBy("asset", F.window("ts", "30 minutes").alias("w")).agg(*products._signal(), F.count_if("panic_risk").alias("panic"))
    return out.select("asset", F.col("w.start").cast("timestamp_ntz").alias("window_start"), "total", "bullish", "bearish", "neutral", "panic", *_r("avg_score", "avg_weighted", "avg_strength"), products.signal_type(F.col("avg_weighted")).alias("signal"))


# ---- sentiment -----------------------------------------------------------------------------------------------------


@register("sn1_lexicon_sentiment", with_messages(f", {SENT} SELECT event_id, replay, bullish_count, bearish_count, fear_count, greed_count, round(score, 6) AS score, label, round(confidence, 6) AS confidence FROM scored"))
def sn1(spark, sf_dir):
    return scoring.sentiment(messages(spark, sf_dir), "lexicon").select(*ID, "bullish_count", "bearish_count", "fear_count", "greed_count", *_r("score", "confidence"), "label")


@register("sn2_token_sentiment", with_messages(f""", t AS (SELECT *, {_tokens(P.TOKENS['bullish'])} AS b, {_tokens(P.TOKENS['bearish'])} AS d FROM m)
 SELECT event_id, replay, b AS bullish_count, d AS bearish_count, CAST(sign(b - d) AS INTEGER) AS label, CASE WHEN b + d = 0 THEN 0.5::DOUBLE ELSE least(1.0::DOUBLE, (b + d) / 5.0::DOUBLE) * 0.5 + 0.5 END AS confidence FROM t"""))
def sn2(spark, sf_dir):
    return scoring.sentiment(messages(spark, sf_dir), "tokens").select(*ID, "bullish_count", "bearish_count", "label", "confidence")


@register("sn3_substring_sentiment", with_messages(f""", t AS (SELECT *, {_subs(P.SUBSTRINGS['bullish'])} AS b, {_subs(P.SUBSTRINGS['bearish'])} AS d FROM m)
 SELECT event_id, replay, CASE WHEN b + d = 0 THEN 0.0::DOUBLE ELSE round((b - d) / (b + d)::DOUBLE, 6) END AS score, CASE WHEN b + d = 0 THEN 0 WHEN (b - d) / (b + d)::DOUBLE > 0.2 THEN 1 WHEN (b - d) / (b + d)::DOUBLE < -0.2 THEN -1 ELSE 0 END AS label,
 round(CASE WHEN b + d = 0 THEN 0.5::DOUBLE ELSE least(0.95::DOUBLE, 0.5 + (b + d) * 0.1::DOUBLE) END, 6) AS confidence FROM t"""))
def sn3(spark, sf_dir):
    return scoring.sentiment(messages(spark, sf_dir), "substring").select(*ID, *_r("score", "confidence"), "label")


@register("sn4_context_sentiment", with_messages(f""", t AS (SELECT *, {_subs(P.CONTEXT_TERMS['bullish'])} AS b, {_subs(P.CONTEXT_TERMS['bearish'])} AS d FROM m)
 SELECT event_id, replay, CASE WHEN event_id % 7 = 0 THEN -1 WHEN b > d THEN 1 WHEN d > b THEN -1 ELSE 0 END AS label, round(CASE WHEN event_id % 7 = 0 THEN 0.25::DOUBLE WHEN b = d THEN 0.5::DOUBLE ELSE least(greatest(b, d) * 0.1::DOUBLE + 0.5, 0.95) END, 6) AS confidence FROM t"""))
def sn4(spark, sf_dir):
    """Every seventh message has a stored result, every fifth a stored one of another kind."""
    e = F.col("event_id")
    raw = F.when(e % 7 == 0, '{"sentiment": {"label": -1, "confidence": 0.25}}').when(e % 5 == 0, '{"risk_indicators": {}}')
    return scoring.sentiment(messages(spark, sf_dir).withColumn("raw_data", raw), "context", stored="raw_data").select(*ID, "label", *_r("confidence"))


@register("sn5_model_reply", with_messages(f""", {SENT}, r AS (SELECT *, CASE event_id % 4 WHEN 0 THEN '{{"label": 1, "confidence": 0.9}}' WHEN 1 THEN '{{"label": 7}}' WHEN 2 THEN '{{"label": -1}}' ELSE NULL END AS j FROM scored),
 v AS (SELECT *, CAST(json_extract(j, '$.label') AS INTEGER) AS jl, CAST(json_extract(j, '$.confidence') AS DOUBLE) AS jc FROM r)
 SELECT event_id, replay, CASE WHEN matches > 0 THEN label WHEN jl IN (-1, 0, 1) THEN jl ELSE 0 END AS final_label, round(CASE WHEN matches > 0 THEN confidence WHEN jl IN (-1, 0, 1) THEN coalesce(jc, 0.5) ELSE 0.0 END, 6) AS final_confidence FROM v"""))
def sn5(spark, sf_dir):
    reply = F.when(F.col("event_id") % 4 == 0, '```json\n{"label": 1, "confidence": 0.9}\n```').when(F.col("event_id") % 4 == 1, '{"label": 7}').when(F.col("event_id") % 4 == 2, 'Sure: {"label": -1}')
    m = scoring.sentiment(messages(spark, sf_dir), "lexicon").withColumn("reply", reply)
    return scoring.merge_sentiment(m).select(*ID, "final_label", *_r("final_confidence"))


@register("sn6_weighted_score", with_messages(f", {SENT} SELECT event_id, replay, round(weighted_score, 6) AS weighted_score, round(signal_strength, 6) AS signal_strength FROM weighted"))
def sn6(spark, sf_dir):
    return scored_messages(spark, sf_dir).select(*ID, *_r("weighted_score", "signal_strength"))


# ---- risk ----------------------------------------------------------------------------------------------------------

_V = "replies * 1.0::DOUBLE AS velocity, reposts > 3 AS anomaly, CASE WHEN event_id % 11 = 0 THEN NULL ELSE (event_id % 101)::DOUBLE END AS fear_greed_index"


def _risky(spark, sf_dir):
    m = scoring.sentiment(messages(spark, sf_dir), "lexicon")
    return m.withColumns({"velocity": F.col("replies").cast("double"), "anomaly": F.col("reposts") > 3, "fear_greed_index": F.when(F.col("event_id") % 11 != 0, (F.col("event_id") % 101).cast("double"))})


@register("rk1_core_risk", with_messages(f""", {SENT}, r AS (SELECT *, {_V} FROM scored) SELECT event_id, replay, velocity >= 3.0 AND anomaly AS social_overheat, label = -1 AND velocity >= 2.0 AS panic_risk,
 label = 1 AND coalesce(fear_greed_index >= 70, FALSE) AS fomo_risk, CASE WHEN fear_greed_index IS NULL THEN 'unknown' WHEN fear_greed_index <= 20 THEN 'extreme_fear' WHEN fear_greed_index >= 80 THEN 'extreme_greed' ELSE 'normal' END AS fear_greed_zone,
 CASE WHEN confidence < 0.6 THEN 'low' ELSE 'normal' END AS sentiment_reliability FROM r"""))
def rk1(spark, sf_dir):
    return scoring.risk_indicators(_risky(spark, sf_dir), "core").select(*ID, "social_overheat", "panic_risk", "fomo_risk", "fear_greed_zone", "sentiment_reliability")


@register("rk2_worker_risk", with_messages(f""", {SENT}, r AS (SELECT *, {_V}, {_tokens(P.TOKENS['fear'])} AS f, {_tokens(P.TOKENS['greed'])} AS g FROM scored) SELECT event_id, replay, velocity > 5.0 OR g >= 3 AS social_overheat,
 label = -1 AND f >= 2 AS panic_risk, label = 1 AND g >= 2 AS fomo_risk, CAST(CASE WHEN f > g + 2 THEN greatest(0, 25 - f * 5) WHEN g > f + 2 THEN least(100, 75 + g * 5) ELSE greatest(25, least(75, 50 + (g - f) * 10)) END AS DOUBLE) AS fear_greed_index,
 CASE WHEN f > g + 2 THEN 'extreme_fear' WHEN g > f + 2 THEN 'extreme_greed' ELSE 'normal' END AS fear_greed_zone FROM r"""))
def rk2(spark, sf_dir):
    return scoring.risk_indicators(_risky(spark, sf_dir).drop("fear_count", "greed_count"), "worker").select(*ID, "social_overheat", "panic_risk", "fomo_risk", "fear_greed_index", "fear_greed_zone")


@register("rk3_context_risk", with_messages(f""", r AS (SELECT *, CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE likes / 15.0::DOUBLE END AS v, event_id % 5 = 0 AS k FROM m) SELECT event_id, replay, k OR CASE WHEN v = 0 THEN 1.0 ELSE v END > 5.0 AS social_overheat, k AS panic_risk, NOT k AND CASE WHEN v = 0 THEN 1.0 ELSE v END > 3.0 AS fomo_risk,
 CASE WHEN k THEN 10.0::DOUBLE END AS fear_greed_index, CASE WHEN k THEN 'extreme_fear' ELSE 'unknown' END AS fear_greed_zone, CASE WHEN k THEN 'low' ELSE 'normal' END AS sentiment_reliability FROM r"""))
def rk3(spark, sf_dir):
    """Every fifth message has stored indicators; the others are judged by their velocity, 1 where it is 0."""
    e = F.col("event_id")
    raw = F.when(e % 5 == 0, '{"risk_indicators": {"social_overheat": true, "panic_risk": true, "fomo_risk": false, "fear_greed_index": 10, "fear_greed_zone": "extreme_fear", "sentiment_reliability": "low"}}')
    m = messages(spark, sf_dir).withColumns({"velocity": F.when(e % 6 == 0, 0.0).otherwise(F.col("likes") / F.lit(15.0)), "raw_data": raw})
    return scoring.risk_indicators(m, "context", stored="raw_data").select(*ID, "social_overheat", "panic_risk", "fomo_risk", "fear_greed_index", "fear_greed_zone", "sentiment_reliability")


@register("rk4_orchestrated_risk", with_messages(f""", {SENT}, r AS (SELECT * REPLACE (CASE WHEN event_id % 5 = 0 THEN 0 ELSE label END AS label), coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE replies * 1.0::DOUBLE END, 1.0) AS velocity FROM scored)
 SELECT event_id, replay, label = -1 AND velocity >= 2.0 AS panic_risk, FALSE AS social_overheat, FALSE AS fomo_risk, 'normal' AS fear_greed_zone FROM r"""))
def rk4(spark, sf_dir):
    m = _risky(spark, sf_dir).withColumns({"label": F.when(F.col("event_id") % 5 != 0, F.col("label")), "velocity": F.when(F.col("event_id") % 3 != 0, F.col("velocity")), "anomaly": F.lit(None).cast("boolean"), "fear_greed_index": F.lit(None).cast("double")})
    return scoring.risk_indicators(m, "orchestrated").select(*ID, "panic_risk", "social_overheat", "fomo_risk", "fear_greed_zone")


@register("rk5_trading_gate", with_messages("""SELECT event_id, replay, reason, CASE WHEN reason = 'Trading allowed' THEN 'allow' WHEN reason IN ('Sentiment reliability is low', 'Data quality is degraded', 'FOMO risk detected') THEN 'reduce' ELSE 'block' END AS action
 FROM (SELECT *, CASE WHEN event_id % 5 = 0 THEN 'No social data available' WHEN event_id % 5 = 1 THEN 'Data quality is critical' WHEN event_id % 7 = 0 THEN 'Panic risk detected' WHEN event_id % 3 = 0 THEN 'Extreme fear zone' WHEN event_id % 11 = 0 THEN 'Social overheat detected' WHEN event_id % 13 = 0 THEN 'Sentiment reliability is low' WHEN event_id % 5 = 2 THEN 'Data quality is degraded' WHEN event_id % 17 = 0 THEN 'FOMO risk detected' ELSE 'Trading allowed' END AS reason FROM m)"""))
def rk5(spark, sf_dir):
    e = F.col("event_id")
    m = messages(spark, sf_dir).withColumns({"overall": F.when(e % 5 == 1, "critical").when(e % 5 == 2, "degraded").when(e % 5 > 2, "healthy"), "panic_risk": e % 7 == 0, "social_overheat": e % 11 == 0, "fomo_risk": F.when(e % 17 == 0, True), "sentiment_reliability": F.when(e % 13 == 0, "low").otherwise("normal"), "fear_greed_zone": F.when(e % 3 == 0, "extreme_fear").otherwise("normal")})
    return scoring.trading_gate(m).select(*ID, "reason", "action")


# ---- text over documents -------------------------------------------------------------------------------------------

DOC_TERMS = {"bullish": ["the", "of the"], "bearish": ["and"], "fear": ["is", "que"], "greed": ["de", "des"]}


@register("tx1_clean_text", rf"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), 'https?://\S+|www\.\S+', '', 'g'), '{C.EMOJI}', '', 'g')) AS cleaned FROM documents")
def tx1(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.clean_text(F.col("text"))).alias("cleaned"))


#: Word borders know accented letters in Spark but not in the oracle, which reads them as plain ones.
_PLAIN = "regexp_replace(text, '[\u00c0-\u024f]', 'w', 'g')"


@register("tx2_lexicon_counts", "SELECT doc_id, " + ", ".join(f"CAST({_words(t, _PLAIN)} AS BIGINT) AS {k}" for k, t in DOC_TERMS.items()) + " FROM documents")
def tx2(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[v.cast("long").alias(k) for k, v in C.lexicon_counts(F.col("text"), DOC_TERMS).items()])


@register("tx3_regex_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '(?i)[a-z]+ing')) AS BIGINT) AS ing, CAST(len(regexp_extract_all(text, '(?i)[0-9]{2,4}')) AS BIGINT) AS numbers FROM documents")
def tx3(spark, sf_dir):
    counts = C.regex_counts(F.col("text"), {"ing": ["[a-z]+ing"], "numbers": ["[0-9]{2,4}"]})
    return table(spark, sf_dir, "documents").select("doc_id", *[v.cast("long").alias(k) for k, v in counts.items()])


@register("tx4_token_hits", rf"SELECT doc_id, CAST(len(list_intersect(list_distinct(string_split_regex(lower(text), '[ \n\t\r\f]+')), ['the', 'of', 'and', 'que', 'der', 'une'])) AS BIGINT) AS hits FROM documents")
def tx4(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.token_hits(F.col("text"), ["the", "of", "and", "que", "der", "une"]).cast("long").alias("hits"))


@register("tx5_substring_hits", "SELECT doc_id, CAST(" + _subs(["token", "license", "idiot", "stth", "ción"]) + " AS BIGINT) AS hits FROM documents")
def tx5(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.substring_hits(F.col("text"), ["token", "license", "idiot", "stth", "ción"]).cast("long").alias("hits"))


@register("tx7_phrase_keys", r"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\s]', '', 'g'), '\s+', ' ', 'g'))) AS phrase_b FROM documents")
def tx7(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.phrase_key_b(F.col("text"))).alias("phrase_b"))


@register("ts2_parse_times", """SELECT event_id, t AS parsed, strftime(t, '%Y-%m-%dT%H:%M:%SZ') AS shown, event_id % 4 = 0 AS strict FROM (SELECT event_id, date_trunc('second', ts) AS t FROM events)""")
def ts2(spark, sf_dir):
    """Four spellings of one time are read back alike; the strict parser takes only the first."""
    e = table(spark, sf_dir, "events").select("event_id", F.date_trunc("second", "ts").alias("t"))
    n = F.col("event_id") % 4
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss")
    spelt = F.when(n == 0, F.concat(iso, F.lit("Z"))).when(n == 1, F.date_format("t", "yyyy-MM-dd HH:mm:ss")).when(n == 2, F.unix_timestamp("t").cast("string")).otherwise(F.concat(F.date_format("t", "E MMM dd HH:mm:ss "), F.lit("+0000 "), F.date_format("t", "yyyy")))
    e = e.withColumn("spelt", spelt)
    parsed = C.parse_ts(F.col("spelt"))
    return e.select("event_id", parsed.cast("timestamp_ntz").alias("parsed"), C.format_ts(parsed).alias("shown"), C.parse_ts_strict(F.col("spelt")).isNotNull().alias("strict"))


@register("fp_fingerprints", with_messages("""SELECT event_id, replay, md5(source || ':' || message_id || ':' || text) AS store, substr(md5(source || ':' || message_id || ':' || substr(text, 1, 50)), 1, 16) AS batch, substr(md5(message_id), 1, 16) AS id,
 substr(sha256(message_id || ':' || substr(text, 1, 100)), 1, 16) AS scrape, sha256(source || '|' || asset || '|' || CAST(event_s AS VARCHAR) || '|' || lower(trim(text))) AS guard FROM m"""))
def fp(spark, sf_dir):
    c = {k: F.col(k) for k in ("source", "asset", "message_id", "text")} | {"timestamp": F.col("event_s").cast("string")}
    return messages(spark, sf_dir).select(*ID, *[C.fingerprint(p, **c).alias(p) for p in ("store", "batch", "id", "scrape", "guard")])


@register("ew_aw_weights", with_messages("""SELECT event_id, replay, round(ln(1 + likes + 2 * reposts + replies), 6) AS engagement_log, CASE source WHEN 'twitter' THEN likes + 2.0::DOUBLE * reposts + 1.5::DOUBLE * replies WHEN 'reddit' THEN likes + 2.0::DOUBLE * replies ELSE 0.1::DOUBLE * likes + 5.0::DOUBLE * reposts END AS engagement_linear,
 round(ln(1 + followers), 6) AS author_log, CASE source WHEN 'twitter' THEN least(10.0::DOUBLE, followers / 10000.0::DOUBLE) * CASE WHEN event_id % 2 = 0 THEN 1.5 ELSE 1.0 END WHEN 'reddit' THEN least(10.0::DOUBLE, followers / 10000.0::DOUBLE) ELSE 1.0 END AS author_linear FROM m"""))
def weights(spark, sf_dir):
    c = F.col
    linear = C.engagement_linear(c("source"), likes=c("likes"), reposts=c("reposts"), replies=c("replies"), score=c("likes"), comments=c("replies"), views=c("likes"), forwards=c("reposts"))
    return messages(spark, sf_dir).select(*ID, F.round(C.engagement_log(c("likes"), c("reposts"), c("replies")), 6).alias("engagement_log"), linear.alias("engagement_linear"), F.round(C.author_log(c("followers")), 6).alias("author_log"), C.author_linear(c("source"), c("followers"), c("event_id") % 2 == 0).alias("author_linear"))


@register("jn5_detect_assets", "SELECT doc_id, coalesce(CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), $${k}$$)' for k in kws)} THEN '{s}'" for s, _, kws, _ in sorted(P.ASSETS, key=lambda r: (-r[3], r[0]))) + " END, 'BTC') AS asset_found FROM documents")
def jn5(spark, sf_dir):
    return tables.detect_assets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "asset_found")


# ---- validation ----------------------------------------------------------------------------------------------------

_BROKEN = "SELECT * REPLACE (CASE WHEN event_id % 13 = 0 THEN NULL ELSE text END AS text, CASE WHEN event_id % 17 = 0 THEN NULL ELSE likes END AS likes, CASE WHEN event_id % 19 = 0 THEN NULL ELSE event_s END AS event_s, CASE WHEN event_id % 23 = 0 THEN 'forum' ELSE source END AS source) FROM m"


def broken(spark, sf_dir):
    """Messages with planted faults."""
    e = F.col("event_id")
    put = {c: F.when(e % k != 0, F.col(c)) for c, k in (("text", 13), ("likes", 17), ("event_s", 19))}
    return messages(spark, sf_dir).withColumns(put | {"source": F.when(e % 23 == 0, "forum").otherwise(F.col("source"))})


@register("fil1_sentiment_input", with_messages(f", b AS ({_BROKEN}) SELECT event_id, replay, CASE WHEN source NOT IN ('twitter', 'reddit', 'telegram') THEN 'unknown_source' WHEN text IS NULL THEN 'missing_text' WHEN event_s IS NULL THEN 'missing_timestamp' WHEN likes IS NULL THEN 'missing_engagement' END AS drop_reason FROM b"))
def fil1(spark, sf_dir):
    return validation.validate_sentiment_input(broken(spark, sf_dir)).select(*ID, "drop_reason")


@register("fil2_twitter", with_messages(f", b AS ({_BROKEN}) SELECT event_id, replay, CASE WHEN text IS NULL THEN 'missing_text' WHEN NOT contains(text, 'moon') AND NOT contains(text, 'buy') THEN 'no_asset' WHEN event_s IS NULL THEN 'missing_timestamp' WHEN coalesce(likes, 0) + reposts + replies <= 0 THEN 'no_engagement' WHEN user_private THEN 'private' WHEN event_id % 29 = 0 THEN 'ad' END AS drop_reason FROM (SELECT *, event_id % 31 = 0 AS user_private FROM b)"))
def fil2(spark, sf_dir):
    b = broken(spark, sf_dir).withColumns({"is_private": F.col("event_id") % 31 == 0, "is_ad": F.col("event_id") % 29 == 0})
    return validation.validate_twitter(b, F.contains("text", F.lit("moon")) | F.contains("text", F.lit("buy"))).select(*ID, "drop_reason")


@register("fil3_reddit", with_messages(f", b AS ({_BROKEN}) SELECT event_id, replay, CASE WHEN text IS NULL THEN 'missing_text' WHEN likes IS NOT NULL AND likes <= 0 THEN 'low_score' WHEN reposts < 1 THEN 'depth' WHEN likes IS NULL THEN 'missing_comments' END AS drop_reason FROM b"))
def fil3(spark, sf_dir):
    b = broken(spark, sf_dir).withColumns({"score": F.col("likes"), "depth": F.col("reposts"), "comments": F.col("likes"), "karma": F.col("followers")})
    return validation.validate_reddit(b).select(*ID, "drop_reason")


@register("fil4_telegram", with_messages(f", b AS ({_BROKEN}) SELECT event_id, replay, CASE WHEN text IS NULL THEN 'missing_text' WHEN NOT contains(text, 'moon') AND NOT contains(text, 'buy') THEN 'no_asset' WHEN event_s IS NULL THEN 'missing_timestamp' WHEN event_id % 7 = 0 THEN 'not_public' WHEN event_id % 3 = 0 AND event_id % 2 <> 0 THEN 'missing_channel' END AS drop_reason FROM b"))
def fil4(spark, sf_dir):
    e = F.col("event_id")
    b = broken(spark, sf_dir).withColumns({"is_public": F.when(e % 7 != 0, True), "channel": F.when(e % 3 != 0, F.col("channel")), "group_id": F.when(e % 2 == 0, F.col("message_id"))})
    return validation.validate_telegram(b, F.contains("text", F.lit("moon")) | F.contains("text", F.lit("buy"))).select(*ID, "drop_reason")


@register("fil12_worker_raw", with_messages(f", b AS ({_BROKEN}) SELECT event_id, replay, CASE WHEN text IS NULL THEN 'Missing text content' WHEN event_s IS NULL THEN 'Missing timestamp' WHEN NOT contains(text, 'moon') THEN 'No keyword match' END AS drop_reason FROM b"))
def fil12(spark, sf_dir):
    return validation.validate_raw(broken(spark, sf_dir), ("moon",)).select(*ID, "drop_reason")


@register("fil13_risk_input", with_messages(f", b AS ({_BROKEN}) SELECT event_id, replay, array_to_string(list_filter([CASE WHEN event_s IS NULL THEN 'timestamp' END, CASE WHEN likes IS NULL THEN 'sentiment.final.label' END, CASE WHEN likes NOT IN (-1, 0, 1) THEN 'sentiment.final.label invalid' END], lambda x: x IS NOT NULL), ', ') AS note FROM b"))
def fil13(spark, sf_dir):
    b = broken(spark, sf_dir).withColumns({"label": F.col("likes"), "velocity": F.lit(1.0), "anomaly": F.lit(False)})
    return validation.validate_risk_input(b).select(*ID, "note")


@register("fil15_batch_summary", with_messages(f", b AS ({_BROKEN}) SELECT channel AS request_id, count(*) AS received, count(text) AS processed, count(*) - count(text) AS dropped, CASE WHEN count(text) = 0 THEN 'BLOCK_TRADING' END AS fallback FROM b GROUP BY channel"))
def fil15(spark, sf_dir):
    b = broken(spark, sf_dir).withColumns({"request_id": F.col("channel"), "drop_reason": F.when(F.col("text").isNull(), "missing_text")})
    return validation.batch_summary(b)


@register("fil17_drop_metrics", with_messages(f", b AS ({_BROKEN}) SELECT source, CASE WHEN text IS NULL THEN 'Missing text content' WHEN event_s IS NULL THEN 'Missing timestamp' WHEN NOT contains(text, 'moon') THEN 'No keyword match' ELSE 'accepted' END AS reason, count(*) AS n FROM b GROUP BY 1, 2"))
def fil17(spark, sf_dir):
    return products.drop_metrics(validation.validate_raw(broken(spark, sf_dir), ("moon",)), "drop_reason")
