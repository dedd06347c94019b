"""Queries of the order-sensitive operators, cursors, registry joins and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import profiles as P
from ..operators import admission, ordered, products, tables, validation
from .core import ID, SENT, scored_messages
from .inputs import messages, table, with_messages
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles

_FP = "md5(source || ':' || message_id || ':' || text)"
_CASES = lambda d: "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in d.items()) + " END"
_GUARD_FP = "sha256(source || '|' || asset || '|' || CAST(event_s AS VARCHAR) || '|' || lower(trim(text)))"
GUARD = f"""g1 AS (SELECT *, {_GUARD_FP} AS fingerprint, CASE WHEN arrival_s < event_s THEN 'future' WHEN arrival_s - event_s > {_CASES(P.MAX_DELAY)} THEN 'late' END AS e1 FROM m),
 g2 AS (SELECT *, max(CASE WHEN e1 IS NULL THEN event_s END) OVER (PARTITION BY source, asset ORDER BY arrival_s, event_id, replay ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM g1),
 g3 AS (SELECT *, coalesce(e1, CASE WHEN event_s < seen - {_CASES(P.ORDER_TOLERANCE)} THEN 'out_of_order' END) AS e2 FROM g2),
 guarded AS (SELECT *, coalesce(e2, CASE WHEN row_number() OVER (PARTITION BY fingerprint, e2 IS NULL ORDER BY arrival_s, event_id, replay) > 1 THEN 'duplicate' END) AS guard_reason FROM g3)"""


def guarded(spark, sf_dir):
    m = messages(spark, sf_dir)
    c = {n: F.col(n) for n in ("source", "asset", "text")}
    return ordered.time_guard(m.withColumn("fingerprint", C.fingerprint("guard", timestamp=F.col("event_s").cast("string"), **c)))


@register("tg5_time_guard", with_messages(f", {GUARD} SELECT event_id, replay, guard_reason FROM guarded"))
def tg5(spark, sf_dir):
    return guarded(spark, sf_dir).select(*ID, "guard_reason")


@register("tg6_time_check", with_messages("SELECT event_id, replay, CASE WHEN arrival_s - event_s < -2 THEN 'future' WHEN arrival_s - event_s > 30 THEN 'delayed' END AS time_reason FROM m"))
def tg6(spark, sf_dir):
    return ordered.time_check(messages(spark, sf_dir), future=2, delay=30).select(*ID, "time_reason")


def _velocity_sql(p: dict, by: str) -> str:
    e = 1 if p["open"] else 0
    over = lambda s: f"(count(*) OVER (PARTITION BY {by} ORDER BY event_s RANGE BETWEEN {s - e} PRECEDING AND CURRENT ROW) - later) / {s}.0::DOUBLE"
    return f""", v0 AS (SELECT *, count(*) OVER (PARTITION BY {by}, event_s) - row_number() OVER (PARTITION BY {by}, event_s ORDER BY event_id, replay) AS later FROM m),
 v1 AS (SELECT event_id, replay, {over(p['short'])} AS s, {over(p['long'])} AS l FROM v0) SELECT event_id, replay, round(CASE WHEN l > 0 THEN s / l ELSE {p['default']}::DOUBLE END, 6) AS ratio FROM v1"""


def _velocity(name: str, profile: str, by: tuple[str, ...]):
    @register(name, with_messages(_velocity_sql(P.VELOCITY[profile], ", ".join(by))))
    def run(spark, sf_dir):
        # rounded at six digits on both sides: two would put ties at the mercy of the last bit
        out = ordered.velocity(messages(spark, sf_dir), profile, by, order=("event_id", "replay"), exact=True)
        return out.select(*ID, F.round("velocity", 6).alias("ratio"))


_velocity("vl2_velocity_hour", "crawl_tw", ("source", "asset"))
_velocity("vl5_velocity_source", "ing_tw", ("source",))
_velocity("vl6_velocity_half_hour", "ing_rd", ("channel",))
_velocity("vl7_velocity_channel", "ing_tg", ("channel",))


def _last(m, column: str = "event_s") -> int:
    return int(m.agg(F.max(column)).first()[0] or 0)


@register("vl4_velocity_asof", with_messages(", n AS (SELECT max(event_s) AS t FROM m) SELECT channel, count(*) FILTER (event_s >= t - 600) AS short_count, count(*) FILTER (event_s >= t - 3600) AS long_count, CASE WHEN count(*) FILTER (event_s >= t - 3600) > 0 THEN round(count(*) FILTER (event_s >= t - 600) / (count(*) FILTER (event_s >= t - 3600) / 6.0::DOUBLE), 6) ELSE 1.0 END AS velocity FROM m, n GROUP BY channel"))
def vl4(spark, sf_dir):
    m = messages(spark, sf_dir)
    return ordered.velocity_asof(m, _last(m)).withColumn("velocity", F.round("velocity", 6))


@register("vl3_velocity_asof_days", with_messages(", n AS (SELECT max(event_s) AS t FROM m) SELECT source, count(*) FILTER (event_s >= t - 21600) AS short_count, count(*) FILTER (event_s >= t - 172800) AS long_count, CASE WHEN count(*) FILTER (event_s >= t - 172800) > 0 THEN round(count(*) FILTER (event_s >= t - 21600) / (count(*) FILTER (event_s >= t - 172800) / 8.0::DOUBLE), 6) ELSE 1.0 END AS velocity FROM m, n GROUP BY source"))
def vl3(spark, sf_dir):
    m = messages(spark, sf_dir)
    return ordered.velocity_asof(m, _last(m), "crawl_rd", ("source",)).withColumn("velocity", F.round("velocity", 6))


@register("vl1_velocity_ratio", with_messages("SELECT event_id, replay, CASE WHEN replies > 0 THEN round(reposts / replies::DOUBLE, 6) END AS ratio, reposts / 30.0::DOUBLE * 60.0 AS per_minute FROM m"))
def vl1(spark, sf_dir):
    return messages(spark, sf_dir).select(*ID, F.round(C.velocity_ratio(F.col("reposts"), F.col("replies")), 6).alias("ratio"), C.events_per_minute(F.col("reposts"), 30.0).alias("per_minute"))


@register("mn1_repeats", with_messages("SELECT event_id, replay, row_number() OVER (PARTITION BY channel, substr(lower(trim(text)), 1, 100) ORDER BY event_s, event_id, replay) >= 3 AS repeated FROM m"))
def mn1(spark, sf_dir):
    return ordered.flag_repeats(messages(spark, sf_dir)).select(*ID, "repeated")


@register("mn2_repeats_window", with_messages(r"SELECT event_id, replay, count(*) OVER (PARTITION BY channel, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\d+', '', 'g'), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))) ORDER BY event_s RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) >= 3 AS repeated FROM m"))
def mn2(spark, sf_dir):
    return ordered.flag_repeats(messages(spark, sf_dir), "crawl").select(*ID, "repeated")


@register("mn3_coordinated", with_messages(", d AS (SELECT event_id, replay, len(list_distinct(list(channel) OVER (PARTITION BY text ORDER BY event_s RANGE BETWEEN 299 PRECEDING AND CURRENT ROW))) >= 3 AS coordinated FROM m) SELECT * FROM d"))
def mn3(spark, sf_dir):
    return ordered.flag_coordinated(messages(spark, sf_dir)).select(*ID, "coordinated")


@register("mn4_pump_terms", with_messages("SELECT event_id, replay, source = 'telegram' AND (" + " OR ".join(f"contains(lower(text), '{t}')" for t in P.PUMP_TERMS) + ") AS manipulation FROM m"))
def mn4(spark, sf_dir):
    return ordered.flag_pump_terms(messages(spark, sf_dir)).select(*ID, "manipulation")


def _fold(name: str, rows: str, by: str, limit: int, window: int | str) -> str:
    """Two recursive tables: the rows of ``rows`` numbered by key, and each with its decision and the times then remembered."""
    kept = f"list_filter({name}.kept, lambda x: x > {name}_rows.arrival_s - {window})"
    return f"""{name}_rows AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY arrival_s, event_id, replay) AS rn FROM {rows}),
 {name} AS (SELECT event_id, replay, {by}, rn, [arrival_s] AS kept, TRUE AS admitted FROM {name}_rows WHERE rn = 1
  UNION ALL SELECT {name}_rows.event_id, {name}_rows.replay, {name}_rows.{by}, {name}_rows.rn, CASE WHEN len({kept}) < {limit} THEN list_append({kept}, {name}_rows.arrival_s) ELSE {kept} END, len({kept}) < {limit}
  FROM {name} JOIN {name}_rows ON {name}.{by} = {name}_rows.{by} AND {name}_rows.rn = {name}.rn + 1)"""


def _recursive(sql: str) -> str:
    return with_messages(sql).replace("WITH m", "WITH RECURSIVE m", 1)


@register("adm1_sliding_admission", _recursive(f", {_fold('f', 'm', 'channel', 5, 60)} SELECT event_id, replay, admitted FROM f"))
def adm1(spark, sf_dir):
    """Five a minute and channel."""
    return admission.admit(messages(spark, sf_dir), ("channel",), 5).select(*ID, "admitted")


_JOINT = """, r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY arrival_s, event_id, replay) AS rn FROM m),
 f AS (SELECT event_id, replay, source, rn, [{'t': arrival_s, 'c': channel}] AS kept, NULL::VARCHAR AS rate_reason FROM r WHERE rn = 1
  UNION ALL SELECT event_id, replay, source, rn, CASE WHEN own < 2 AND len(kept) < 4 THEN list_append(kept, {'t': arrival_s, 'c': channel}) ELSE kept END, CASE WHEN own >= 2 THEN 'source_rate' WHEN len(kept) >= 4 THEN 'global_rate' END
  FROM (SELECT *, len(list_filter(kept, lambda x: x.c = channel)) AS own FROM (SELECT r.*, list_filter(f.kept, lambda x: x.t > r.arrival_s - 60) AS kept FROM f JOIN r ON f.source = r.source AND r.rn = f.rn + 1)))
 SELECT event_id, replay, rate_reason FROM f"""


@register("adm2_two_stage_admission", _recursive(_JOINT))
def adm2(spark, sf_dir):
    """Two a minute for each channel of a source and four for the source; a row that either drops uses up neither."""
    return admission.admit_jointly(messages(spark, sf_dir), ("source", "channel"), 2, ("source",), 4).select(*ID, "rate_reason")


@register("adm3_per_run_caps", with_messages(""", a AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY arrival_s, event_id, replay) AS n FROM m), b AS (SELECT *, sum(CASE WHEN n <= 100 THEN 1 ELSE 0 END) OVER (ORDER BY arrival_s, event_id, replay ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM a)
 SELECT event_id, replay, CASE WHEN n > 100 THEN 'source_rate' WHEN k > 500 THEN 'global_rate' END AS run_reason FROM b"""))
def adm3(spark, sf_dir):
    return ordered.admit_per_run(messages(spark, sf_dir), ("channel",), 100, 500, ("arrival_s", "event_id", "replay")).select(*ID, "run_reason")


@register("tg4_windowed_duplicates", _recursive(f", a AS (SELECT *, source || '|' || text AS fingerprint FROM m), {_fold('f', 'a', 'fingerprint', 1, "CASE split_part(f_rows.fingerprint, '|', 1) WHEN 'twitter' THEN 301 WHEN 'reddit' THEN 1801 ELSE 601 END")} SELECT event_id, replay, NOT admitted AS duplicate FROM f"))
def tg4(spark, sf_dir):
    """A text repeated within its source's window, which the fingerprint says nothing about."""
    m = messages(spark, sf_dir).withColumn("fingerprint", F.concat_ws("|", "source", "text"))
    return admission.flag_duplicates(m).select(*ID, "duplicate")


_QUIET = f", a AS (SELECT *, asset || '|' || source AS alert_key FROM m), {_fold('f', 'a', 'alert_key', 1, 60)}"


def _sent(spark, sf_dir):
    a = messages(spark, sf_dir).withColumn("alert_key", F.concat_ws("|", "asset", "source"))
    return admission.suppress_alerts(a, quiet=60, order=("event_id", "replay"))


@register("str8_alert_suppression", _recursive(f"{_QUIET} SELECT event_id, replay, admitted AS sent FROM f"))
def str8(spark, sf_dir):
    return _sent(spark, sf_dir).select(*ID, "sent")


@register("al2_alert_stats", _recursive(f"""{_QUIET}, n AS (SELECT max(arrival_s) + 20 AS t FROM m), s AS (SELECT a.alert_key, a.arrival_s, f.admitted FROM a JOIN f USING (event_id, replay))
 SELECT alert_key, count(*) FILTER (admitted) AS n_sent, count(*) FILTER (NOT admitted) AS n_suppressed, max(arrival_s) FILTER (admitted) AS last_sent, greatest(0, 60 - (max(t) - max(arrival_s) FILTER (admitted))) AS wait_s FROM s, n GROUP BY alert_key"""))
def al2(spark, sf_dir):
    return ordered.alert_stats(_sent(spark, sf_dir), _last(messages(spark, sf_dir), "arrival_s") + 20, quiet=60)


@register("rk0_latest_per_key", with_messages("SELECT event_id, replay, asset FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY event_s DESC, event_id DESC, replay DESC) AS n FROM m) WHERE n <= 1000"))
def rk0(spark, sf_dir):
    return ordered.latest_per(messages(spark, sf_dir), ("asset",), "event_s", ("event_id", "replay"), 1000).select(*ID, "asset")


@register("st2_dedupe_first", with_messages("SELECT event_id, replay FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY arrival_s, replay) AS n FROM m) WHERE n = 1"))
def st2(spark, sf_dir):
    return ordered.dedupe_first(messages(spark, sf_dir), ("message_id",), ("arrival_s", "replay")).select(*ID)


# ---- registry, cursors ---------------------------------------------------------------------------------------------

_REG = "(VALUES ('CH0', 'News zero', 'news', 'primary', TRUE, 5, 3, 'alive', 0), ('CH1', 'Whale one', 'whale', 'primary', TRUE, 10, 2, NULL, 1), ('CH2', 'Talk two', 'community', 'backup', TRUE, 20, 5, 'unknown', 2), ('CH3', 'Price three', 'price', 'backup', TRUE, 20, 1, 'dead', 0), ('CH4', 'Off four', 'other', 'primary', FALSE, 20, 4, 'alive', 0))"
_REG_COLUMNS = "reg(source_id, source_name, type, role, enabled, rate_limit, registry_priority, status, error_count)"


def registry(spark):
    return spark.sql(f"SELECT * FROM VALUES {_REG[8:-1]} AS {_REG_COLUMNS}")


@register("jn4_attach_registry", with_messages(f", reg AS (SELECT * FROM {_REG} AS {_REG_COLUMNS}) SELECT event_id, replay, CASE WHEN source_id IS NULL THEN 'unknown' WHEN NOT enabled THEN 'disabled' ELSE 'ok' END AS registry_state, rate_limit FROM m LEFT JOIN reg ON lower(channel) = lower(source_id)"))
def jn4(spark, sf_dir):
    return tables.attach_registry(messages(spark, sf_dir), registry(spark)).select(*ID, "registry_state", "rate_limit")


def _classified(spark, sf_dir, platform):
    """Messages with faults, a registry and limits, so that every rule drops some row."""
    e = F.col("event_id")
    m = tables.attach_registry(messages(spark, sf_dir), registry(spark))
    m = m.withColumns({"seen": e % 9 == 0, "source_ok": e % 4 != 0, "global_ok": e % 5 != 0, "message_id": F.when(e % 23 == 0, "").otherwise(F.col("message_id")), "text": F.when(e % 11 == 0, "  ").when(e % 13 != 0, F.col("text")), "event_s": F.when(e % 19 != 0, F.col("event_s")), "likes": F.when(e % 17 != 0, F.col("likes"))})
    m = m.withColumn("posted_at", F.when(e % 19 != 0, F.when(e % 7 == 0, F.date_trunc("minute", "ts")).when(e % 7 == 1, F.timestamp_add("MILLISECOND", F.lit(500), F.date_trunc("minute", "ts"))).otherwise(F.col("ts"))))
    return validation.classify_whitelisted(m, platform, F.contains("text", F.lit("o")), 3).select(*ID, "drop_reason")


def _state(disabled: str, rules: str) -> str:
    return f""", reg AS (SELECT * FROM {_REG} AS {_REG_COLUMNS}), j AS (SELECT m.*, source_id, enabled, CASE event_id % 7 WHEN 0 THEN date_trunc('minute', ts) WHEN 1 THEN date_trunc('minute', ts) + INTERVAL 500 MILLISECOND ELSE ts END AS posted FROM m LEFT JOIN reg ON lower(channel) = lower(source_id))
 SELECT event_id, replay, CASE WHEN source_id IS NULL THEN 'not_whitelisted' WHEN NOT enabled THEN '{disabled}' {rules} END AS drop_reason FROM j"""


_SEEN = "WHEN event_id % 9 = 0 THEN 'already_processed' WHEN event_id % 23 = 0 THEN 'missing_required_field' "
_EMPTY = "WHEN event_id % 13 = 0 AND event_id % 11 <> 0 THEN 'empty_text' WHEN event_id % 17 = 0 THEN 'missing_required_field' WHEN event_id % 11 = 0 THEN 'empty_text' "
_RATES = lambda own: f"WHEN event_id % 4 = 0 THEN '{own}' WHEN event_id % 5 = 0 THEN 'global_rate_exceeded' "
_WORD = "WHEN NOT contains(text, 'o') THEN 'no_asset_keyword' "


@register("fil9_whitelist_twitter", with_messages(_state("source_disabled", _SEEN + "WHEN event_id % 19 = 0 THEN 'invalid_timestamp' " + _EMPTY + "WHEN epoch_us(posted) % 60000000 = 0 THEN 'low_precision_timestamp' " + _WORD + _RATES("source_rate_exceeded"))))
def fil9(spark, sf_dir):
    return _classified(spark, sf_dir, "twitter")


@register("fil10_whitelist_reddit", with_messages(_state("subreddit_disabled", _SEEN + "WHEN event_id % 19 = 0 OR event_s <= 0 THEN 'invalid_timestamp' " + _EMPTY + "WHEN likes < 3 THEN 'low_score' " + _WORD + _RATES("subreddit_rate_exceeded"))))
def fil10(spark, sf_dir):
    return _classified(spark, sf_dir, "reddit")


@register("fil11_whitelist_telegram", with_messages(_state("source_disabled", _RATES("group_rate_exceeded") + "WHEN event_id % 13 = 0 OR event_id % 11 = 0 THEN 'empty_text' " + _WORD + "WHEN event_id % 19 = 0 THEN 'invalid_timestamp'")))
def fil11(spark, sf_dir):
    return _classified(spark, sf_dir, "telegram")


@register("jn7_after_cursor", with_messages(", h AS (SELECT max(event_s) // 2 AS t FROM m), c AS (SELECT channel, max(event_s) AS last_time FROM m, h WHERE event_s <= t AND channel <> 'ch5' GROUP BY channel) SELECT event_id, replay FROM m LEFT JOIN c USING (channel) WHERE last_time IS NULL OR event_s > last_time"))
def jn7(spark, sf_dir):
    m = messages(spark, sf_dir)
    half = _last(m) // 2
    cursors = m.where((F.col("event_s") <= half) & (F.col("channel") != "ch5")).groupBy("channel").agg(F.max("event_s").alias("last_time"))
    return tables.after_cursor(m, cursors).select(*ID)


@register("cur1_next_cursors", with_messages(f", {GUARD} SELECT channel, arg_max(message_id, (arrival_s, event_id, replay)) AS last_id, arg_max(event_s, (arrival_s, event_id, replay)) AS last_time, count(*) AS n FROM guarded WHERE guard_reason IS NULL GROUP BY channel"))
def cur1(spark, sf_dir):
    return tables.next_cursors(guarded(spark, sf_dir).where("guard_reason IS NULL"))


@register("cur3_cursor_max", with_messages("SELECT channel, arg_max(message_id, (arrival_s, event_id, replay)) AS last_id, max(event_s) AS last_time, count(*) AS n FROM m GROUP BY channel"))
def cur3(spark, sf_dir):
    return tables.next_cursors(messages(spark, sf_dir), mode="max")


@register("jn8_advance_id", with_messages("SELECT channel, max(event_id) AS last_id FROM m GROUP BY channel"))
def jn8(spark, sf_dir):
    return tables.advance_id_cursor(messages(spark, sf_dir))


# ---- stored tables -------------------------------------------------------------------------------------------------


def stored(spark, sf_dir):
    raw = messages(spark, sf_dir).withColumns({"raw_id": F.concat_ws("-", "message_id", F.col("replay").cast("string")), "dropped": F.when(F.col("event_id") % 6 == 0, True).when(F.col("event_id") % 6 == 1, False)})
    scores = scored_messages(spark, sf_dir).where("event_id % 4 <> 0").select(F.concat_ws("-", "message_id", F.col("replay").cast("string")).alias("raw_event_id"), F.round("score", 6).alias("score"), "label")
    return raw, scores


_STORED = f", {SENT}, raw AS (SELECT *, message_id || '-' || replay AS raw_id, CASE event_id % 6 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS dropped FROM m), sc AS (SELECT message_id || '-' || replay AS raw_event_id, round(score, 6) AS score, label FROM scored WHERE event_id % 4 <> 0)"


@register("jn1_raw_with_sentiment", with_messages(_STORED + " SELECT event_id, replay, sc.score, sc.label FROM raw LEFT JOIN sc ON raw_id = raw_event_id WHERE asset = 'BTC' AND event_s BETWEEN 0 AND 1000000000 AND coalesce(NOT dropped, TRUE)"))
def jn1(spark, sf_dir):
    raw, scores = stored(spark, sf_dir)
    return tables.raw_with_sentiment(raw, scores, "BTC", 0, 1_000_000_000).select(*ID, "score", "label")


@register("jn2_scored_messages", with_messages(_STORED + " SELECT event_id, replay, sc.score FROM raw JOIN sc ON raw_id = raw_event_id"))
def jn2(spark, sf_dir):
    raw, scores = stored(spark, sf_dir)
    return raw.join(scores, raw.raw_id == scores.raw_event_id).select(*ID, "score")


@register("jn3_unscored_messages", with_messages(_STORED + " SELECT event_id, replay FROM raw WHERE raw_id NOT IN (SELECT raw_event_id FROM sc)"))
def jn3(spark, sf_dir):
    raw, scores = stored(spark, sf_dir)
    return raw.join(scores, raw.raw_id == scores.raw_event_id, "left_anti").select(*ID)


@register("jn6_new_only", with_messages(f", f AS (SELECT *, {_FP} AS fp FROM m) SELECT event_id, replay FROM f WHERE fp NOT IN (SELECT fp FROM f WHERE event_id % 3 = 0)"))
def jn6(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("fingerprint", C.fingerprint("store", source=F.col("source"), message_id=F.col("message_id"), text=F.col("text")))
    return tables.new_only(m, m.where("event_id % 3 = 0")).select(*ID)


@register("so2_replay_raw", with_messages(_STORED + " SELECT event_id, replay FROM raw WHERE asset = 'ETH' AND source = 'reddit' AND event_s BETWEEN 100 AND 900000 AND (dropped IS NULL OR NOT dropped)"))
def so2(spark, sf_dir):
    return tables.replay_raw(stored(spark, sf_dir)[0], "ETH", 100, 900_000, "reddit").select(*ID)


@register("snk3_message_rows", with_messages("SELECT event_id, replay, CASE WHEN event_id % 9 = 0 THEN 'auto_' || substr(md5(source || ':' || '' || ':' || text), 1, 16) ELSE message_id END AS message_id, CASE WHEN replies = 0 THEN 1.0::DOUBLE ELSE replies::DOUBLE END AS velocity, 0.0::DOUBLE AS author_weight FROM m"))
def snk3(spark, sf_dir):
    m = messages(spark, sf_dir).withColumns({"message_id": F.when(F.col("event_id") % 9 != 0, F.col("message_id")), "velocity": F.col("replies").cast("double"), "author_weight": F.lit(None).cast("double"), "engagement_weight": F.lit(None).cast("double")})
    return tables.prepare_message_rows(m).select(*ID, "message_id", "velocity", "author_weight")


@register("snk4_sentiment_rows", with_messages(f", {SENT} SELECT event_id, replay, CASE label WHEN 1 THEN 'bullish' WHEN -1 THEN 'bearish' ELSE 'neutral' END AS label_name, round(CASE WHEN event_id % 3 = 0 THEN label ELSE score END * confidence, 6) AS weighted FROM scored"))
def snk4(spark, sf_dir):
    m = scored_messages(spark, sf_dir).withColumn("score", F.when(F.col("event_id") % 3 != 0, F.col("score")))
    return tables.prepare_sentiment_rows(m).select(*ID, "label_name", F.round("weighted", 6).alias("weighted"))


@register("snk6_upsert_latest", """WITH b AS (SELECT c_custkey, c_nationkey AS a, c_mktsegment AS s FROM customer), ch AS (SELECT o_custkey AS c_custkey, arg_max(CAST(o_orderpriority AS VARCHAR), o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS s FROM orders GROUP BY 1)
 SELECT coalesce(b.c_custkey, ch.c_custkey) AS c_custkey, b.a, coalesce(ch.s, b.s) AS s FROM b FULL JOIN ch ON b.c_custkey = ch.c_custkey""")
def snk6(spark, sf_dir):
    """Customers with the priority of their last order (low ones change nothing) put over the market segment."""
    base = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("s"))
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(None).cast(base.schema["a"].dataType).alias("a"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("s"), F.col("o_orderkey").alias("seq"))
    return tables.upsert_latest(base, changes, "c_custkey", ["a", "s"])


@register("hl1_channel_health", with_messages(f""", reg AS (SELECT * FROM {_REG} AS {_REG_COLUMNS}), p AS (SELECT upper(channel) AS c, max(event_s) AS last_s FROM m GROUP BY 1), n AS (SELECT max(event_s) + 44000 AS t FROM m),
 h AS (SELECT source_id, last_s, error_count, enabled, CASE WHEN source_id = 'CH3' THEN 'dead' WHEN source_id = 'CH2' THEN 'error' WHEN last_s IS NULL THEN 'unknown' WHEN t - last_s <= CASE type WHEN 'whale' THEN 12 WHEN 'community' THEN 48 WHEN 'price' THEN 12 ELSE 24 END * 3600 THEN 'alive' ELSE 'inactive' END AS health FROM reg LEFT JOIN p ON source_id = c, n)
 SELECT source_id, last_s, health AS status, CASE WHEN health = 'error' THEN error_count + 1 ELSE 0 END AS error_count, enabled AND NOT (health = 'dead' OR (health = 'error' AND error_count + 1 >= 3)) AS enabled FROM h"""))
def hl1(spark, sf_dir):
    m = messages(spark, sf_dir)
    reg = registry(spark).withColumn("observed", F.when(F.col("source_id") == "CH3", "dead").when(F.col("source_id") == "CH2", "error"))
    health = tables.channel_health(reg, m.withColumn("channel", F.upper("channel")), _last(m) + 44_000)
    return tables.apply_health(health).select("source_id", "last_s", "status", "error_count", "enabled")
