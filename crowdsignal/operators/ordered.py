"""Operators that depend on arrival order: time guard, velocity, repetition, caps of a run.

All are windows over (key, slice of time), so keys spread over the cluster. Times are whole
seconds or microseconds in BIGINT columns, which makes half-open frames exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import profiles as P
from ..scratch import materialize, small

#: Parts in which a key's rows are looked through for its first ones.
_SALTS = 64


def sliced(df: DataFrame, ts: str, width: int, slices: int = 8) -> DataFrame:
    """``df`` with ``_slice``, so that a window of the last ``width`` units can be taken within (key, slice).

    A slice is ``slices`` widths long; rows of its last width are in the next one too, marked ``_ghost``, to be left out
    of the result. A key with any share of the rows is thus spread over time. Rows without a time are a slice of their own.
    """
    own = F.floor(F.col(ts) / (width * slices))
    after = F.floor((F.col(ts) + width) / (width * slices))
    spans = F.when(own.isNull(), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(own, after))
    return df.withColumn("_slice", F.explode(spans)).withColumn("_ghost", F.coalesce(F.col("_slice") != own, F.lit(False)))


def time_guard(df: DataFrame, event: str = "event_s", arrival: str = "arrival_s", order: tuple[str, ...] = ("arrival_s", "event_id", "replay"), fingerprint: str = "fingerprint", slice_s: int = 3600) -> DataFrame:
    """Adds ``guard_reason``: the first of invalid_timestamp, unknown_source, future, late, out_of_order, duplicate; null if accepted.

    Sources are named in any case. Out of order: below the largest earlier event time of the source and asset, less the
    tolerance. That maximum only moves on rows past the future and late tests (a row dropped later cannot raise it), so it
    is a running maximum: within slices of ``slice_s`` of arrival, on top of the earlier slices' maxima, so that a source
    is never in one task (``order`` begins with the arrival). Duplicate: the fingerprint was accepted earlier. It must be
    made over the event time, as ``fingerprint("guard")`` is: then the duplicate window is longer than the largest delay,
    any repeat that passes the late test falls inside it, and keep-first is exact. For fingerprints without the time there
    is ``admission.flag_duplicates``. The first of a fingerprint is a minimum taken before rows shuffle.
    """
    source = F.lower("source")
    known = source.isin(*P.MAX_DELAY)
    lag = F.col(arrival) - F.col(event)
    early = F.when(F.col(event).isNull() | F.col(arrival).isNull(), "invalid_timestamp").when(source.isNull() | ~known, "unknown_source").when(lag < 0, "future").when(lag > C.by_source(source, P.MAX_DELAY), "late")
    keys = {"_source": F.coalesce(source, F.lit("")), "_asset": F.coalesce("asset", F.lit("")), "_part": F.coalesce(F.floor(F.col(arrival) / slice_s), F.lit(-1))}
    out = df.withColumn("_early", early).withColumns(keys)
    valid = F.max(F.when(F.col("_early").isNull(), F.col(event)))
    parts = out.groupBy(*keys).agg(valid.alias("_most"))
    earlier = Window.partitionBy("_source", "_asset").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    out = out.join(parts.select(*keys, F.max("_most").over(earlier).alias("_carried")), list(keys))
    seen = F.greatest("_carried", valid.over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)))
    ordered = F.when(F.col("_early").isNull() & (F.col(event) < seen - C.by_source(source, P.ORDER_TOLERANCE)), "out_of_order")
    out = out.withColumn("_early", F.coalesce("_early", ordered))
    at = F.struct(*order)
    first = out.where("_early is null").groupBy(F.col(fingerprint).alias("_of")).agg(F.min(at).alias("_first"))
    out = out.join(first, F.col(fingerprint).eqNullSafe(F.col("_of")), "left")
    return out.withColumn("guard_reason", F.coalesce("_early", F.when(at > F.col("_first"), "duplicate"))).select(*df.columns, "guard_reason")


def time_check(df: DataFrame, event: str = "event_s", arrival: str = "arrival_s", future: int = 5, delay: int = 300) -> DataFrame:
    """Adds ``time_reason``: future beyond 5 s, delayed beyond 300 s, null if fine."""
    lag = F.col(arrival) - F.col(event)
    return df.withColumn("time_reason", F.when(lag.isNull(), "invalid_timestamp").when(lag < -future, "future").when(lag > delay, "delayed"))


def velocity(df: DataFrame, profile: str = "ing_tw", by: tuple[str, ...] = ("source",), ts: str = "event_s", order: tuple[str, ...] = ("event_id",), exact: bool = False) -> DataFrame:
    """Adds ``velocity``: the short window's rate over the long one's, counting a row and those before it.

    Rows with one time are counted in ``order``: peers that come later are taken off the range frame's count. ``exact``
    leaves out the profile's rounding. Windows are taken within slices of time, so no key is in one task.
    """
    p = P.VELOCITY[profile]
    edge = 1 if p["open"] else 0
    rows = sliced(df, ts, p["long"])
    peers = Window.partitionBy(*by, "_slice", ts)
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy(*order))
    over = lambda s: F.count("*").over(Window.partitionBy(*by, "_slice").orderBy(ts).rangeBetween(-(s - edge), 0)) - later
    short, long = over(p["short"]) / F.lit(float(p["short"])), over(p["long"]) / F.lit(float(p["long"]))
    ratio = F.when(long > 0, short / long).otherwise(p["default"])
    out = rows.withColumn("velocity", ratio if exact or p["digits"] is None else F.round(ratio, p["digits"]))
    return out.where(~F.col("_ghost")).drop("_slice", "_ghost")


def recent_count(df: DataFrame, by: tuple[str, ...], seconds: int, ts: str = "event_s", order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Adds ``recent``: the key's rows of the last ``seconds`` (both ends included) up to this one, itself among them."""
    rows = sliced(df, ts, seconds)
    peers = Window.partitionBy(*by, "_slice", ts)
    later = F.count("*").over(peers) - F.row_number().over(peers.orderBy(*order))
    n = F.count("*").over(Window.partitionBy(*by, "_slice").orderBy(ts).rangeBetween(-seconds, 0)) - later
    return rows.withColumn("recent", n).where(~F.col("_ghost")).drop("_slice", "_ghost")


def velocity_asof(df: DataFrame, as_of: int, profile: str = "crawl_tg", by: tuple[str, ...] = ("channel",), ts: str = "event_s") -> DataFrame:
    """One row per key: events of the short window before ``as_of`` over the long one's mean; 1 where that is 0."""
    short, long = P.VELOCITY_ASOF[profile]
    n = lambda w: F.count_if(F.col(ts) >= as_of - w)
    out = df.groupBy(*by).agg(n(short).alias("short_count"), n(long).alias("long_count"))
    return out.withColumn("velocity", F.when(F.col("long_count") > 0, F.col("short_count") / (F.col("long_count") / F.lit(long / short))).otherwise(1.0))


def flag_repeats(df: DataFrame, profile: str = "engine", times: int = 3, key: Column | None = None, window: int = 600, ts: str = "event_s", order: tuple[str, ...] = ("event_s", "event_id", "replay")) -> DataFrame:
    """Adds ``repeated``: the third or later use of a phrase in a channel, ever (``engine``) or within a trailing window (``crawl``)."""
    if profile == "engine":
        phrase = F.substring(F.lower(F.trim("text")), 1, 100) if key is None else key
        rows = df.withColumns({"_phrase": F.coalesce(phrase, F.lit("\0")), "_place": F.coalesce("channel", F.lit("\0")), "_at": F.struct(*order)})
        own = ["_place", "_phrase"]
        best = lambda d, by: d.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_at"))).where(F.col("_n") <= times)
        few = best(rows.select(*own, "_at").withColumn("_salt", F.pmod(F.xxhash64("_at"), F.lit(_SALTS))), [*own, "_salt"])
        nth = best(few.drop("_salt", "_n"), own).where(F.col("_n") == times).select(*own, F.col("_at").alias("_nth"))
        return rows.join(nth, own, "left").withColumn("repeated", F.coalesce(F.col("_at") >= F.col("_nth"), F.lit(False))).select(*[c for c in df.columns if c != "repeated"], "repeated")
    phrase = C.fingerprint("phrase_a", text=F.col("text")) if key is None else key
    rows = sliced(df.withColumn("_phrase", phrase), ts, window)
    n = F.count("*").over(Window.partitionBy("channel", "_phrase", "_slice").orderBy(ts).rangeBetween(-window, 0))
    return rows.withColumn("repeated", n >= times).where(~F.col("_ghost")).drop("_phrase", "_slice", "_ghost")


def flag_coordinated(df: DataFrame, chats: int = 3, window: int = 300, ts: str = "event_s") -> DataFrame:
    """Adds ``coordinated``: the phrase was used in three chats within the last five minutes, the start excluded.

    A phrase's rows are first reduced to one per chat and second, and its seconds are spread over slices of time, so that
    a phrase that a third of all rows use is in many tasks. Within a slice every (second, chat) counts for the seconds of
    its window; no list of chats is gathered.
    """
    keyed = df.withColumn("phrase", C.fingerprint("phrase_b", text=F.col("text")))
    once = keyed.where(F.col(ts).isNotNull() & F.col("channel").isNotNull()).select("phrase", F.col(ts).alias("_t"), "channel").distinct()
    rows = sliced(once, "_t", window)
    last = Window.partitionBy("phrase", "_slice", "channel").orderBy("_t")
    # a chat is within the window from a use of it to the window's end or its next use, whichever is first
    until = F.least(F.col("_t") + window, F.coalesce(F.lead("_t").over(last), F.col("_t") + window))
    steps = rows.withColumn("_until", until).withColumn("_step", F.explode(F.array(F.struct(F.col("_t").alias("at"), F.lit(1).alias("by")), F.struct(F.col("_until").alias("at"), F.lit(-1).alias("by")))))
    change = steps.groupBy("phrase", "_slice", F.col("_step.at").alias(ts)).agg(F.sum("_step.by").alias("_by"))
    active = change.withColumn("_n", F.sum("_by").over(Window.partitionBy("phrase", "_slice").orderBy(ts)))
    spread = active.where((F.col("_slice") == F.floor(F.col(ts) / (window * 8))) & (F.col("_n") >= chats)).select("phrase", ts, F.lit(True).alias("coordinated"))
    return keyed.join(spread, ["phrase", ts], "left").withColumn("coordinated", F.coalesce("coordinated", F.lit(False)))


def flag_pump_terms(df: DataFrame, terms: list[str] = P.PUMP_TERMS) -> DataFrame:
    """Adds ``manipulation``: a telegram text that holds one of the terms."""
    return df.withColumn("manipulation", (F.col("source") == "telegram") & (C.substring_hits(F.coalesce("text", F.lit("")), terms) > 0))


def admit_per_run(df: DataFrame, by: tuple[str, ...], per_key: int, overall: int, order: tuple[str, ...]) -> DataFrame:
    """Adds ``run_reason``: source_rate beyond the key's quota, else global_rate beyond the run's, null if admitted.

    ``order`` is total. The last row that the run admits is found by a distributed top ``overall``; the others are
    compared with it, so that no task orders the whole run.
    """
    out = df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_at", F.struct(*order))
    taken = out.where(F.col("_n") <= per_key).select("_at", *order).orderBy(*order).limit(overall)
    cut = taken.agg(F.max("_at").alias("_cut"), F.count("*").alias("_taken"))
    late = (F.col("_taken") >= overall) & (F.lit(overall <= 0) | (F.col("_at") > F.col("_cut")))
    reason = F.when(F.col("_n") > per_key, "source_rate").when(late, "global_rate")
    return out.crossJoin(F.broadcast(cut)).withColumn("run_reason", reason).drop("_n", "_at", "_cut", "_taken")


def alert_stats(sent: DataFrame, as_of: int, by: tuple[str, ...] = ("alert_key",), quiet: int = 600, ts: str = "arrival_s") -> DataFrame:
    """Per key of ``admission.suppress_alerts``: alerts sent and suppressed, the last one sent, and seconds until the next may be."""
    last = F.max(F.when(F.col("sent"), F.col(ts)))
    out = sent.groupBy(*by).agg(F.count_if("sent").alias("n_sent"), F.count_if(~F.col("sent")).alias("n_suppressed"), last.alias("last_sent"))
    return out.withColumn("wait_s", F.coalesce(F.greatest(F.lit(0), quiet - (F.lit(as_of) - F.col("last_sent"))), F.lit(0)))


def sort_by_event_time(df: DataFrame, ts: str = "event_s", order: tuple[str, ...] = ("event_id", "replay")) -> DataFrame:
    """All rows by time, those without one first; rows of one time in ``order``. A range sort, so no task holds the table."""
    return df.orderBy(F.col(ts).asc_nulls_first(), *[F.col(o).asc_nulls_first() for o in order])


def with_places(df: DataFrame, ts: str = "event_s", order: tuple[str, ...] = ("event_id", "replay"), name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in the order of ``sort_by_event_time``.

    Rows are range-sorted and written once with their task and place in it; the counts of the tasks tell where each one's
    rows begin, so no task numbers the table.
    """
    sort = [F.col(ts).asc_nulls_first(), *[F.col(o).asc_nulls_first() for o in order]]
    placed = materialize(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()), "places")
    placed = placed.withColumns({"_task": F.shiftright("_at", 33), "_no": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    before = Window.orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy(F.col("_task").alias("_of")).agg(F.count("*").alias("_n")).select("_of", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(small(starts), F.col("_task") == F.col("_of")).withColumn(name, F.col("_before") + F.col("_no") + 1).drop("_at", "_task", "_no", "_of", "_before")


def latest_per(df: DataFrame, by: tuple[str, ...], ts: str, order: tuple[str, ...] = (), k: int = 1) -> DataFrame:
    """The ``k`` newest rows of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(ts), *[F.desc(o) for o in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def dedupe_first(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """The first row of each key in order; rows with a null key all stay, and do not shuffle.

    A key's rows are first reduced within salted parts, so that one with a third of all rows is in many tasks.
    """
    null = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in by])
    salted = df.where(~null).withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(_SALTS)))
    best = lambda d, keys: d.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")
    return best(best(salted, [*by, "_salt"]).drop("_salt"), by).union(df.where(null))
