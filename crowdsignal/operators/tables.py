"""Registry, cursors, assets, channel health, stored tables: joins and snapshot updates on small dimensions and large facts.

Dimensions are hinted for broadcast only through ``small``, which checks their size first; beyond the bound the join
shuffles like any other.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import profiles as P
from ..scratch import delete, drop, materialize, small


def attach_registry(df: DataFrame, registry: DataFrame, key: str = "channel") -> DataFrame:
    """Adds the source's role, rate limit and ``registry_state``: unknown, disabled or ok; names match without case."""
    dim = registry.select(F.lower("source_id").alias("_id"), "enabled", "role", "rate_limit", "registry_priority")
    out = df.join(small(dim), F.lower(F.col(key)) == F.col("_id"), "left")
    return out.withColumn("registry_state", F.when(F.col("_id").isNull(), "unknown").when(~F.col("enabled"), "disabled").otherwise("ok")).drop("_id", "enabled")


def eligible_channels(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("enabled") & (F.col("status").isNull() | F.col("status").isin("alive", "unknown"))).orderBy(F.desc("registry_priority"), "source_id")


def enabled_sources(registry: DataFrame, type: str | None = None, role: str | None = None) -> DataFrame:
    """The enabled sources, of a type or a role if given, by priority, then id."""
    out = registry.where("enabled")
    for column, value in (("type", type), ("role", role)):
        out = out.where(F.col(column) == value) if value is not None else out
    return out.orderBy(F.desc("registry_priority"), "source_id")


def sources_by_role(registry: DataFrame) -> DataFrame:
    """Per role the enabled sources' number and names, by priority."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("registry_priority")).alias("p"), "source_id"))), lambda s: s["source_id"]), ", ")
    return registry.where("enabled").groupBy("role").agg(F.count("*").alias("n"), names.alias("names"))


def status_summary(registry: DataFrame) -> DataFrame:
    return registry.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def resolve_channel(df: DataFrame, registry: DataFrame, key: str = "wanted") -> DataFrame:
    """``resolved``: the source of that very id, else the first by id whose name or id holds the text; null if none.

    For the second way the registry is listed by the runs of at most three letters that its names and ids hold, and what
    the first way left meets the runs that begin it: an equal-key join for a registry of any size.
    """
    dim = registry.select("source_id", F.lower("source_id").alias("_id"), F.lower(F.coalesce("source_name", F.lit(""))).alias("_name"))
    exact = df.join(small(dim.select("source_id", "_id")), F.lower(F.col(key)) == F.col("_id"), "left").drop("_id")
    runs = lambda c: F.flatten(F.transform(F.array(*map(F.lit, (1, 2, 3))), lambda n: F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.col(c).substr(i, n))))
    listed = dim.withColumn("_run", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *[F.when(F.length(c) > 0, runs(c)).otherwise(F.array().cast("array<string>")) for c in ("_name", "_id")]))))
    left = exact.where(F.col("source_id").isNull() & F.col(key).isNotNull()).select(key, F.lower(F.col(key)).alias("_want")).distinct()
    met = left.withColumn("_run", F.substring("_want", 1, 3)).join(listed, "_run").where(F.contains("_name", F.col("_want")) | F.contains("_id", F.col("_want")))
    near = met.groupBy(key).agg(F.min("source_id").alias("_near"))
    return exact.join(near, key, "left").withColumn("resolved", F.coalesce("source_id", "_near")).drop("source_id", "_near")


def after_cursor(df: DataFrame, cursors: DataFrame, key: str = "channel", ts: str = "event_s") -> DataFrame:
    """Rows later than their source's cursor; all rows of a source without one."""
    dim = small(cursors.select(F.col(key).alias("_k"), F.col("last_time").alias("_t")))
    return df.join(dim, F.col(key) == F.col("_k"), "left").where(F.col("_t").isNull() | (F.col(ts) > F.col("_t"))).drop("_k", "_t")


def next_cursors(accepted: DataFrame, key: str = "channel", ts: str = "event_s", order: tuple[str, ...] = ("arrival_s", "event_id", "replay"), mode: str = "last") -> DataFrame:
    """Per source the last id, time and number of a batch: of the row accepted last, or the largest time (``max``)."""
    at = F.struct(*order)
    time = F.max(ts) if mode == "max" else F.max_by(ts, at)
    return accepted.groupBy(key).agg(F.max_by("message_id", at).alias("last_id"), time.alias("last_time"), F.count("*").alias("n"))


def advance_id_cursor(df: DataFrame, key: str = "channel", number: str = "event_id") -> DataFrame:
    return df.groupBy(key).agg(F.max(number).alias("last_id"))


def upsert_latest(base: DataFrame, changes: DataFrame, key: str, columns: list[str], seq: str = "seq", delete: str | None = None) -> DataFrame:
    """A snapshot with changes applied: per key and column the last non-null change, else the old value.

    With ``delete``, keys whose last change has that flag go. Keys only in ``changes`` are added.
    """
    pick = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"_{c}") for c in columns]
    gone = [F.max_by(delete, seq).alias("_gone")] if delete else [F.lit(False).alias("_gone")]
    last = changes.groupBy(F.col(key).alias("_key")).agg(*pick, *gone)
    out = base.join(last, F.col(key) == F.col("_key"), "full").where(~F.coalesce("_gone", F.lit(False)))
    return out.select(F.coalesce(key, "_key").alias(key), *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def write_snapshot(base: DataFrame, path: str, key: str, buckets: int) -> None:
    """A snapshot in hashed buckets, a folder each, for ``merge_snapshot``."""
    base.withColumn("bucket", _bucket(key, buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def merge_snapshot(spark: SparkSession, path: str, changes: DataFrame, key: str, columns: list[str], buckets: int, seq: str = "seq", delete_flag: str | None = None) -> None:
    """Apply changes to a snapshot of ``write_snapshot`` as ``upsert_latest`` does, reading and writing changed buckets only.

    The merged buckets are written beside the snapshot first and then put in place folder by folder, so a run that breaks
    off before has changed nothing, and one that is run again gives the same. A bucket that is left empty goes.
    """
    own = materialize(changes.withColumn("bucket", _bucket(key, buckets)), "changes")
    touched = [r.bucket for r in own.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    stored = spark.read.parquet(path)
    base = stored.where(F.col("bucket").isin(touched)).drop("bucket") if touched else stored.limit(0).drop("bucket")
    merged = materialize(upsert_latest(base, own.drop("bucket"), key, columns, seq, delete_flag).withColumn("bucket", _bucket(key, buckets)), "merged")
    full = {r.bucket for r in merged.select("bucket").distinct().collect()}
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in set(touched) - full:
        delete(spark, f"{path}/bucket={b}")
    drop(own, merged)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")


def skip_last_id(df: DataFrame, cursors: DataFrame, key: str = "channel", id_col: str = "message_id") -> DataFrame:
    """Rows whose id is not the last one that the stored cursor of their key names; keys without a cursor keep all."""
    last = cursors.select(F.col(key).alias("_key"), F.col("last_id").alias("_last"))
    return df.join(small(last), F.col(key) == F.col("_key"), "left").where(F.col("_last").isNull() | F.col(id_col).isNull() | (F.col(id_col) != F.col("_last"))).drop("_key", "_last")


def active_assets(catalog: DataFrame | None = None, bound: int = 1_000) -> list[tuple[str, list[str]]]:
    """(symbol, keywords) of the active catalog, by priority, then symbol; more than ``bound`` rows are an error.

    For built-in tests of each text; ``detect_assets`` searches larger catalogs in another way.
    """
    rows = P.ASSETS if catalog is None else [(r.symbol, r.name, r.keywords, r.priority) for r in catalog.where("is_active").limit(bound + 1).collect()]
    if len(rows) > bound:
        raise ValueError(f"more than {bound} active assets")
    return [(s, kws or []) for s, _, kws, _ in sorted(rows, key=lambda r: (-r[3], r[0]))]


def detect_assets(df: DataFrame, text_col: str = "text", catalog: DataFrame | None = None, default: str = "BTC", tests: int = 200, block: int = 100_000) -> DataFrame:
    """Adds ``assets`` (all whose keyword occurs anywhere, by priority) and ``asset_found`` (the first, or the default).

    A catalog of at most ``tests`` active assets becomes built-in tests of each text. A larger one is searched by automata
    over its keywords, linear in a text's length however many there are: it is cut into blocks of ``block`` keywords, each
    collected and sent to the tasks on its own, and a task runs one block's automaton after the other over its rows. So no
    process holds more than a block, texts are read once, and nothing shuffles. Empty and null keywords match nothing.
    """
    if catalog is None or catalog.where("is_active").limit(tests + 1).count() <= tests:
        low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
        hits = [F.when(reduce(or_, [F.contains(low, F.lit(k.lower())) for k in kws]), F.lit(s)) for s, kws in ((s, [k for k in kws if k]) for s, kws in active_assets(catalog, tests)) if kws]
        out = df.withColumn("assets", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"))
    else:
        out = _searched_assets(df, text_col, catalog, block)
    return out.withColumn("asset_found", F.coalesce(F.get("assets", F.lit(0)), F.lit(default)))


def _searched_assets(df: DataFrame, text_col: str, catalog: DataFrame, block: int) -> DataFrame:
    """``df`` with ``assets`` by one automaton for each block of keywords."""
    keywords = catalog.where("is_active").select("symbol", "priority", F.explode("keywords").alias("k")).select("symbol", "priority", F.lower("k").alias("k")).where("k <> ''")
    grouped = keywords.groupBy("k").agg(F.collect_set(F.struct((-F.col("priority")).alias("rank"), "symbol")).alias("of"))
    blocks = max(1, -(-grouped.count() // block))
    numbered = materialize(grouped.withColumn("b", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")), "keywords")
    spark = df.sparkSession
    sent = [spark.sparkContext.broadcast([(r.k, [tuple(x) for x in r.of]) for r in numbered.where(F.col("b") == i).collect()]) for i in range(blocks)]
    drop(numbered)
    names = [c for c in df.columns if c != "assets"]
    schema = T.StructType([*(df.schema[c] for c in names), T.StructField("assets", T.ArrayType(T.StringType()))])
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        built = {}

        def automaton(i: int):
            if i not in built:
                built.clear()  # one at a time
                found = ahocorasick.Automaton()
                for k, of in sent[i].value:
                    found.add_word(k, of)
                found.make_automaton()
                built[i] = found
            return built[i]

        for batch in batches:
            texts = [(x or "").lower() for x in batch.column(at).to_pylist()]
            hits: list[set] = [set() for _ in texts]
            for i in range(len(sent)):
                search = automaton(i)
                for text, own in zip(texts, hits, strict=True):
                    for _, of in search.iter(text):
                        own.update(of)
            assets = pa.array([list(dict.fromkeys(s for _, s in sorted(h))) for h in hits], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(df_at) for df_at in kept), assets], names=schema.fieldNames())

    kept = [df.columns.index(c) for c in names]
    return df.mapInArrow(run, schema)


def keyword_index(catalog: DataFrame) -> DataFrame:
    """Keyword -> symbol; the higher priority wins, then the smaller symbol."""
    rows = catalog.where("is_active").select("symbol", "priority", F.explode("keywords").alias("keyword")).withColumn("keyword", F.lower("keyword"))
    w = Window.partitionBy("keyword").orderBy(F.desc("priority"), "symbol")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("keyword", "symbol")


def activity_hours(kind: Column) -> Column:
    return C.by_source(kind, P.ACTIVITY_HOURS, P.DEFAULT_ACTIVITY_HOURS)


def channel_health(registry: DataFrame, posts: DataFrame, as_of: int, ts: str = "event_s") -> DataFrame:
    """Adds ``last_s`` and ``health``: what was observed (dead, private, error), else alive or inactive by the type's hours, unknown without posts."""
    last = posts.groupBy(F.col("channel").alias("_c")).agg(F.max(ts).alias("last_s"))
    out = registry.join(last, F.col("source_id") == F.col("_c"), "left").drop("_c")
    fresh = as_of - F.col("last_s") <= activity_hours(F.col("type")) * 3600
    return out.withColumn("health", F.when(F.col("observed").isin("dead", "private", "error"), F.col("observed")).when(F.col("last_s").isNull(), "unknown").when(fresh, "alive").otherwise("inactive"))


def apply_health(health: DataFrame) -> DataFrame:
    """The new snapshot: errors counted on or reset; dead, private and three errors in a row disable."""
    errors = F.when(F.col("health") == "error", F.col("error_count") + 1).otherwise(0)
    off = F.col("health").isin("dead", "private") | ((F.col("health") == "error") & (errors >= P.MAX_ERRORS))
    return health.withColumns({"error_count": errors, "disabled": off, "enabled": F.col("enabled") & ~off, "status": F.col("health")})


def health_run_summary(health: DataFrame) -> DataFrame:
    return health.groupBy("status").agg(F.count("*").alias("n"), F.count_if("disabled").alias("disabled"))


def raw_with_sentiment(raw: DataFrame, scores: DataFrame, asset: str, since: int, until: int, ts: str = "event_s") -> DataFrame:
    """Raw events of an asset in a closed time range, not dropped, with their scores or nulls."""
    kept = raw.where((F.col("asset") == asset) & F.col(ts).between(since, until) & F.coalesce(~F.col("dropped"), F.lit(True)))
    return kept.join(scores, kept.raw_id == scores.raw_event_id, "left").drop("raw_event_id")


def replay_raw(raw: DataFrame, asset: str, since: int, until: int, source: str | None = None, include_dropped: bool = False, ts: str = "event_s") -> DataFrame:
    out = raw.where((F.col("asset") == asset) & F.col(ts).between(since, until))
    if source:
        out = out.where(F.col("source") == source)
    return out if include_dropped else out.where(F.col("dropped").isNull() | ~F.col("dropped"))


def replay(events: DataFrame, since: int, until: int, asset: str | None = None, ts: str = "event_s", order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """Stored sentiment, risk or quality events of a closed time range, of one asset if given, in order of time."""
    out = events.where(F.col(ts).between(since, until))
    out = out.where(F.col("asset") == asset) if asset is not None else out
    return out.orderBy(ts, *order)


def new_only(df: DataFrame, stored: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Rows whose key is not stored yet; null keys are always new."""
    return df.join(stored.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def append_unique(df: DataFrame, path: str, key: str, order: tuple[str, ...]) -> DataFrame:
    """Append the first row of each key that the table at ``path`` does not hold; returns what was appended."""
    from .ordered import dedupe_first

    spark = df.sparkSession
    rows = dedupe_first(df, (key,), order)
    try:
        stored = spark.read.parquet(path)
    except Exception as e:  # the first batch finds no table
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    fresh = rows if stored is None else new_only(rows, stored, key).select(*rows.columns)
    fresh.write.mode("append").parquet(path)
    return fresh


def append_events(df: DataFrame, path: str, ts: str = "event_s") -> None:
    """Append sentiment, risk or quality events to the table at ``path``, a folder for each day of event time (UTC)."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col(ts) / 86_400).cast("int"))
    df.withColumn("event_date", day).write.mode("append").partitionBy("event_date").parquet(path)


def read_table(spark: SparkSession, path: str, since: int | None = None, until: int | None = None) -> DataFrame:
    """A stored table. With a range of seconds only the days that it touches are read (see ``append_events``)."""
    out = spark.read.parquet(path)
    day = lambda s: F.date_add(F.lit("1970-01-01").cast("date"), s // 86_400)
    out = out.where(F.col("event_date") >= day(since)) if since is not None else out
    return out.where(F.col("event_date") <= day(until)) if until is not None else out


def write_json(df: DataFrame, path: str) -> None:
    """Results as JSON lines, one object a row; nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _defaults(df: DataFrame, values: dict[str, object]) -> dict[str, Column]:
    return {c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in values.items()}


def prepare_risk_rows(df: DataFrame) -> DataFrame:
    """Stored form with defaults; the fear and greed index may stay null."""
    values = _defaults(df, {"asset": "BTC", "sentiment_reliability": "normal", "fear_greed_zone": "unknown", "social_overheat": False, "panic_risk": False, "fomo_risk": False, "data_quality_overall": "healthy"})
    return df.withColumns(values)


def prepare_quality_rows(df: DataFrame, metrics: tuple[str, ...] = ()) -> DataFrame:
    """Stored form with defaults; ``metrics_detail`` is a JSON object of the named columns."""
    values = _defaults(df, {"source_type": "", "availability": "ok", "time_integrity": "ok", "volume": "normal", "overall": "healthy"})
    detail = F.to_json(F.struct(*metrics)) if metrics else F.lit("{}")
    return df.withColumns(values).withColumn("metrics_detail", detail)


def alert_history_rows(df: DataFrame, asset: str = "BTC") -> DataFrame:
    """(asset, alert_type, message, message_id, success) of alerts that were tried to be sent."""
    return df.select(F.coalesce(F.col("asset"), F.lit(asset)).alias("asset"), "alert_type", "message", F.col("sent_id").alias("message_id"), F.col("sent_id").isNotNull().alias("success"))


def prepare_message_rows(df: DataFrame) -> DataFrame:
    """Stored form with defaults: id from the fingerprint, weights 0, velocity 1 where null or 0."""
    fp = C.fingerprint("store", source=F.col("source"), message_id=F.coalesce("message_id", F.lit("")), text=F.coalesce("text", F.lit("")))
    out = df.withColumn("fingerprint", fp)
    return out.withColumns({"message_id": F.coalesce(F.nullif("message_id", F.lit("")), F.concat(F.lit("auto_"), F.substring("fingerprint", 1, 16))), "engagement_weight": F.coalesce("engagement_weight", F.lit(0.0)), "author_weight": F.coalesce("author_weight", F.lit(0.0)), "velocity": F.coalesce(F.nullif("velocity", F.lit(0.0)), F.lit(1.0))})


def prepare_sentiment_rows(df: DataFrame) -> DataFrame:
    """Stored form: label as a word, score from it where null, weighted = score x confidence, strength its size."""
    name = F.when(F.col("label") == 1, "bullish").when(F.col("label") == -1, "bearish").otherwise("neutral")
    score = F.coalesce("score", F.col("label").cast("double"))
    return df.withColumns({"label_name": name, "score": score, "weighted": score * F.col("confidence"), "strength": F.abs(score * F.col("confidence"))})
