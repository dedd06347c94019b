"""Queries of operators whose dimension or snapshot is itself large: catalogs, bucketed snapshots, injected classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scoring, tables
from ..sources import records
from .core import ID, SENT
from .inputs import messages, scratch, table, with_messages
from .ordered import _last
from .registry import Registry

register = Registry()
QUERIES, ORACLES = register.queries, register.oracles


@register("jn5_large_catalog", """WITH k AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS w FROM benchmark), h AS (SELECT doc_id, w FROM documents JOIN k ON contains(lower(text), w))
 SELECT d.doc_id, count(w) AS n_assets, coalesce(arg_min(w, (-length(w), w)), 'BTC') AS asset_found FROM documents d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id""")
def jn5_large(spark, sf_dir):
    """Every long word of the benchmark as an asset of its own, the longest first, in all documents."""
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0)))
    catalog = table(spark, sf_dir, "benchmark").select(words.alias("symbol")).distinct().select("symbol", F.col("symbol").alias("name"), F.array("symbol").alias("keywords"), F.length("symbol").alias("priority"), F.lit(True).alias("is_active"))
    found = tables.detect_assets(table(spark, sf_dir, "documents").select("doc_id", "text"), catalog=catalog)
    return found.select("doc_id", F.size("assets").cast("long").alias("n_assets"), "asset_found")


def _classifier():
    """Stands for a model: "market" is good news, "report" bad, anything else gets a label that does not count."""

    def judge(texts: list[str]) -> list[tuple[int, float | None]]:
        return [(1, 1.7) if "market" in t else (-1, None) if "report" in t else (7, 0.9) for t in texts]

    return judge


@register("ud2_model_on_unmatched", with_messages(f""", {SENT} SELECT event_id, replay, matches = 0 AND (contains(text, 'market') OR contains(text, 'report')) AS model_used,
 CASE WHEN matches > 0 THEN label WHEN contains(text, 'market') THEN 1 WHEN contains(text, 'report') THEN -1 ELSE 0 END AS final_label,
 round(CASE WHEN matches > 0 THEN confidence WHEN contains(text, 'market') THEN 1.0 WHEN contains(text, 'report') THEN 0.5 ELSE 0.0 END, 6) AS final_confidence FROM scored"""))
def ud2(spark, sf_dir):
    """Texts without a term go to a classifier of the caller's."""
    out = scoring.classify_unmatched(scoring.sentiment(messages(spark, sf_dir)), _classifier)
    return out.select(*ID, "model_used", "final_label", F.round("final_confidence", 6).alias("final_confidence"))


@register("snk6_merge_buckets", """WITH b AS (SELECT c_custkey, c_nationkey AS a, c_mktsegment AS s FROM customer), ch AS (SELECT o_custkey AS c_custkey, arg_max(CAST(o_orderpriority AS VARCHAR), o_orderkey) FILTER (o_orderpriority <> '5-LOW') AS s, arg_max(o_orderstatus = 'P', o_orderkey) AS gone FROM orders GROUP BY 1)
 SELECT coalesce(b.c_custkey, ch.c_custkey) AS c_custkey, b.a, coalesce(ch.s, b.s) AS s FROM b FULL JOIN ch ON b.c_custkey = ch.c_custkey WHERE NOT coalesce(gone, FALSE)""")
def snk6_buckets(spark, sf_dir):
    """Customers in 16 buckets; a third of them take the priority of their last order, and go if it is pending, bucket by bucket."""
    path, base = scratch(spark, "snapshot"), table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("a"), F.col("c_mktsegment").alias("s"))
    tables.write_snapshot(base, path, "c_custkey", 16)
    changes = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(None).cast(base.schema["a"].dataType).alias("a"), F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("s"), F.col("o_orderkey").alias("seq"), (F.col("o_orderstatus") == "P").alias("gone"))
    for part in range(3):  # each run changes the customers of its own third
        tables.merge_snapshot(spark, path, changes.where(F.pmod(F.hash("c_custkey"), F.lit(3)) == part), "c_custkey", ["a", "s"], 16, delete_flag="gone")
    return tables.read_snapshot(spark, path)


@register("cur2_stored_cursor", with_messages(", h AS (SELECT max(event_s) // 2 AS t FROM m), c AS (SELECT channel, arg_max(message_id, (arrival_s, event_id, replay)) AS last_id FROM m, h WHERE event_s <= t AND channel <> 'ch5' GROUP BY channel) SELECT event_id, replay FROM m LEFT JOIN c USING (channel) WHERE last_id IS NULL OR last_id <> message_id"))
def cur2(spark, sf_dir):
    """Rows that are not the last one a stored cursor of their channel names; the cursors are of the first half of the time."""
    m = messages(spark, sf_dir)
    stored, path = m.where((F.col("event_s") <= _last(m) // 2) & (F.col("channel") != "ch5")), scratch(spark, "cursors")
    tables.next_cursors(stored).write.parquet(path)
    return tables.skip_last_id(m, spark.read.parquet(path)).select(*ID)


@register("src2_range_predicates", "SELECT " + " + ".join(f"CAST(event_id >= lo + ((hi - lo) * {i}) // 4 AS INTEGER)" for i in (1, 2, 3)) + " AS part, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM (SELECT event_id, min(event_id) OVER () AS lo, max(event_id) OVER () AS hi FROM events) GROUP BY ALL")
def src2(spark, sf_dir):
    """Events by the conditions that a relational read would send, one for each task."""
    events = table(spark, sf_dir, "events")
    low, high = events.agg(F.min("event_id"), F.max("event_id")).first()
    cuts = records.range_predicates("event_id", low, high, 4)
    part = F.coalesce(*[F.when(F.expr(p), i) for i, p in enumerate(cuts)])
    return events.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
