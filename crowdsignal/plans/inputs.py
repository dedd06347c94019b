"""The derived inputs of the registered queries: SQL that reads alike in Spark and in the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..scratch import scratch_path

PHRASES = ["to the moon, breakout confirmed", "accumulation and whale buying", "dump incoming, rug pull", "panic exit before collapse", "100x lambo all in", "quiet sideways market", "sell wall then dump dump", "buy wall and breakout", "exploit and hack reported", "moon moon yolo", "bankruptcy fear spreads", "nothing to report today"]
_CASE = " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(PHRASES))


def _copy(replay: int) -> str:
    return f"""
  SELECT event_id, 'm' || CAST(event_id AS VARCHAR(20)) AS message_id,
         CASE event_id % 3 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' ELSE 'telegram' END AS source,
         'ch' || CAST(user_id % 6 AS VARCHAR(20)) AS channel,
         CASE user_id % 4 WHEN 0 THEN 'BTC' WHEN 1 THEN 'ETH' WHEN 2 THEN 'SOL' ELSE 'DOGE' END AS asset,
         CASE (event_id + user_id) % 12 {_CASE} END AS text,
         CAST(floor(value) AS BIGINT) AS likes, event_id % 7 AS reposts, user_id % 5 AS replies, user_id * 37 AS followers,
         event_id * 5 + {4 * replay} AS arrival_s, event_id * 5 - (event_id * 11 % 40) + 3 AS event_s,
         {replay} AS replay, ts, value, props
  FROM events{" WHERE event_id % 10 = 0" if replay else ""}"""


#: One row per event and a replayed copy of every tenth that arrives four seconds later.
MESSAGES = f"{_copy(0)}\n  UNION ALL{_copy(1)}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MESSAGES.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))


def with_messages(sql: str) -> str:
    return f"WITH m AS ({MESSAGES}) {sql}" if not sql.lstrip().startswith(",") else f"WITH m AS ({MESSAGES}) {sql.lstrip()}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; a local run that names none gets a temporary folder."""
    return scratch_path(spark, name)
