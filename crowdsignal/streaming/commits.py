"""Tables that change together: a batch's rows appear in all of them at once, named by a manifest that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"
_SCHEMA = "batch bigint, tables array<string>"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def is_committed(spark: SparkSession, path: str, batch: int) -> bool:
    at, fs = _fs(spark, f"{path}/{MANIFEST}/batch-{batch}.json")
    return fs.exists(at)


def commit_batch(path: str, batch: int, tables: dict[str, DataFrame]) -> bool:
    """Write a batch's rows of every table, then its manifest; false, and nothing written, if the batch is there already.

    Each table has a folder for each batch, overwritten if a run broke off before the manifest. The manifest is written
    beside its place and renamed, so readers see all tables of a batch or none, and a batch that is run again, as after
    a restart, is written once.
    """
    spark = next(iter(tables.values())).sparkSession
    if is_committed(spark, path, batch):
        return False
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch}")
    begun, fs = _fs(spark, f"{path}/{MANIFEST}/.batch-{batch}.json.begun")
    out = fs.create(begun, True)
    out.write(bytearray((json.dumps({"batch": batch, "tables": sorted(tables)}) + "\n").encode()))
    out.close()
    done, _ = _fs(spark, f"{path}/{MANIFEST}/batch-{batch}.json")
    if not fs.rename(begun, done):
        raise OSError(f"batch {batch} could not be committed")
    return True


def committed(spark: SparkSession, path: str, name: str, schema: str | None = None) -> DataFrame:
    """The rows of table ``name`` of all committed batches, with the column ``batch``; folders of others are not read.

    Batches meet the manifest by a join on the partition column, which prunes folders while the query runs.
    """
    done = spark.read.schema(_SCHEMA).json(f"{path}/{MANIFEST}").where(F.array_contains("tables", name)).select("batch")
    read = spark.read.schema(schema) if schema else spark.read
    rows = read.parquet(f"{path}/{name}")
    return rows.withColumn("batch", F.col("batch").cast("bigint")).join(done, "batch", "left_semi")
