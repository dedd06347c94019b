"""Tables written in between: they cut the lineage and outlive lost executors, so they go to the folder all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The folders of the tables that ``materialize`` gave and nothing has deleted yet, in order.
written: list[str] = []
_local: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a local run that sets none gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="spark-"))
        shared = _local[0]
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    written.append(path)
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    if path in written:
        written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames, once nothing that is still to run reads them."""
    for df in tables:
        if (path := getattr(df, "_scratch_path", None)) in written:
            delete(df.sparkSession, path)


def small(dim: DataFrame, bound: int = 100_000) -> DataFrame:
    """``dim`` with a broadcast hint if it has at most ``bound`` rows, counted no further than that."""
    return F.broadcast(dim) if dim.limit(bound + 1).count() <= bound else dim
