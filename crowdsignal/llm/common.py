"""Shared pieces of the training-data operators: table access, scratch tables and word expressions."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these characters (space and U+0009 to U+000D).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The folders of the tables that ``materialize`` gave and nothing has deleted yet, in order.
_written: list[str] = []
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


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _written.append(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written.remove(path)


def drop(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote for these frames, once nothing that is still to run reads them."""
    for df in tables:
        if (path := getattr(df, "_scratch_path", None)) in _written:
            _delete(df.sparkSession, path)


def settle(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """The written table of what ``make`` gives; all that was written on the way to it is deleted."""
    before = set(_written)
    out = materialize(make(), label)
    for path in [p for p in _written if p not in before and p != out._scratch_path]:
        _delete(out.sparkSession, path)
    return out


def held_out(doc_id: Column) -> Column:
    """True for the documents whose labels are never learned from: crc32 of the id as text divides by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_partition))


def small(dim: DataFrame, bound: int = 100_000) -> DataFrame:
    """``dim`` with a broadcast hint if it has at most ``bound`` rows, counted no further than that."""
    return F.broadcast(dim) if dim.limit(bound + 1).count() <= bound else dim


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once: what stands in a lambda is computed again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def blocked(items: Column) -> Column:
    """An array cut into about as many arrays as each of them is long."""
    per = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items).cast("double"))).cast("int"))
    return F.when(F.size(items) == 0, F.filter(F.array(items), lambda x: F.lit(False))).otherwise(F.transform(F.sequence(F.lit(1), F.size(items), per), lambda at: F.slice(items, at, per)))


def offsets(sizes: Column) -> Column:
    """Where each item begins if items of these sizes (integers) stand in a row; sums of blocks first, so that the arrays
    that grow by one number at a time stay short."""

    def summed(start: Column, items: Column) -> Column:
        nothing = F.struct(start.cast("int").alias("at"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(items, nothing, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

    total = lambda b: F.aggregate(b, F.lit(0), lambda acc, n: acc + n)
    return F.flatten(let(let(sizes, blocked), lambda blocks: F.zip_with(blocks, summed(F.lit(0), F.transform(blocks, total)), lambda b, at: summed(at, b))))
