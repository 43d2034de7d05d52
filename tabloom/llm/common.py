"""Helpers shared by the operators: shipping the package, written tables, row keys, numbering."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.storage import scratch_dir

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="tabloom-ship-"), "tabloom_package.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, base))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)


def written(df: DataFrame, partition_by: str | None = None, **options: str) -> DataFrame:
    """The frame as a table in the shared folder: its plan ends there, lost executors or not."""
    path = scratch_dir(df.sparkSession)
    writer = df.write.options(**options)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below a path that their writers have committed."""
    system, place = _file_system(spark, path)
    if not system.exists(place):
        return []
    found = [status.getPath() for status in system.listStatus(place) if status.isDirectory()]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.getName() for p in found if system.exists(done(p, "_SUCCESS")))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    system, place = _file_system(spark, path)
    system.delete(place, True)


def give_back() -> None:
    """Return the memory that this Python worker no longer uses: it stays for other tasks, beside
    an executor whose heap grows."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def in_fold(column: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def numbered(rows: DataFrame, name: str, group: Sequence[str] = (), buckets: int = 16384) -> DataFrame:
    """Add `name`, the number from 0 of each row in its group, without a task per group.

    The order is that of a hash of all columns, then of the columns, so it depends on the
    rows only. Rows are dealt to `buckets` by the hash; a bucket's first number is the sum of
    the counts of the buckets before it. Equal rows are counted before any row moves and
    unfolded at the end, so neither a hot group nor a hot row is a hot task. Group columns
    must not be null; columns must be of types that can be grouped.
    """
    columns = rows.columns
    counted = (
        rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("_copies"))
        .withColumn("_hash", F.xxhash64(*columns)).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)).cast("int"))
    )
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        counted.groupBy(*group, "_bucket").agg(F.sum("_copies").alias("_in_bucket"))
        .select(*group, "_bucket", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_first"))
    )
    inside = (
        Window.partitionBy(*group, "_bucket").orderBy("_hash", *columns).rowsBetween(Window.unboundedPreceding, -1)
    )
    step = 1 << 20
    return (
        counted.join(firsts, [*group, "_bucket"])
        .withColumn("_first", F.col("_first") + F.coalesce(F.sum("_copies").over(inside), F.lit(0)))
        .select(*columns, "_first", "_copies", F.explode(F.sequence(
            F.lit(0).cast("long"), F.expr(f"(_copies - 1) div {step}"))).alias("_block"))
        .select(*columns, "_first", F.explode(F.sequence(
            F.col("_block") * step, F.least(F.col("_copies"), (F.col("_block") + 1) * step) - 1)).alias("_copy"))
        .select(*columns, (F.col("_first") + F.col("_copy")).alias(name))
    )
