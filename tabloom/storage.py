"""The shared folder for written tables and checkpoints."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from tabloom.errors import TableError


def _base(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise TableError("spark.checkpoint.dir must name a folder that all executors share")
    return tempfile.mkdtemp(prefix="tabloom-")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder name in the folder the cluster names for checkpoints.

    A local temporary folder is used only where none is named and all runs in one process,
    as in tests; a cluster without a shared folder is an error.
    """
    return f"{_base(spark)}/tabloom-{uuid.uuid4().hex}"



def delete(spark: SparkSession, path: str) -> None:
    """Remove a written table that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
