"""Session settings this package is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Rebalanced writes, skewed joins and small shuffle partitions are handled at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Timestamps without a zone must not move.
    "spark.sql.session.timeZone": "UTC",
    # Beyond 8,000 bytes Java interprets a generated method instead of compiling it; Spark then
    # does better with smaller generated pieces. Matters for wide tables and many formulas.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Cells with the text of a number stay text when split outputs are read back.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
}


def session(app: str = "tabloom", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
