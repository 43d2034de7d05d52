"""Reproducible shuffle and sharding by a Feistel permutation of row numbers."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm.common import numbered

ROUNDS = 6


def _sides(total: int) -> tuple[int, int]:
    """Sides of the smallest near-square rectangle of at least `total` cells."""
    wide = max(1, math.isqrt(max(total - 1, 0)) + 1)
    return wide, max(1, -(-total // wide))


def _permuted(rows: DataFrame, source: str, target: str, total: int, seed: int) -> DataFrame:
    """One pass of the permutation of 0 .. wide * tall - 1: alternate halves take each other's hash."""
    wide, tall = _sides(total)
    rows = rows.withColumn("_left", F.expr(f"`{source}` div {tall}")).withColumn("_right", F.col(source) % tall)
    for k in range(ROUNDS):
        side, other, size = ("_left", "_right", wide) if k % 2 == 0 else ("_right", "_left", tall)
        rows = rows.withColumn(side, (F.col(side) + F.pmod(F.xxhash64(F.col(other), F.lit(seed), F.lit(k)), F.lit(size))) % size)
    return rows.withColumn(target, F.col("_left") * tall + F.col("_right")).drop("_left", "_right")


def walks_needed(spark: SparkSession, total: int, seed: int) -> int:
    """How many more passes the longest walk outside 0 .. total - 1 takes.

    Walks can only pass the cells between `total` and the rectangle's area, about the square
    root of `total`, so following all of them is a small job and the bound is exact.
    """
    wide, tall = _sides(total)
    outside = spark.range(total, wide * tall).withColumnRenamed("id", "_cell")
    walks = 0
    while not outside.isEmpty():
        walks += 1
        outside = _permuted(outside, "_cell", "_next", total, seed).where(F.col("_next") >= total).select(F.col("_next").alias("_cell"))
    return walks


def feistel_position(rows: DataFrame, number: str, name: str, total: int, seed: int = 0) -> DataFrame:
    """Add `name`, the place of row `number` in a shuffle of `total` rows.

    A bijection of 0 .. total - 1 that anyone can compute from the number, the total and the
    seed. Places outside the range walk on along their cycle until they are inside.
    """
    rows = _permuted(rows, number, "_place", total, seed)
    for _ in range(walks_needed(rows.sparkSession, total, seed)):
        rows = _permuted(rows, "_place", "_next", total, seed).withColumn(
            "_place", F.when(F.col("_place") >= total, F.col("_next")).otherwise(F.col("_place"))).drop("_next")
    return rows.withColumnRenamed("_place", name)


def shard_rows(rows: DataFrame, shards: int, seed: int = 0, buckets: int = 16384) -> DataFrame:
    """Deal all rows to `shards` in a reproducible random order.

    Adds row_number (0 .. n - 1, by a hash of the row), position (after the permutation),
    shard (0 .. shards - 1) and slot (gapless from 0 in each shard). Shard sizes differ by at
    most one row, whatever the keys. The result depends on the rows and the seed only, not on
    files, partitions or lost executors. Null cells are ordinary values; equal rows get
    numbers of their own; an empty table gives an empty result. Columns of the input named
    row_number, position, shard or slot are an error; keep rows narrow (a key and digests).
    """
    if clash := {"row_number", "position", "shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns {sorted(clash)} would be overwritten")
    total = rows.count()
    numbers = numbered(rows, "row_number", buckets=buckets)
    placed = feistel_position(numbers, "row_number", "position", total, seed) if total else numbers.withColumn("position", F.col("row_number"))
    return placed.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.expr(f"position div {shards}"))


def shard_documents(docs: DataFrame, shards: int = 24, seed: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Shard documents by id and text digest: id, size (UTF-8 bytes and 8), text_crc32, shard, slot.

    A null text counts as empty. Documents equal in id, size and checksum are interchangeable.
    """
    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_column), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return shard_rows(rows, shards, seed)
