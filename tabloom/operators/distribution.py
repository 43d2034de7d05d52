"""Distribution of a column's values, and rows tagged with their group."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.cells import EMPTY_LABEL, group_key, group_text, ref, round_exact
from tabloom.operators.rows import with_row_index

BAR_LENGTH = 12


def value_counts(df: DataFrame, column: str, label: str = EMPTY_LABEL) -> DataFrame:
    """``(value, n)``: distinct cell texts with their number of rows."""
    key, text = group_key(df, column, label)
    sizes = df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.select(text(ref("key")).alias("value"), "n")


def share_table(df: DataFrame, column: str, label: str = EMPTY_LABEL, ordered: bool = True) -> DataFrame:
    """``(value, n, share)`` with the share as ``12.5%``, largest first.

    The total is a count of the table (for Parquet read from file footers alone), used as
    a scalar; no join.
    """
    total = df.agg(F.count(F.lit(1))).scalar()
    percent = F.col("n").cast("double") / total.cast("double") * 100.0
    table = value_counts(df, column, label).withColumn("p", percent) \
        .select("value", "n", F.format_string("%.1f%%", round_exact(F.col("p"), 1)).alias("share"))
    return table.orderBy(F.desc("n"), "value") if ordered else table


def bars(df: DataFrame, column: str, label: str = EMPTY_LABEL) -> DataFrame:
    """``(value, n, bar)``: bars of up to 12 blocks, scaled to the most frequent value."""
    counts = value_counts(df, column, label)
    largest = counts.agg(F.max("n")).scalar()
    length = F.floor(F.col("n").cast("double") / largest.cast("double") * float(BAR_LENGTH))
    return counts.select("value", "n", F.repeat(F.lit("█"), length.cast("int")).alias("bar"))


def distribution_totals(df: DataFrame, column: str, label: str = EMPTY_LABEL) -> DataFrame:
    """One row ``(distinct_values, total_rows)``."""
    return value_counts(df, column, label).agg(
        F.count(F.lit(1)).alias("distinct_values"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows")
    )


def search_values(distribution: DataFrame, text: str) -> DataFrame:
    """Lines of a distribution whose value contains the text literally."""
    return distribution.where(F.contains(ref("value"), F.lit(text)))


def with_group(df: DataFrame, column: str, name: str = "group_key", label: str = EMPTY_LABEL) -> DataFrame:
    """Tag each row with its group; the rows stay where they are."""
    return df.withColumn(name, group_text(df, column, label))


def group_order(df: DataFrame, column: str, label: str = EMPTY_LABEL, row_no: str | None = None) -> DataFrame:
    """``(value, n, first_row)``: groups in the order they are first seen.

    ``row_no`` names a row-number column; by default the physical row number is used.
    """
    numbered = df if row_no else with_row_index(df, "_row_no")
    key, text = group_key(numbered, column, label)
    first = F.min(ref(row_no or "_row_no")).alias("first_row")
    groups = numbered.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), first)
    return groups.select(text(ref("key")).alias("value"), "n", "first_row").orderBy("first_row")
