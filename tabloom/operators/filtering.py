"""Row filter."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.predicates import predicate


def filter_rows(df: DataFrame, conditions: Iterable[Mapping], logic: str = "AND") -> DataFrame:
    """Rows for which the conditions hold; columns are checked before any job."""
    return df.where(predicate(df, conditions, logic))


def unmatched_rows(df: DataFrame, conditions: Iterable[Mapping], logic: str = "AND") -> DataFrame:
    """The complement of :func:`filter_rows`."""
    return df.where(~F.coalesce(predicate(df, conditions, logic), F.lit(False)))


def filter_counts(df: DataFrame, conditions: Iterable[Mapping], logic: str = "AND") -> DataFrame:
    """One row ``(total, matched)`` from a single pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(predicate(df, conditions, logic)).alias("matched"),
    )
