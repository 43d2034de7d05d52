"""Duplicate removal: first or last row per key, counts, groups, removed rows.

A key value may hold a large share of all rows, so nothing here gathers a group in one
task. Keepers are the rows of rank 1, a rank limit Spark applies to each partition before
the shuffle (or ``max_by``, which is aggregated before it), so one row per key and
partition is moved. Removed rows come from an anti join on row order, which is unique and
so evenly spread.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.errors import TableError
from tabloom.functions.cells import group_value, ref
from tabloom.functions.names import normalise_headers
from tabloom.operators.rows import with_address


def key_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    """The asked columns that exist (default: all); at least one must."""
    found = list(df.columns) if columns is None else [c for c in dict.fromkeys(columns) if c in df.columns]
    if not found:
        raise TableError("none of the key columns exists")
    return found


def _keys(df: DataFrame, columns: Sequence[str] | None) -> list[Column]:
    return [group_value(df, c).alias(f"_key{i}") for i, c in enumerate(key_columns(df, columns))]


def _ordered(df: DataFrame, order_by: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    return with_address(df) if order_by is None else (df, list(order_by))


def _any_will_do(df: DataFrame, columns: Sequence[str] | None) -> bool:
    """With all columns as the key, rows of one key are the same and need no order."""
    whole = set(key_columns(df, columns)) == set(df.columns)
    return whole and not any(isinstance(f.dataType, T.MapType) for f in df.schema)


def _nearest(at: DataFrame, df: DataFrame, columns: Sequence[str] | None, order: list[Column]) -> DataFrame:
    ranked = at.withColumn("_rank", F.row_number().over(Window.partitionBy(*_keys(df, columns)).orderBy(*order)))
    return ranked.where("_rank = 1").select(*[ref(c) for c in df.columns])


def keep_first(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None
) -> DataFrame:
    """The first row of each key.

    ``order_by`` must be unique per row (default: the physical order of the scan). Keys
    are typed: NULL equals NULL, the number 1 is not the text "1".
    """
    if _any_will_do(df, columns):
        return df.dropDuplicates()
    at, order = _ordered(df, order_by)
    return _nearest(at, df, columns, [ref(c).asc() for c in order])


def keep_last(
    df: DataFrame, columns: Sequence[str] | None = None, order_by: Sequence[str] | None = None,
    position: str | None = None,
) -> DataFrame:
    """The last row of each key. Its place in the result is that of the key's first row:
    ``position`` adds the first row's order value(s) as a struct column to sort by."""
    if position is None and _any_will_do(df, columns):
        return df.dropDuplicates()
    at, order = _ordered(df, order_by)
    if position is None:
        return _nearest(at, df, columns, [ref(c).desc() for c in order])
    place = F.struct(*[ref(c) for c in order])
    row = F.struct(*[ref(c) for c in df.columns])
    kept = at.groupBy(*_keys(df, columns)).agg(F.max_by(row, place).alias("_row"), F.min(place).alias(position))
    return kept.select("_row.*", ref(position))


def dedup(
    df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    if keep not in ("first", "last"):
        raise ValueError(f"unknown keep '{keep}'")
    return (keep_first if keep == "first" else keep_last)(df, columns, order_by)


def removed_rows(
    df: DataFrame, columns: Sequence[str] | None = None, keep: str = "first",
    order_by: Sequence[str] | None = None,
) -> DataFrame:
    """The rows :func:`dedup` leaves out; ``order_by``, if given, must be unique per row.

    Keepers, one line per key, are taken out by their place: two scans and, if there are many
    keepers, one shuffle by place, which is unique and even, so that no key is a hot task.
    """
    at, order = _ordered(df, order_by)
    pick = F.min if keep == "first" else F.max
    place = pick(F.struct(*[ref(c) for c in order])).alias("_kept")
    kept = at.groupBy(*_keys(df, columns)).agg(place).select(
        *[F.col("_kept").getField(c).alias(f"_kept{i}") for i, c in enumerate(order)]
    )
    same = [ref(c).eqNullSafe(ref(f"_kept{i}")) for i, c in enumerate(order)]
    return at.join(kept, same, "left_anti").select(*[ref(c) for c in df.columns])


def _group_sizes(df: DataFrame, columns: Sequence[str] | None) -> DataFrame:
    return df.groupBy(*_keys(df, columns)).agg(F.count(F.lit(1)).alias("_n"))


def dedup_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row ``(total, kept, removed)``."""
    total, kept = F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))
    return _group_sizes(df, columns).agg(
        total.alias("total"), kept.alias("kept"), (total - kept).alias("removed")
    )


def duplicate_groups(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keys that occur more than once, with their number of rows as last column ``n``
    (``n_2`` beside a key of that name)."""
    names = key_columns(df, columns)
    sizes = _group_sizes(df, columns).where(ref("_n") > 1)
    return sizes.toDF(*normalise_headers([*names, "n"]))
