"""Cross-tabulation with totals.

Rows are aggregated once into cells (row key, column key); the table layout and all
totals are made from the cells, never from rows again. Totals are sums of the cells as
shown, also for averages, minima and maxima, so they are not grouping sets of the rows.
"""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.errors import InsufficientData, MissingColumn, TableError
from tabloom.functions.cells import EMPTY_LABEL, TOTAL_LABEL, group_key, num, ref, round_exact
from tabloom.functions.names import normalise_headers

AGGREGATES = ("count", "sum", "avg", "min", "max")


def _require(df: DataFrame, columns: list[str], check_rows: bool) -> None:
    """A table without rows is reported before a missing column."""
    missing = next((c for c in columns if c not in df.columns), None)
    if (missing or check_rows) and df.isEmpty():
        raise InsufficientData("the table has no rows")
    if missing:
        raise MissingColumn(missing)


def _cell(df: DataFrame, value: str, how: str) -> Column:
    if how == "count":
        return F.count(F.lit(1))
    x = num(df, value)
    zero = F.lit(0.0)
    return F.coalesce({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[how](x), zero)


def pivot_cells(
    df: DataFrame, rows: str, columns: str, value: str, how: str = "count",
    label: str = EMPTY_LABEL, check_rows: bool = False,
) -> DataFrame:
    """``(row_key, col_key, cell)``, one line per combination that occurs."""
    if how not in AGGREGATES:
        raise TableError(f"unknown aggregate '{how}'")
    _require(df, [rows, columns, value], check_rows)
    (row_key, row_text), (col_key, col_text) = group_key(df, rows, label), group_key(df, columns, label)
    cells = df.groupBy(row_key.alias("r"), col_key.alias("c")).agg(_cell(df, value, how).alias("cell"))
    cell = round_exact(ref("cell"), 2) if how in ("sum", "avg") else ref("cell")
    return cells.select(row_text(ref("r")).alias("row_key"), col_text(ref("c")).alias("col_key"), cell.alias("cell"))


def _exact(cell: Column) -> Column:
    return cell.try_cast("decimal(38,2)")


def _total(how: str) -> Column:
    """Sum of displayed cells. Sums and averages have two decimals, so they are added as
    decimals and the result does not depend on the order of addition."""
    cell = ref("cell")
    # Cells too large for the decimal type leave no exact sum; the sum of doubles stands in.
    return F.coalesce(F.when(F.count(_exact(cell)) == F.count(cell), F.try_sum(_exact(cell)).cast("double")), F.sum(cell)) \
        if how in ("sum", "avg") else F.sum(cell)


def pivot_long(
    df: DataFrame, rows: str, columns: str, value: str, how: str = "count",
    label: str = EMPTY_LABEL, check_rows: bool = False,
) -> DataFrame:
    """The whole table as ``(kind, row_key, col_key, cell)``: cells, row totals, column
    totals and the grand total. Any number of column keys; nothing comes to the driver."""
    cells = pivot_cells(df, rows, columns, value, how, label, check_rows)
    total = _total(how).alias("cell")
    none = F.lit(TOTAL_LABEL)
    parts = [
        cells.select(F.lit("cell").alias("kind"), "row_key", "col_key", "cell"),
        cells.groupBy("row_key").agg(total)
        .select(F.lit("row_total").alias("kind"), "row_key", none.alias("col_key"), "cell"),
        cells.groupBy("col_key").agg(total)
        .select(F.lit("col_total").alias("kind"), none.alias("row_key"), "col_key", "cell"),
        cells.groupBy().agg(F.coalesce(total, F.lit(0)).cast(cells.schema["cell"].dataType).alias("cell"))
        .select(F.lit("grand_total").alias("kind"), none.alias("row_key"), none.alias("col_key"), "cell"),
    ]
    return reduce(DataFrame.unionByName, parts)


def _across(cells: list[Column], how: str) -> Column:
    plain = reduce(operator.add, cells)
    if how in ("sum", "avg"):
        exact = reduce(F.try_add, [_exact(c) for c in cells]).cast("double")
        return F.coalesce(exact, plain)
    return plain


def crosstab(
    df: DataFrame, rows: str, columns: str, value: str, how: str = "count",
    label: str = EMPTY_LABEL, total: str = TOTAL_LABEL, corner: str | None = None,
) -> DataFrame:
    """Table with one column per column key, keys sorted as text, missing cells 0, a total
    column and a total row at the end.

    The column keys become column names, made unique where they differ in case only or equal
    another column's. They are fetched first, and Spark's own ``spark.sql.pivotMaxValues``
    limits their number; beyond it use :func:`pivot_long`, which has no limit.
    """
    if how not in AGGREGATES:
        raise TableError(f"unknown aggregate '{how}'")
    _require(df, [rows, columns, value], check_rows=False)
    limit = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
    key, text = group_key(df, columns, label)
    keys = df.select(key.alias("key")).distinct().limit(limit + 1).select(text(ref("key")).alias("col_key"))
    names = sorted(r["col_key"] for r in keys.collect())
    if not names:
        raise InsufficientData("the table has no rows")
    if len(names) > limit:
        raise TableError(f"more than {limit} column keys, set by spark.sql.pivotMaxValues; pivot_long has no limit")

    cells = pivot_cells(df, rows, columns, value, how, label)
    zero = F.lit(0).cast(cells.schema["cell"].dataType)

    # Keys may be any text, also equal but for case, so columns are named when all is done.
    codes = [f"c{i}" for i in range(len(names))]

    def wide(long: DataFrame, key: Column, last: int) -> DataFrame:
        table = long.select(key.alias("k"), "col_key", "cell").groupBy("k").pivot("col_key", names).agg(F.first("cell"))
        table = table.toDF("k", *codes)
        return table.select(F.lit(last).alias("at_end"), "k", *[F.coalesce(c, zero).alias(c) for c in codes])

    body = wide(cells, ref("row_key"), 0)
    sums = cells.groupBy("col_key").agg(_total(how).alias("cell"))
    table = body.unionByName(wide(sums, F.lit(total), 1)).orderBy("at_end", "k")
    shown = table.select("k", *codes, _across([ref(c) for c in codes], how).alias("total"))
    return shown.toDF(*normalise_headers([corner or f"{rows} \\ {columns}", *names, total]))
