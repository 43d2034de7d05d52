"""Helpers shared by the registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

import tabloom as tl
from tabloom.storage import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refused(df: DataFrame, call: Callable[[], object]) -> DataFrame:
    """``(rows, error)``: the table's rows, and the reason why the call is refused."""
    try:
        call()
    except tl.TableError as error:
        return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(str(error)).alias("error"))
    raise AssertionError("not refused")


def in_order(df: DataFrame, name: str = "line_no") -> DataFrame:
    """A small sorted result with the place of each of its rows, so that its order is compared too."""
    placed = df.withColumn("_at", F.monotonically_increasing_id())
    return placed.withColumn(name, F.row_number().over(Window.orderBy("_at"))).drop("_at")


# The test tables hold no empty cells and no mixed text, so queries about those rules use
# this column, derived from every row of ``part`` with the same CASE on both sides.
CELL = """CASE
  WHEN p_size <= 6 THEN NULL
  WHEN p_size <= 9 THEN ''
  WHEN p_size <= 12 THEN '  '
  WHEN p_size <= 14 THEN '　'
  WHEN p_size <= 18 THEN 'n/a'
  WHEN p_size <= 20 THEN 'None'
  WHEN p_size <= 22 THEN '0'
  WHEN p_size <= 26 THEN ' ' || cast(p_size AS string) || ' '
  WHEN p_size <= 29 THEN cast(p_size AS string) || 'e1'
  WHEN p_size <= 31 THEN cast(p_size AS string) || 'd'
  WHEN p_size <= 34 THEN '-' || cast(p_size AS string) || '.5'
  WHEN p_size <= 36 THEN 'Abc'
  ELSE cast(p_size AS string) END"""

MESSY_SQL = f"(SELECT p_partkey, p_type, p_size, p_retailprice, {CELL} AS cell FROM part)"


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", "p_type", "p_size", "p_retailprice", F.expr(CELL).alias("cell"))


NUMBER_RE = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"


def num_sql(c: str) -> str:
    return f"(CASE WHEN regexp_full_match(trim({c}), '{NUMBER_RE}') THEN cast(trim({c}) AS double) END)"


def num0_sql(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL OR {c} = '' THEN 0.0 ELSE {num_sql(c)} END)"


def blank_sql(c: str) -> str:
    return f"({c} IS NULL OR trim({c}, ' 　') = '')"


def round_sql(x: str, digits: int = 2) -> str:
    """Rounding of the exact binary value, as C formatting does it; -0.0 becomes 0.0."""
    return f"(cast(printf('%.{digits}f', {x}) AS double) + 0.0)"


def text_sql(x: str) -> str:
    """Text of a DOUBLE: no fraction for whole numbers."""
    return f"(CASE WHEN {x} = floor({x}) THEN cast(cast({x} AS bigint) AS varchar) ELSE cast({x} AS varchar) END)"


def grown(spark, sf_dir: str, name: str, status: str, columns: list[str], values: list[str] = ()):
    """States of a table that came in three batches, by a status F, O or any other, the second one twice."""
    states = tl.GroupStates(spark, scratch_dir(spark), columns, values)
    rows, status = table(spark, sf_dir, name), F.coalesce(F.col(status), F.lit(""))
    states.add(rows.where(status == "F"), "first")
    states.add(rows.where(status == "O"), "second")
    states.compact()
    states.add(rows.where(status == "O"), "second")
    states.add(rows.where(~status.isin("F", "O")), "third")
    return states
