"""Operator calls as plain dicts, and chains of them.

``{"op": "filter", "conditions": [...], "logic": "AND"}`` is a call of one operator; a
recipe is a list of such dicts. A chain is one Spark plan: nothing is written between
steps, so filters and column selection of later steps reach the first scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from tabloom.errors import TableError
from tabloom.functions.predicates import normalise_conditions
from tabloom.operators.columns import column_ops
from tabloom.operators.dedup import dedup, duplicate_groups, removed_rows
from tabloom.operators.distribution import share_table, value_counts
from tabloom.operators.filtering import filter_rows
from tabloom.operators.merge import merge_frames
from tabloom.operators.pivot import crosstab, pivot_long
from tabloom.operators.rows import source_range, with_row_index
from tabloom.operators.split import split_summary, with_output
from tabloom.operators.validate import empty_rates, outlier_rows, outliers, report, type_kinds
from tabloom.sources.tables import scan


def _filter(df: DataFrame, conditions: Sequence[Mapping], logic: str = "AND") -> DataFrame:
    return filter_rows(df, normalise_conditions(conditions), logic)


def _report(df: DataFrame, checks: Mapping) -> DataFrame:
    return report(df, checks, check_rows=False)


def _merge(df: DataFrame, paths: Sequence[str], format: str = "parquet", by: str = "position",
           source_no: str | None = None, address: str | None = None, **options) -> DataFrame:
    """The table so far, then the inputs at ``paths``."""
    added = [scan(df.sparkSession, p, format, **options) for p in dict.fromkeys(paths)]
    return merge_frames([df, *added], by, source_no, address)


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    "filter": _filter,
    "columns": column_ops,
    "merge": _merge,
    "row_numbers": with_row_index,
    "row_range": source_range,
    "dedup": dedup,
    "duplicate_groups": duplicate_groups,
    "removed_rows": removed_rows,
    "value_counts": value_counts,
    "share_table": share_table,
    "split": with_output,
    "split_summary": split_summary,
    "pivot": pivot_long,
    "crosstab": crosstab,
    "empty_rates": empty_rates,
    "type_kinds": type_kinds,
    "outliers": outliers,
    "outlier_rows": outlier_rows,
    "validate": _report,
}


def apply_op(df: DataFrame, spec: Mapping) -> DataFrame:
    options = dict(spec)
    name = options.pop("op", None)
    if name not in OPERATORS:
        raise TableError(f"unknown operator '{name}'")
    return OPERATORS[name](df, **options)


def run_recipe(df: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    for spec in steps:
        df = apply_op(df, spec)
    return df


def to_json(steps: Sequence[Mapping]) -> str:
    return json.dumps(list(steps), ensure_ascii=False, indent=2)


def from_json(text: str) -> list[dict]:
    steps = json.loads(text)
    if not isinstance(steps, list) or not all(isinstance(s, dict) and "op" in s for s in steps):
        raise TableError("a recipe is a list of objects with 'op'")
    return steps


def run_with_summary(
    df: DataFrame, steps: Sequence[Mapping], write: Callable[[DataFrame], None]
) -> DataFrame:
    """Run a recipe into a sink and return ``(step_no, op, rows)`` per step.

    Rows are counted while the sink runs, in the same job; step 0 is the input.
    """
    rows = F.count(F.lit(1)).alias("rows")
    seen = [("input", Observation())]
    df = df.observe(seen[0][1], rows)
    for spec in steps:
        seen.append((spec.get("op"), Observation()))
        df = apply_op(df, spec).observe(seen[-1][1], rows)
    spark = df.sparkSession
    write(df)
    lines = [(i, name, int(o.get["rows"])) for i, (name, o) in enumerate(seen)]
    return spark.createDataFrame(lines, "step_no int, op string, rows bigint")
