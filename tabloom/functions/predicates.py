"""Filter conditions as native predicates.

A condition is ``{"column": ..., "operator": ..., "value": ..., "value2": ...}``. Targets
are parsed once on the driver. On typed columns the predicate is a bare comparison (plus
``IS NULL`` where an empty cell, read as 0 or as "", would match), so that it reaches the
scan as a pushed filter; only text columns compared as numbers need a conversion per row.
"""

from __future__ import annotations

import datetime as dt
import math
import operator
import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.errors import MissingColumn, TableError
from tabloom.functions.cells import (
    as_text, dtype, is_blank, is_numeric, is_text, num0, ref, text0,
)

_COMPARE = {"gt": operator.gt, "lt": operator.lt, "gte": operator.ge, "lte": operator.le}
OPERATORS = ("eq", "neq", "gt", "lt", "gte", "lte", "contains", "not_contains", "between",
             "is_empty", "not_empty")

_INT_RANGE = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def normalise_conditions(conditions: Iterable[Mapping]) -> list[dict]:
    """Drop incomplete conditions, trim targets; at least one must remain."""
    kept = []
    for cond in conditions:
        op = cond.get("operator")
        if not cond.get("column"):
            continue
        if op in ("is_empty", "not_empty"):
            kept.append({"column": cond["column"], "operator": op})
            continue
        wanted = ("value", "value2") if op == "between" else ("value",)
        targets = {k: "" if cond.get(k) is None else str(cond[k]).strip() for k in wanted}
        if all(targets.values()):
            kept.append({"column": cond["column"], "operator": op, **targets})
    if not kept:
        raise TableError("no complete condition given")
    return kept


def _target_number(target: object) -> float | None:
    try:
        value = float(target)
    except (TypeError, ValueError):
        return None
    return None if math.isnan(value) else value


def _number_test(c: Column, t: T.DataType, op: str, target: float) -> Column:
    """``c op target`` on a numeric column, in a form a Parquet scan can use."""
    if isinstance(t, T.IntegralType) and abs(target) < 2**62:
        bits = _INT_RANGE[type(t)]
        # v > 2.5 is v > 2, v >= 2.5 is v >= 3: same rows, integer literal, no cast.
        bound = math.floor(target) if op in ("gt", "lte") else math.ceil(target)
        if -(2**bits) <= bound < 2**bits:
            return _COMPARE[op](c, F.lit(bound).cast(t))
    test = _COMPARE[op](c, F.lit(target))
    if op in ("gt", "gte") and isinstance(t, (T.FloatType, T.DoubleType)):
        test = test & ~F.isnan(c)  # Spark sorts NaN last, a cell comparison rejects it
    return test


def _numeric(df: DataFrame, name: str, tests: list[tuple[str, float]]) -> Column:
    c, t = ref(name), dtype(df, name)
    empty_matches = all(_COMPARE[op](0.0, target) for op, target in tests)
    if is_numeric(t):
        pred = reduce(operator.and_, [_number_test(c, t, op, v) for op, v in tests])
        return (pred | c.isNull()) if empty_matches else pred
    if is_text(t) or isinstance(t, T.BooleanType):
        value = num0(df, name)
        return reduce(operator.and_, [_COMPARE[op](value, F.lit(v)) for op, v in tests])
    # Dates and nested values are never numbers; only an empty cell can count as 0.
    return c.isNull() if empty_matches else F.lit(False)


def _whole_text(value: float) -> str:
    if value == int(value) and abs(value) < 1e16:
        return str(int(value))
    return repr(value)


def _typed_literal(t: T.DataType, text: str) -> Column | None:
    """The one value of type ``t`` whose cell text is ``text``, or None if there is none."""
    if isinstance(t, T.IntegralType):
        if re.fullmatch(r"0|-?[1-9][0-9]*", text):
            bits = _INT_RANGE[type(t)]
            if -(2**bits) <= int(text) < 2**bits:
                return F.lit(int(text)).cast(t)
        return None
    if isinstance(t, T.DoubleType):
        value = _target_number(text)
        if value is None or math.isinf(value) or _whole_text(value) != text:
            return None
        return F.lit(value)
    if isinstance(t, T.BooleanType):
        return F.lit(text == "True") if text in ("True", "False") else None
    if isinstance(t, T.DateType):
        parse, show = dt.date.fromisoformat, dt.date.isoformat
    else:
        parse, show = dt.datetime.fromisoformat, str
    try:
        return F.lit(text).cast(t) if show(parse(text)) == text else None
    except ValueError:
        return None


_LITERAL_TYPES = (T.IntegralType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampNTZType)


def _equal(df: DataFrame, name: str, target: object, negate: bool) -> Column:
    c, t = ref(name), dtype(df, name)
    text = str(target)
    if isinstance(t, _LITERAL_TYPES) and text not in ("nan", "inf", "-inf"):
        literal = _typed_literal(t, text)
        if literal is None:
            same = c.isNotNull() if negate else F.lit(False)
        else:
            same = (c != literal) if negate else (c == literal)
    else:
        shown = as_text(c, t)
        same = (shown != text) if negate else (shown == text)
    null_matches = (target != "") if negate else (target == "")
    return (same | c.isNull()) if null_matches else same


def condition(df: DataFrame, cond: Mapping) -> Column:
    """One condition as a predicate; NULL from it means "no match"."""
    name, op = cond["column"], cond["operator"]
    if name not in df.columns:
        raise MissingColumn(name)
    target = cond.get("value")
    if op in ("eq", "neq"):
        return _equal(df, name, target, negate=op == "neq")
    if op in _COMPARE:
        value = _target_number(target)
        return F.lit(False) if value is None else _numeric(df, name, [(op, value)])
    if op == "between":
        low, high = _target_number(target), _target_number(cond.get("value2"))
        if low is None or high is None:
            return F.lit(False)
        return _numeric(df, name, [("gte", low), ("lte", high)])
    if op in ("contains", "not_contains"):
        found = F.contains(F.lower(text0(df, name)), F.lit(str(target).lower()))
        return ~found if op == "not_contains" else found
    if op == "is_empty":
        return is_blank(df, name)
    if op == "not_empty":
        return ~is_blank(df, name)
    raise TableError(f"unknown operator '{op}'")


def predicate(df: DataFrame, conditions: Iterable[Mapping], logic: str = "AND") -> Column:
    """All conditions joined: an empty list is true under AND and false under OR."""
    parts = [condition(df, cond) for cond in conditions]
    if logic == "AND":
        return reduce(operator.and_, parts) if parts else F.lit(True)
    if logic == "OR":
        return reduce(operator.or_, parts) if parts else F.lit(False)
    raise TableError(f"unknown logic '{logic}'")
