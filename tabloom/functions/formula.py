"""Computed-column formulas as native column arithmetic.

``{name}`` stands for the number in that column (an empty cell is 0). The rest is read
by Python's own ``ast`` module and checked against a short list of allowed nodes; nothing
is evaluated as code. A step that fails for a row gives NULL for that row.

A value that a step needs more than once becomes a helper column, computed in a select of
its own, so that nested formulas stay small expressions instead of doubling at each step.
"""

from __future__ import annotations

import ast
import operator
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from tabloom.errors import FormulaError
from tabloom.functions.cells import floor_double, num0, ref, round_exact

_COMPARE = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge,
            ast.Eq: operator.eq, ast.NotEq: operator.ne}
_PLAIN = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: F.try_divide}


class _Value(NamedTuple):
    column: Column
    level: int  # number of selects that must come before the one that may use it


def _finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def _known(columns: list[Column], result: Column) -> Column:
    """``result`` only where no argument is NULL (least, greatest and CASE skip NULLs)."""
    return F.when(reduce(operator.and_, [c.isNotNull() for c in columns]), result)


class _Builder:
    """Turns one formula into helper columns, by level, and a final value."""

    def __init__(self, inputs: Mapping[str, Column], prefix: str):
        self.inputs, self.prefix = inputs, prefix
        self.helpers: list[tuple[int, Column]] = []

    def bind(self, value: _Value) -> _Value:
        name = f"{self.prefix}{len(self.helpers)}"
        self.helpers.append((value.level, value.column.alias(name)))
        return _Value(ref(name), value.level + 1)

    def join(self, make: Callable[..., Column], *values: _Value) -> _Value:
        return _Value(make(*[v.column for v in values]), max(v.level for v in values))

    def build(self, node: ast.AST) -> _Value:
        if isinstance(node, ast.Expression):
            return self.build(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (bool, int, float)):
            return _Value(F.lit(float(node.value)), 0)
        if isinstance(node, ast.Name) and node.id in self.inputs:
            return _Value(self.inputs[node.id], 0)
        for kind, make in (
            (ast.UnaryOp, self.sign), (ast.BinOp, self.arithmetic), (ast.Compare, self.comparison),
            (ast.BoolOp, self.choice_of_operands), (ast.IfExp, self.conditional), (ast.Call, self.call),
        ):
            if isinstance(node, kind):
                return make(node)
        raise FormulaError(f"'{ast.unparse(node)}' is not allowed in a formula")

    def sign(self, node: ast.UnaryOp) -> _Value:
        value = self.build(node.operand)
        if isinstance(node.op, ast.USub):
            return self.join(operator.neg, value)
        if isinstance(node.op, ast.UAdd):
            return value
        if isinstance(node.op, ast.Not):
            return self.join(lambda x: (x == 0).cast("double"), value)
        raise FormulaError("unsupported sign")

    def modulo(self, a: _Value, b: _Value) -> _Value:
        rest = self.bind(self.join(F.try_mod, a, b))
        # The remainder takes the sign of the divisor.
        return self.join(lambda r, y: F.when((r != 0) & ((r < 0) != (y < 0)), r + y).otherwise(r), rest, b)

    def floor_division(self, a: _Value, b: _Value) -> _Value:
        rest = self.modulo(a, b)
        exact = self.bind(self.join(lambda x, r, y: F.try_divide(x - r, y), a, rest, b))
        # Already whole but for rounding of the division itself.
        return self.join(
            lambda q: floor_double(q) + F.when(q - floor_double(q) > 0.5, F.lit(1.0)).otherwise(F.lit(0.0)), exact)

    def power(self, a: _Value, b: _Value) -> _Value:
        return self.join(_finite, self.bind(self.join(F.pow, a, b)))

    def arithmetic(self, node: ast.BinOp) -> _Value:
        a, b = self.build(node.left), self.build(node.right)
        if type(node.op) in _PLAIN:
            return self.join(_PLAIN[type(node.op)], a, b)
        a, b = self.bind(a), self.bind(b)
        for kind, make in ((ast.Mod, self.modulo), (ast.FloorDiv, self.floor_division), (ast.Pow, self.power)):
            if isinstance(node.op, kind):
                return make(a, b)
        raise FormulaError("unsupported arithmetic")

    def comparison(self, node: ast.Compare) -> _Value:
        values = [self.build(n) for n in (node.left, *node.comparators)]
        tests = []
        for op, left, right in zip(node.ops, values, values[1:]):
            if type(op) not in _COMPARE:
                raise FormulaError("unsupported comparison")
            tests.append(self.join(_COMPARE[type(op)], left, right))
        return self.join(lambda *t: reduce(operator.and_, t).cast("double"), *tests)

    def choice_of_operands(self, node: ast.BoolOp) -> _Value:
        # "a and b" is b when a is not zero, else a; "or" the other way round.
        goes_on = operator.ne if isinstance(node.op, ast.And) else operator.eq
        result = self.build(node.values[-1])
        for earlier in reversed(node.values[:-1]):
            first = self.bind(self.build(earlier))
            result = self.join(
                lambda x, y: _known([x], F.when(goes_on(x, 0), y).otherwise(x)), first, result)
        return result

    def conditional(self, node: ast.IfExp) -> _Value:
        test = self.bind(self.build(node.test))
        return self.join(
            lambda t, a, b: _known([t], F.when(t != 0, a).otherwise(b)),
            test, self.build(node.body), self.build(node.orelse))

    def call(self, node: ast.Call) -> _Value:
        if not isinstance(node.func, ast.Name) or node.keywords:
            raise FormulaError("unsupported call")
        name, count = node.func.id, len(node.args)
        if name == "round" and count == 2:
            digits = _whole_number(node.args[1])
            value = self.bind(self.build(node.args[0]))
            return self.join(lambda x: round_exact(x, digits), value)
        args = [self.bind(self.build(a)) for a in node.args]
        if name in ("min", "max") and count >= 2:
            pick = F.least if name == "min" else F.greatest
            return self.join(lambda *xs: _known(list(xs), pick(*xs)), *args)
        if name == "pow" and count == 2:
            return self.power(*args)
        single = {
            "abs": F.abs, "float": lambda x: x, "round": F.rint,
            "int": lambda x: F.when(x < 0, -floor_double(-x)).otherwise(floor_double(x)),
        }
        if count == 1 and name in single:
            return self.join(single[name], *args)
        raise FormulaError(f"'{name}' with {count} values is not allowed in a formula")


def _whole_number(node: ast.expr) -> int:
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
        return -_whole_number(node.operand)
    if not (isinstance(node, ast.Constant) and type(node.value) is int):
        raise FormulaError("round takes a fixed number of digits")
    return node.value


def _compile(df: DataFrame, text: str, prefix: str) -> tuple[_Builder, _Value]:
    body, inputs = text, {}
    for i, name in enumerate(df.columns):
        marker = "{" + name + "}"
        if marker in body:
            body = body.replace(marker, f" cell_{i}_ ")
            inputs[f"cell_{i}_"] = num0(df, name)
    builder = _Builder(inputs, prefix)
    value = builder.build(ast.parse(body.strip(), mode="eval"))
    return builder, builder.bind(builder.join(_finite, builder.bind(value)))


def with_formulas(
    df: DataFrame, calc: Iterable[Mapping[str, str]], strict: bool = False
) -> tuple[DataFrame, list[Column]]:
    """The frame with helper columns, and one DOUBLE column per ``{"name", "expression"}``,
    rounded to two digits, NULL where it fails.

    Every formula is built on the frame's own columns, never on other computed ones. A
    formula that cannot be read at all (bad syntax, an unknown name) gives an all-NULL
    column, or raises :class:`FormulaError` when ``strict``.
    """
    levels: dict[int, list[Column]] = {}
    results = []
    for i, spec in enumerate(calc):
        try:
            builder, value = _compile(df, spec["expression"], f"_f{i}_")
        except (SyntaxError, ValueError, OverflowError, RecursionError) as error:
            if strict:
                raise FormulaError(f"cannot use formula '{spec['expression']}': {error}") from error
            results.append(F.lit(None).cast("double").alias(spec["name"]))
            continue
        for level, helper in builder.helpers:
            levels.setdefault(level, []).append(helper)
        results.append(round_exact(value.column, 2).alias(spec["name"]))
    for level in sorted(levels):
        df = df.select("*", *levels[level])
    return df, results
