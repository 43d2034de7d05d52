"""Cross-tabulation."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabloom as tl
from registry.common import MESSY_SQL, grown, in_order, messy, num_sql, refused, round_sql, table

_STATUS = ("F", "O", "P")
_CORNER = "o_orderpriority \\ o_orderstatus"


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


def _cells(how):
    return lambda s, d: tl.pivot_cells(messy(s, d), "p_type", "cell", "cell", how)


def _crosstab(how):
    return lambda s, d: tl.crosstab(_orders(s, d), "o_orderpriority", "o_orderstatus", "o_totalprice", how)


def _long(how, value="o_totalprice"):
    return lambda s, d: tl.pivot_long(_orders(s, d), "o_orderpriority", "o_orderstatus", value, how)


def _grown(spark, sf_dir):
    return grown(spark, sf_dir, "orders", "o_orderstatus", ["o_orderpriority", "o_orderstatus"], ["o_totalprice"])


def _odd_keys(spark, sf_dir, keys):
    """Orders whose status becomes one of two column keys that are hard to tell apart."""
    status = F.when(F.col("o_orderstatus") == "F", keys[0]).otherwise(keys[1]).alias("status")
    return tl.crosstab(_orders(spark, sf_dir).select("o_orderpriority", status, "o_totalprice"), "o_orderpriority", "status", "o_totalprice")


def _odd_keys_sql(first, second, total):
    cells = """count(*) FILTER (o_orderstatus = 'F')""", """count(*) FILTER (o_orderstatus <> 'F')"""
    columns = f'{cells[0]} AS "{first}", {cells[1]} AS "{second}", count(*) AS "{total}" FROM orders'
    return f"""SELECT o_orderpriority AS "o_orderpriority \\ status", {columns} GROUP BY 1
        UNION ALL SELECT '合计', {columns}"""


def _v7_unknown(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    return refused(orders, lambda: tl.crosstab(orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "median"))


def _v14_no_rows(spark, sf_dir):
    """A table without rows is reported before a column that it lacks."""
    orders = _orders(spark, sf_dir)
    return refused(orders, lambda: tl.crosstab(orders.where("o_orderkey IS NULL"), "o_orderpriority", "o_size", "o_totalprice"))


QUERIES = {
    "V7_unknown_aggregate": _v7_unknown,
    "V9_order": lambda s, d: in_order(_crosstab("count")(s, d)),
    "V14_no_rows": _v14_no_rows,
    "V8_crosstab_case_keys": lambda s, d: _odd_keys(s, d, ("A", "a")),
    "V8_crosstab_label_keys": lambda s, d: _odd_keys(s, d, ("row_key", "合计")),
    "V2_count": _cells("count"), "V3_sum": _cells("sum"), "V4_avg": _cells("avg"),
    "V5_min": _cells("min"), "V6_max": _cells("max"),
    "V3_grown": lambda s, d: _grown(s, d).pivot_cells("o_orderpriority", "o_orderstatus", "o_totalprice", "sum"),
    "V6_grown": lambda s, d: _grown(s, d).pivot_cells("o_orderpriority", "o_orderstatus", "o_totalprice", "max"),
    "V8_crosstab": _crosstab("count"),
    "V8_crosstab_sum": _crosstab("sum"),
    "V8_crosstab_missing": lambda s, d: tl.crosstab(messy(s, d), "cell", "p_type", "p_size", "count"),
    "V10_totals_avg": _long("avg"),
    "V10_totals_sum": _long("sum"),
    "V15_long_count": _long("count"),
    "V15_long_min": _long("min", "o_custkey"),
    "V15_long_max": _long("max", "o_custkey"),
    "V15_long_wide_keys": lambda s, d: tl.pivot_long(
        table(s, d, "lineitem"), "l_returnflag", "l_suppkey", "l_quantity", "sum"),
}

_AGG = {
    "count": "count(*)", "sum": round_sql("coalesce(sum(v), 0)"), "avg": round_sql("coalesce(avg(v), 0)"),
    "min": "coalesce(min(v), 0)", "max": "coalesce(max(v), 0)",
}


def _cells_sql(how: str) -> str:
    return f"""SELECT p_type AS row_key, coalesce(cell, '(空)') AS col_key, {_AGG[how]} AS cell
        FROM (SELECT *, {num_sql('cell')} AS v FROM {MESSY_SQL}) GROUP BY 1, 2"""


def _order_cells(how: str, value: str = "o_totalprice") -> str:
    return f"""SELECT o_orderpriority AS row_key, o_orderstatus AS col_key, {_AGG[how]} AS cell
        FROM (SELECT *, cast({value} AS double) AS v FROM orders) GROUP BY 1, 2"""


def _long_sql(cells: str, how: str) -> str:
    total = {"count": "cast(sum(cell) AS bigint)", "min": "sum(cell)", "max": "sum(cell)"}.get(
        how, "cast(sum(cast(cell AS decimal(38,2))) AS double)")
    return f"""WITH cells AS ({cells})
        SELECT 'cell' AS kind, row_key, col_key, cell FROM cells
        UNION ALL SELECT 'row_total', row_key, '合计', {total} FROM cells GROUP BY row_key
        UNION ALL SELECT 'col_total', '合计', col_key, {total} FROM cells GROUP BY col_key
        UNION ALL SELECT 'grand_total', '合计', '合计', {total} FROM cells"""


def _crosstab_sql(how: str) -> str:
    number, exact = ("bigint", "bigint") if how == "count" else ("double", "decimal(38,2)")
    one = [f"coalesce(max(cell) FILTER (col_key = '{s}'), 0)" for s in _STATUS]
    line = ", ".join(f"{x} AS \"{s}\"" for x, s in zip(one, _STATUS))
    across = " + ".join(f"cast({x} AS {exact})" for x in one)
    down = ", ".join(f"cast(sum(cast(cell AS {exact})) FILTER (col_key = '{s}') AS {number})" for s in _STATUS)
    return f"""WITH cells AS ({_order_cells(how)})
        SELECT row_key AS "{_CORNER}", {line}, cast({across} AS {number}) AS "合计" FROM cells GROUP BY row_key
        UNION ALL SELECT '合计', {down}, cast(sum(cast(cell AS {exact})) AS {number}) FROM cells"""


_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")


def _missing_sql() -> str:
    columns = ", ".join(f"count(*) FILTER (p_type = '{t}') AS \"{t}\"" for t in _TYPES)
    rows = f"SELECT coalesce(cell, '(空)') AS k, p_type FROM {MESSY_SQL}"
    return f"""SELECT k AS "cell \\ p_type", {columns}, count(*) AS "合计" FROM ({rows}) GROUP BY k
        UNION ALL SELECT '合计', {columns}, count(*) FROM ({rows})"""


ORACLES = {f"V{i}_{how}": _cells_sql(how) for i, how in enumerate(("count", "sum", "avg", "min", "max"), start=2)}
ORACLES |= {
    "V3_grown": _order_cells("sum"),
    "V6_grown": _order_cells("max"),
    "V8_crosstab": _crosstab_sql("count"),
    "V8_crosstab_sum": _crosstab_sql("sum"),
    "V8_crosstab_missing": _missing_sql(),
    "V10_totals_avg": _long_sql(_order_cells("avg"), "avg"),
    "V10_totals_sum": _long_sql(_order_cells("sum"), "sum"),
    "V15_long_count": _long_sql(_order_cells("count"), "count"),
    "V15_long_min": _long_sql(_order_cells("min", "o_custkey"), "min"),
    "V15_long_max": _long_sql(_order_cells("max", "o_custkey"), "max"),
    "V15_long_wide_keys": _long_sql(
        f"""SELECT l_returnflag AS row_key, cast(l_suppkey AS varchar) AS col_key, {_AGG['sum']} AS cell
            FROM (SELECT *, l_quantity AS v FROM lineitem) GROUP BY 1, 2""", "sum"),
}
ORACLES |= {
    "V7_unknown_aggregate": "SELECT count(*) AS rows, 'unknown aggregate ''median''' AS error FROM orders",
    "V9_order": f"""SELECT *, (row_number() OVER (ORDER BY "{_CORNER}" = '合计', "{_CORNER}"))::int AS line_no
        FROM ({_crosstab_sql("count")})""",
    "V14_no_rows": "SELECT count(*) AS rows, 'the table has no rows' AS error FROM orders",
    "V8_crosstab_case_keys": _odd_keys_sql("A", "a_2", "合计"),
    "V8_crosstab_label_keys": _odd_keys_sql("row_key", "合计", "合计_2"),
}
