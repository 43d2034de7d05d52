"""Operator calls as dicts, chained; and the flagship query."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame

import tabloom as tl
from registry.common import round_sql, table
from tabloom.plans import recipe
from tabloom.storage import scratch_dir

STEPS = [
    {"op": "filter", "conditions": [
        {"column": "l_quantity", "operator": "gt", "value": "30"},
        {"column": "l_returnflag", "operator": "neq", "value": "N"},
    ]},
    {"op": "columns", "keep": ["l_returnflag", "l_linestatus"], "renames": {"l_returnflag": "flag"},
     "calc": [{"name": "revenue", "expression": "{l_extendedprice} * (1 - {l_discount})"}]},
    {"op": "pivot", "rows": "flag", "columns": "l_linestatus", "value": "revenue", "how": "sum"},
]


def revenue_pivot(spark, sf_dir, steps=STEPS):
    return tl.run_recipe(table(spark, sf_dir, "lineitem"), steps)


def _c1_saved(spark, sf_dir):
    """The recipe stored as JSON and loaded again."""
    return revenue_pivot(spark, sf_dir, recipe.from_json(recipe.to_json(STEPS)))


def _c3_summary(spark, sf_dir):
    out = scratch_dir(spark)
    return tl.run_with_summary(table(spark, sf_dir, "lineitem"), STEPS, lambda df: df.write.parquet(out))


def _c2_dedup_split(spark, sf_dir):
    steps = [{"op": "dedup", "columns": ["o_custkey", "o_orderpriority"], "order_by": ["o_orderkey"]},
             {"op": "split_summary", "column": "o_orderpriority", "mode": "sheets"}]
    return tl.run_recipe(table(spark, sf_dir, "orders"), steps)


def _c2_merge(spark, sf_dir):
    """Nations appended below customers by position; the first row of each nation in that order stays."""
    steps = [{"op": "columns", "keep": ["c_nationkey", "c_custkey", "c_name"]},
             {"op": "merge", "paths": [f"{sf_dir}/nation.parquet"], "address": "at"},
             {"op": "dedup", "columns": ["c_nationkey"], "order_by": ["at"]},
             {"op": "columns", "keep": ["c_nationkey", "c_custkey"]}]
    return tl.run_recipe(table(spark, sf_dir, "customer"), steps)


GRAPH = [
    {"name": "kept", "from": "lineitem", "op": "filter",
     "conditions": [{"column": "l_quantity", "operator": "gt", "value": "30"}]},
    {"name": "narrow", "from": "kept", "op": "columns", "keep": ["l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber"]},
    {"name": "cells", "from": "narrow", "op": "pivot", "rows": "l_returnflag", "columns": "l_linestatus",
     "value": "l_orderkey", "how": "count"},
    {"name": "modes", "from": "narrow", "op": "value_counts", "column": "l_linenumber"},
    {"name": "flags", "from": "narrow", "op": "split_summary", "column": "l_returnflag"},
    {"name": "buyers", "from": "customer", "op": "columns", "keep": ["c_nationkey"]},
    {"name": "sellers", "from": "supplier", "op": "columns", "keep": ["s_nationkey"]},
    {"name": "people", "from": ["buyers", "sellers"], "op": "merge", "by": "position"},
    {"name": "nations", "from": "people", "op": "value_counts", "column": "c_nationkey"},
]


def _graph(spark, sf_dir):
    return tl.Graph({n: table(spark, sf_dir, n) for n in ("lineitem", "customer", "supplier")}, GRAPH)


def _c2_graph(spark, sf_dir):
    """Three results of one filtered scan and one of two merged inputs, read back and put below each other."""
    base = scratch_dir(spark)
    _graph(spark, sf_dir).run({n: f"{base}/{n}" for n in ("cells", "modes", "flags", "nations")})
    read = {n: spark.read.parquet(f"{base}/{n}") for n in ("cells", "modes", "flags", "nations")}
    read["cells"] = read["cells"].where("kind = 'cell'").selectExpr("concat(row_key, '/', col_key) AS value", "cell AS n")
    rows = [df.selectExpr(f"'{n}' AS result", "value", "cast(n AS bigint) AS n") for n, df in read.items()]
    return reduce(DataFrame.unionByName, rows)


def _c3_graph_summary(spark, sf_dir):
    base = scratch_dir(spark)
    return _graph(spark, sf_dir).run({n: f"{base}/{n}" for n in ("modes", "flags", "nations")})


QUERIES = {"C2_graph": _c2_graph, "C3_graph_summary": _c3_graph_summary, "C1_saved_recipe": _c1_saved, "C2_recipe": partial(revenue_pivot), "C2_dedup_split": _c2_dedup_split,
           "C2_merge": _c2_merge,
           "C3_summary": _c3_summary}

_ROWS = f"""SELECT l_returnflag AS flag, l_linestatus, {round_sql('l_extendedprice * (1 - l_discount)')} AS revenue
    FROM lineitem WHERE l_quantity > 30 AND l_returnflag <> 'N'"""
_TOTAL = "cast(sum(cast(cell AS decimal(38,2))) AS double)"
_PIVOT = f"""WITH cells AS (SELECT flag AS row_key, l_linestatus AS col_key,
        cast(sum(cast(revenue AS decimal(38,2))) AS double) AS cell FROM ({_ROWS}) GROUP BY 1, 2)
    SELECT 'cell' AS kind, row_key, col_key, cell FROM cells
    UNION ALL SELECT 'row_total', row_key, '合计', {_TOTAL} FROM cells GROUP BY row_key
    UNION ALL SELECT 'col_total', '合计', col_key, {_TOTAL} FROM cells GROUP BY col_key
    UNION ALL SELECT 'grand_total', '合计', '合计', {_TOTAL} FROM cells"""

ORACLES = {
    "C2_graph": """WITH kept AS (SELECT * FROM lineitem WHERE l_quantity > 30)
        SELECT 'cells' AS result, concat(l_returnflag, '/', l_linestatus) AS value, count(*) AS n FROM kept GROUP BY 2
        UNION ALL SELECT 'modes', cast(l_linenumber AS varchar), count(*) FROM kept GROUP BY 2
        UNION ALL SELECT 'flags', l_returnflag, count(*) FROM kept GROUP BY 2
        UNION ALL SELECT 'nations', cast(k AS varchar), count(*) FROM (
            SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY 2""",
    "C3_graph_summary": """WITH kept AS (SELECT * FROM lineitem WHERE l_quantity > 30)
        SELECT 'narrow' AS result, 'columns' AS op, count(*) AS rows, false AS sink FROM kept
        UNION ALL SELECT 'modes', 'value_counts', count(DISTINCT l_linenumber), true FROM kept
        UNION ALL SELECT 'flags', 'split_summary', count(DISTINCT l_returnflag), true FROM kept
        UNION ALL SELECT 'nations', 'value_counts', count(DISTINCT k), true FROM (
            SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)""",
    "C1_saved_recipe": _PIVOT,
    "C2_recipe": _PIVOT,
    "C2_dedup_split": """SELECT o_orderpriority AS value, o_orderpriority AS output,
        count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1""",
    "C2_merge": """SELECT c_nationkey, arg_min(c_custkey, (input, place)) AS c_custkey FROM (
        SELECT 1 AS input, c_custkey AS place, c_nationkey, cast(c_custkey AS varchar) AS c_custkey FROM customer
        UNION ALL SELECT 2, n_nationkey, n_nationkey, n_name FROM nation) GROUP BY 1""",
    "C3_summary": """SELECT 0 AS step_no, 'input' AS op, count(*) AS rows FROM lineitem
        UNION ALL SELECT 1, 'filter', count(*) FROM lineitem WHERE l_quantity > 30 AND l_returnflag <> 'N'
        UNION ALL SELECT 2, 'columns', count(*) FROM lineitem WHERE l_quantity > 30 AND l_returnflag <> 'N'
        UNION ALL SELECT 3, 'pivot', (count(DISTINCT l_returnflag) + 1) * (count(DISTINCT l_linestatus) + 1)
        FROM lineitem WHERE l_quantity > 30 AND l_returnflag <> 'N'""",
}
