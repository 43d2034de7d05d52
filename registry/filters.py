"""F1-F16: conditions and filters; K1: row counters."""

from __future__ import annotations

from functools import partial

import tabloom as tl
from registry.common import MESSY_SQL, blank_sql, messy, num0_sql, refused, table
from tabloom.storage import scratch_dir
from tabloom.streaming.stateless import run_stateless


def _on_cell(spark, sf_dir, operator, value=None, value2=None):
    condition = {"column": "cell", "operator": operator, "value": value, "value2": value2}
    return tl.filter_rows(messy(spark, sf_dir), [condition]).select("p_partkey", "cell")


def _on(name, conditions, logic="AND"):
    def query(spark, sf_dir):
        return tl.filter_rows(table(spark, sf_dir, name), conditions, logic)
    return query


_N = num0_sql("cell")
_FROM = f"SELECT p_partkey, cell FROM {MESSY_SQL} WHERE "
# A text column reads NULL as "" when it is searched.
_LOWER = "lower(coalesce(cell, ''))"

_CELL_CASES = {
    "F1_eq": (("eq", "0"), "cell = '0'"),
    "F1_eq_empty_target": (("eq", ""), "cell IS NULL OR cell = ''"),
    "F2_neq": (("neq", "n/a"), "cell IS NULL OR cell <> 'n/a'"),
    "F3_gt": (("gt", "40"), f"{_N} > 40"),
    "F4_lt": (("lt", "1"), f"{_N} < 1"),
    "F5_gte": (("gte", "0"), f"{_N} >= 0"),
    "F6_lte": (("lte", "24"), f"{_N} <= 24"),
    "F7_contains": (("contains", "A"), f"contains({_LOWER}, 'a')"),
    "F8_not_contains": (("not_contains", "a"), f"NOT contains({_LOWER}, 'a')"),
    "F9_between": (("between", "-33", "270"), f"{_N} BETWEEN -33 AND 270"),
    "F10_is_empty": (("is_empty",), blank_sql("cell")),
    "F11_not_empty": (("not_empty",), f"NOT {blank_sql('cell')}"),
    "F15_bad_target": (("gt", "many"), "false"),
}

_AND = [
    {"column": "l_quantity", "operator": "gt", "value": "30"},
    {"column": "l_returnflag", "operator": "eq", "value": "R"},
    {"column": "l_discount", "operator": "between", "value": "0.02", "value2": "0.06"},
]
_OR = [
    {"column": "l_quantity", "operator": "lte", "value": "2"},
    {"column": "l_linenumber", "operator": "eq", "value": "7"},
    {"column": "l_shipdate", "operator": "contains", "value": "1999-12-"},
]
_TYPED = [
    {"column": "o_totalprice", "operator": "lt", "value": "50000.5"},
    {"column": "o_orderdate", "operator": "neq", "value": "1998-10-03 00:00:00"},
    {"column": "o_custkey", "operator": "gte", "value": "10.5"},
    {"column": "o_orderpriority", "operator": "not_contains", "value": "urgent"},
]
_INCOMPLETE = [
    {"column": "c_acctbal", "operator": "between", "value": "100", "value2": ""},
    {"column": "c_acctbal", "operator": "gt", "value": "  "},
    {"column": "", "operator": "eq", "value": "x"},
    {"column": "c_mktsegment", "operator": "neq", "value": " BUILDING "},
]


def _f16_incomplete(spark, sf_dir):
    return tl.filter_rows(table(spark, sf_dir, "customer"), tl.normalise_conditions(_INCOMPLETE))


def _unmatched(spark, sf_dir):
    return tl.unmatched_rows(table(spark, sf_dir, "lineitem"), _AND)


def _k1_counts(spark, sf_dir):
    return tl.filter_counts(messy(spark, sf_dir), [{"column": "cell", "operator": "gt", "value": "20"}])


def _f12_stream(spark, sf_dir):
    """The same filter on a file stream, run until the files present are used up."""
    schema = table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(sf_dir)
    steps = [{"op": "filter", "conditions": _AND}, {"op": "columns", "keep": ["l_orderkey", "l_quantity"]}]
    out = scratch_dir(spark)
    sink = run_stateless(stream, steps).writeStream.format("parquet").trigger(availableNow=True)
    sink.option("checkpointLocation", f"{out}/state").start(f"{out}/rows").awaitTermination()
    return spark.read.parquet(f"{out}/rows")


def _f14_missing_column(spark, sf_dir):
    """A column that the table lacks is named before anything is read."""
    orders = table(spark, sf_dir, "orders")
    return refused(orders, lambda: tl.filter_rows(orders, [{"column": "o_size", "operator": "eq", "value": "1"}]))


QUERIES = {name: partial(_on_cell, **dict(zip(("operator", "value", "value2"), args)))
           for name, (args, _) in _CELL_CASES.items()}
QUERIES |= {
    "F12_and": _on("lineitem", _AND),
    "F12_and_typed": _on("orders", _TYPED),
    "F12_no_conditions": _on("orders", []),
    "F12_stream": _f12_stream,
    "F12_unmatched": _unmatched,
    "F13_or": _on("lineitem", _OR, "OR"),
    "F13_no_conditions": _on("orders", [], "OR"),
    "F14_missing_column": _f14_missing_column,
    "F16_incomplete": _f16_incomplete,
    "K1_counts": _k1_counts,
}

_AND_SQL = "l_quantity > 30 AND l_returnflag = 'R' AND l_discount BETWEEN 0.02 AND 0.06"
ORACLES = {name: _FROM + f"({where})" for name, (_, where) in _CELL_CASES.items()}
ORACLES |= {
    "F12_and": f"SELECT * FROM lineitem WHERE {_AND_SQL}",
    "F12_and_typed": """SELECT * FROM orders WHERE o_totalprice < 50000.5
        AND o_orderdate <> TIMESTAMP '1998-10-03 00:00:00' AND o_custkey >= 10.5
        AND NOT contains(lower(o_orderpriority), 'urgent')""",
    "F12_no_conditions": "SELECT * FROM orders",
    "F12_stream": f"SELECT l_orderkey, l_quantity FROM lineitem WHERE {_AND_SQL}",
    "F12_unmatched": f"SELECT * FROM lineitem WHERE NOT ({_AND_SQL})",
    "F13_or": """SELECT * FROM lineitem WHERE l_quantity <= 2 OR l_linenumber = 7
        OR contains(cast(l_shipdate AS varchar), '1999-12-')""",
    "F13_no_conditions": "SELECT * FROM orders WHERE false",
    "F14_missing_column": """SELECT count(*) AS rows, 'column ''o_size'' does not exist' AS error FROM orders""",
    "F16_incomplete": "SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING'",
    "K1_counts": f"SELECT count(*) AS total, count(*) FILTER ({_N} > 20) AS matched FROM {MESSY_SQL}",
}
