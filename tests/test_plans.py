"""Plans that must hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

import tabloom as tl

SF = "/root/testdata/sf0.001"


def _plan(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture(scope="module")
def lineitem(spark):
    return spark.read.parquet(f"{SF}/lineitem.parquet")


@pytest.mark.parametrize("operator,value,pushed", [
    ("gt", "30", "GreaterThan(l_quantity,30.0)"), ("lt", "5", "Or(LessThan(l_quantity,5.0),IsNull(l_quantity))"),
    ("eq", "7", "EqualTo(l_quantity,7.0)"), ("is_empty", None, "IsNull(l_quantity)"),
    ("between", "3", "GreaterThanOrEqual(l_quantity,3.0), LessThanOrEqual(l_quantity,9.0)"),
])
def test_filters_reach_the_scan(lineitem, operator, value, pushed):
    cond = {"column": "l_quantity", "operator": operator, "value": value, "value2": "9"}
    plan = _plan(tl.column_ops(tl.filter_rows(lineitem, [cond]), keep=["l_orderkey"]))
    assert pushed in plan.split("PushedFilters:")[1]
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_whole_number_and_text_filters_reach_the_scan(lineitem):
    conds = [{"column": "l_linenumber", "operator": "gte", "value": "2.5"}, {"column": "l_returnflag", "operator": "eq", "value": "R"}]
    pushed = _plan(tl.filter_rows(lineitem, conds)).split("PushedFilters:")[1]
    assert "GreaterThanOrEqual(l_linenumber,3)" in pushed and "EqualTo(l_returnflag,R)" in pushed


def test_recipe_is_one_scan(lineitem):
    steps = [{"op": "columns", "keep": ["l_orderkey", "l_tax", "l_returnflag"]},
             {"op": "filter", "conditions": [{"column": "l_tax", "operator": "gt", "value": "0.05"}]},
             {"op": "value_counts", "column": "l_returnflag"}]
    plan = _plan(tl.run_recipe(lineitem, steps))
    assert plan.count("FileScan") == 1 and "GreaterThan(l_tax,0.05)" in plan
    assert "ReadSchema: struct<l_tax:double,l_returnflag:string>" in plan


@pytest.mark.parametrize("keep", ["first", "last"])
def test_dedup_limits_each_key_before_the_shuffle(lineitem, keep):
    plan = _plan(tl.dedup(lineitem, ["l_returnflag"], keep, order_by=["l_orderkey", "l_linenumber"]))
    assert re.search(r"WindowGroupLimit.*Final.*Exchange hashpartitioning.*WindowGroupLimit.*Partial", plan, re.S)


def test_pivot_totals_reuse_the_cells(lineitem):
    plan = _plan(tl.pivot_long(lineitem, "l_returnflag", "l_linestatus", "l_quantity", "avg"), run=True)
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") == 3


def test_no_python_no_cross_join(lineitem):
    frames = [
        tl.outliers(lineitem), tl.outlier_rows(lineitem), tl.share_table(lineitem, "l_tax"), tl.bars(lineitem, "l_tax"),
        tl.with_row_index(lineitem), tl.removed_rows(lineitem, ["l_suppkey"]), tl.profile(lineitem),
        tl.attach_banner(tl.split_sections(tl.with_row_index(lineitem), 2), "l_tax"),
        tl.column_ops(lineitem, calc=[{"name": "x", "expression": "{l_tax} // 2 + ({l_quantity} % 3) ** 2"}]),
    ]
    for df in frames:
        plan = _plan(df)
        assert not re.search("Python|Cartesian|NestedLoop", plan)


def test_quartiles_shuffle_only_counts(lineitem):
    plan = _plan(tl.quartiles(lineitem, ["l_extendedprice", "l_tax"]), run=True)
    # One scan makes the histogram, whose lines serve all levels; the sketch is a subquery with the other.
    assert plan.count("FileScan") == 1 and plan.count("Subquery") > 0
    assert "partial_count" in plan.split("FileScan")[0].rsplit("Exchange hashpartitioning", 1)[1]


def test_quartiles_of_all_columns_scan_once_without_a_row_array(lineitem):
    """The bounds and the histogram are a scan each, however many columns and levels there are."""
    for df in (tl.quartiles(lineitem), tl.outlier_bounds(lineitem, multiplier=2.0)):
        plan = _plan(df, run=True)
        assert plan.count("FileScan") == 1
        assert "Generate" not in plan and "Expand" in plan
    whole = tl.outliers(lineitem, multiplier=0.25)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(array(named_struct(at" not in whole and "percentile_approx" not in whole


def test_row_numbers_do_not_move_rows(lineitem):
    plan = _plan(tl.with_row_index(lineitem))
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1


def test_formula_helpers_are_not_repeated(lineitem):
    text = "(({l_tax} % 3) // 2 % 5) // 7 % 2"
    plan = _plan(tl.column_ops(lineitem, keep=[], calc=[{"name": "x", "expression": text}]))
    assert len(plan) < 20_000


def test_split_is_rebalanced(lineitem):
    spread = lineitem.hint("rebalance", F.col("l_returnflag"))
    assert "REBALANCE_PARTITIONS_BY_COL" in _plan(spread)
