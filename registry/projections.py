"""Select, reorder, rename, compute."""

from __future__ import annotations

import tabloom as tl
from registry.common import MESSY_SQL, messy, num0_sql, round_sql, table


def _columns(name, **spec):
    def query(spark, sf_dir):
        df = messy(spark, sf_dir) if name == "messy" else table(spark, sf_dir, name)
        return tl.column_ops(df, **spec)
    return query


def _calc(**formulas):
    return [{"name": name, "expression": text} for name, text in formulas.items()]


_N = num0_sql("cell")
QUERIES = {
    "P1_keep": _columns("orders", keep=["o_orderkey", "o_totalprice", "o_orderpriority"]),
    "P2_reorder": _columns("orders", keep=["o_orderkey", "o_custkey", "o_orderstatus"],
                           order=["o_orderstatus", "o_totalprice", "o_orderkey", "o_custkey"]),
    "P3_rename": _columns("orders", keep=["o_orderkey", "o_totalprice"], renames={"o_totalprice": "total"}),
    "P4_missing": _columns("orders", keep=["o_orderkey", "remark"]),
    "P5_calc": _columns("lineitem", keep=["l_orderkey", "l_linenumber"],
                        calc=_calc(revenue="{l_extendedprice} * (1 - {l_discount})",
                                   charge="{l_extendedprice} * (1 - {l_discount}) * (1 + {l_tax})")),
    "P5_calc_operators": _columns("messy", keep=["p_partkey"], calc=_calc(
        parts="{p_size} // 7 + {p_size} % 4", signed="-{p_size} // 4 - (-{p_size} % 3)",
        power="{p_size} ** 2", zero="{p_retailprice} / ({p_size} - 10)",
        choice="{p_size} if {p_size} > 25 else abs(10 - {p_size})", most="max({p_size}, 20) - min({p_size}, 20)",
        both="{p_size} > 10 and {p_size} < 20")),
    "P5_calc_text_cells": _columns("messy", keep=["p_partkey", "cell"], calc=_calc(double="{cell} * 2 + {p_size}")),
    "P6_rounding": _columns("lineitem", keep=["l_orderkey"], calc=_calc(
        third="{l_extendedprice} / 3", tie="{l_quantity} / 8", whole="{l_quantity} * 3")),
    "P7_source_columns": _columns("orders", keep=["o_orderkey"], renames={"o_orderkey": "o_custkey"},
                                  calc=_calc(a="{o_custkey} + 1", o_totalprice="{o_totalprice} - {a}",
                                             b="{o_totalprice} / 2")),
    "P8_bad_formula": _columns("lineitem", keep=["l_orderkey"], calc=_calc(
        unknown="{l_quantity} + remark", syntax="{l_quantity} *", good="{l_quantity} + 1")),
}

ORACLES = {
    "P1_keep": "SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders",
    "P2_reorder": "SELECT o_orderstatus, o_orderkey, o_custkey FROM orders",
    "P3_rename": "SELECT o_orderkey, o_totalprice AS total FROM orders",
    "P4_missing": "SELECT o_orderkey, '' AS remark FROM orders",
    "P5_calc": f"""SELECT l_orderkey, l_linenumber, {round_sql('l_extendedprice * (1 - l_discount)')} AS revenue,
        {round_sql('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} AS charge FROM lineitem""",
    "P5_calc_operators": f"""SELECT p_partkey,
        floor(p_size / 7.0::double) + (p_size % 4) AS parts,
        floor(-p_size / 4.0::double) - CASE WHEN p_size % 3 = 0 THEN 0 ELSE 3 - p_size % 3 END AS signed,
        cast(p_size * p_size AS double) AS power,
        CASE WHEN p_size <> 10 THEN {round_sql('p_retailprice / (p_size - 10)')} END AS zero,
        cast(CASE WHEN p_size > 25 THEN p_size ELSE abs(10 - p_size) END AS double) AS choice,
        cast(abs(p_size - 20) AS double) AS most,
        cast(p_size > 10 AND p_size < 20 AS double) AS both FROM {MESSY_SQL}""",
    "P5_calc_text_cells": f"SELECT p_partkey, cell, {round_sql(f'({_N} * 2 + p_size)')} AS double FROM {MESSY_SQL}",
    "P6_rounding": f"""SELECT l_orderkey, {round_sql('l_extendedprice / 3')} AS third,
        {round_sql('l_quantity / 8')} AS tie, l_quantity * 3 AS whole FROM lineitem""",
    "P7_source_columns": f"""SELECT o_orderkey AS o_custkey, cast(o_custkey + 1 AS double) AS a,
        cast(NULL AS double) AS o_totalprice, {round_sql('o_totalprice / 2')} AS b FROM orders""",
    "P8_bad_formula": """SELECT l_orderkey, cast(NULL AS double) AS unknown, cast(NULL AS double) AS syntax,
        l_quantity + 1 AS good FROM lineitem""",
}
