"""Data-quality checks."""

from __future__ import annotations

import tabloom as tl
from registry.common import MESSY_SQL, blank_sql, messy, num_sql, refused, round_sql, table, text_sql
from tabloom.operators import validate

_CELLS = ("p_partkey", "p_type", "p_size", "p_retailprice", "cell")
_FACTS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


def _quality(spark, sf_dir):
    """Columns with duplicates, empty cells, mixed kinds and outliers at once."""
    return messy(spark, sf_dir).select("p_type", "p_size", "cell")


def _l9_no_rows(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return refused(orders, lambda: tl.report(orders.where("o_orderkey IS NULL"), _CHECKS))


_CHECKS = {"empty": True, "empty_threshold": 10, "outliers": True, "outlier_multiplier": 0.25,
           "type_check": True, "duplicates": True}

QUERIES = {
    "L1_empty": lambda s, d: validate.profile(messy(s, d)).select("column", "total", "empty"),
    "L2_rate": lambda s, d: tl.empty_rates(messy(s, d), 10),
    "L3_quartiles": lambda s, d: tl.quartiles(_lineitem(s, d)),
    "L3_quartiles_events": lambda s, d: tl.quartiles(table(s, d, "events"), ["value"]),
    "L3_quartiles_text": lambda s, d: tl.quartiles(messy(s, d), ["cell"]),
    "L4_bounds": lambda s, d: tl.outlier_bounds(_lineitem(s, d), multiplier=2.0),
    "L5_outliers": lambda s, d: tl.outliers(table(s, d, "events")),
    "L5_outliers_lineitem": lambda s, d: tl.outliers(_lineitem(s, d), multiplier=0.25),
    "L6_types": lambda s, d: tl.type_kinds(messy(s, d)),
    "L7_dups": lambda s, d: tl.duplicate_rows(table(s, d, "orders").select("o_custkey", "o_orderstatus")),
    "L7_dups_empty_cells": lambda s, d: tl.duplicate_rows(messy(s, d).select("p_type", "cell"), empty_as="None"),
    "L7_dups_whole_rows": lambda s, d: tl.duplicate_rows(_lineitem(s, d)),
    "L8_report": lambda s, d: tl.report(_quality(s, d), _CHECKS),
    "L8_issues": lambda s, d: tl.issues(tl.report(_quality(s, d), _CHECKS)),
    "L9_no_rows": _l9_no_rows,
    "L10_outlier_rows": lambda s, d: tl.outlier_rows(table(s, d, "events"), ["value", "user_id"]),
}


def _profile_sql(columns: tuple[str, ...]) -> str:
    parts = []
    for c in columns:
        if c == "cell":
            blank, number = blank_sql(c), f"{num_sql(c)} IS NOT NULL"
        elif c == "p_type":
            blank, number = f"{c} IS NULL", "false"
        else:
            blank, number = f"{c} IS NULL", "true"
        parts.append(f"""SELECT '{c}' AS "column", count(*) AS total, count(*) FILTER ({blank}) AS empty,
            count(*) FILTER (NOT {blank} AND {number}) AS numbers,
            count(*) FILTER (NOT {blank} AND NOT ({number})) AS texts FROM {MESSY_SQL}""")
    return "(" + " UNION ALL ".join(parts) + ")"


def _long_sql(columns: tuple[str, ...], source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {num_sql(c) if c == 'cell' else f'cast({c} AS double)'} AS v FROM {source}"""
        for c in columns)


def _quartiles_sql(columns: tuple[str, ...], source: str) -> str:
    return f"""(SELECT "column", n, max(v) FILTER (r = n // 4) AS q1, max(v) FILTER (r = (3 * n) // 4) AS q3
        FROM (SELECT "column", v, row_number() OVER (PARTITION BY "column" ORDER BY v) - 1 AS r,
                     count(*) OVER (PARTITION BY "column") AS n
              FROM ({_long_sql(columns, source)}) WHERE v IS NOT NULL)
        WHERE n >= 4 GROUP BY "column", n)"""


def _bounds_sql(columns: tuple[str, ...], source: str, m: float) -> str:
    return f"""(SELECT *, q1 - {m}::double * (q3 - q1) AS lower, q3 + {m}::double * (q3 - q1) AS upper
        FROM {_quartiles_sql(columns, source)} WHERE q3 <> q1)"""


def _outliers_sql(columns: tuple[str, ...], source: str, m: float) -> str:
    return f"""(SELECT b."column", count(*) FILTER (v < lower OR v > upper) AS outliers,
        {round_sql('lower')} AS lower, {round_sql('upper')} AS upper
        FROM {_bounds_sql(columns, source, m)} b JOIN ({_long_sql(columns, source)}) x ON x."column" = b."column"
        GROUP BY b."column", lower, upper)"""


_PCT = round_sql("empty::double / total::double * 100.0", 1)
_KINDS = """concat_ws(',', CASE WHEN empty > 0 THEN 'empty' END, CASE WHEN numbers > 0 THEN 'number' END,
    CASE WHEN texts > 0 THEN 'string' END)"""
_KIND_COUNT = "((empty > 0)::int + (numbers > 0)::int + (texts > 0)::int)"
_QUALITY = ("p_type", "p_size", "cell")
_REPORT = f"""
    SELECT 'empty' AS "check", "column", 'empty_pct' AS metric, {_PCT} AS value,
        concat_ws('/', empty, total) AS detail, {_PCT} < 10 AS passed FROM {_profile_sql(_QUALITY)}
    UNION ALL SELECT 'type_check', "column", 'kinds', {_KIND_COUNT}, {_KINDS}, {_KIND_COUNT} <= 1
        FROM {_profile_sql(_QUALITY)}
    UNION ALL SELECT 'outliers', "column", 'outliers', outliers,
        '[' || {text_sql('lower')} || ', ' || {text_sql('upper')} || ']', outliers = 0
        FROM {_outliers_sql(('p_size', 'cell'), MESSY_SQL, 0.25)}
    UNION ALL SELECT 'duplicates', NULL, 'duplicate_rows', count(*) - count(DISTINCT (p_type, p_size, cell)), NULL,
        count(*) = count(DISTINCT (p_type, p_size, cell)) FROM {MESSY_SQL}"""

ORACLES = {
    "L1_empty": f'SELECT "column", total, empty FROM {_profile_sql(_CELLS)}',
    "L2_rate": f'SELECT "column", total, empty, {_PCT} AS empty_pct, {_PCT} >= 10 AS flagged FROM {_profile_sql(_CELLS)}',
    "L3_quartiles": f"SELECT * FROM {_quartiles_sql(_FACTS, 'lineitem')}",
    "L3_quartiles_events": f"SELECT * FROM {_quartiles_sql(('value',), 'events')}",
    "L3_quartiles_text": f"SELECT * FROM {_quartiles_sql(('cell',), MESSY_SQL)}",
    "L4_bounds": f"SELECT * FROM {_bounds_sql(_FACTS, 'lineitem', 2.0)}",
    "L5_outliers": f"SELECT * FROM {_outliers_sql(('event_id', 'user_id', 'value'), 'events', 1.5)}",
    "L5_outliers_lineitem": f"SELECT * FROM {_outliers_sql(_FACTS, 'lineitem', 0.25)}",
    "L6_types": f'SELECT "column", {_KINDS} AS kinds, {_KIND_COUNT} > 1 AS mixed FROM {_profile_sql(_CELLS)}',
    "L7_dups": """SELECT count(*) AS total, count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS duplicates
        FROM orders""",
    "L7_dups_empty_cells": f"""SELECT count(*) AS total,
        count(*) - count(DISTINCT (p_type, coalesce(cell, 'None'))) AS duplicates FROM {MESSY_SQL}""",
    "L7_dups_whole_rows": """SELECT (SELECT count(*) FROM lineitem) AS total,
        (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicates""",
    "L8_report": _REPORT,
    "L8_issues": f"SELECT * FROM ({_REPORT}) WHERE NOT passed",
    "L9_no_rows": "SELECT count(*) AS rows, 'the table has no rows' AS error FROM orders",
    "L10_outlier_rows": f"""SELECT e.*, 'value' AS outlier_columns FROM events e,
        {_bounds_sql(('value',), 'events', 1.5)} b WHERE e.value < lower OR e.value > upper""",
}
