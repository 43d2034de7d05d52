"""Value distributions and grouped rows."""

from __future__ import annotations

import tabloom as tl
from registry.common import MESSY_SQL, grown, in_order, messy, table

_PRIORITY = "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1"

QUERIES = {
    "G1_counts": lambda s, d: tl.value_counts(messy(s, d), "cell"),
    "G1_counts_dates": lambda s, d: tl.value_counts(table(s, d, "orders"), "o_orderdate"),
    "G1_grown": lambda s, d: grown(s, d, "orders", "o_orderstatus", ["o_orderpriority"]).value_counts("o_orderpriority"),
    "G2_share": lambda s, d: tl.share_table(table(s, d, "orders"), "o_orderpriority"),
    "G2_order": lambda s, d: in_order(tl.share_table(table(s, d, "events"), "event_type")),
    "G3_bar": lambda s, d: tl.bars(messy(s, d), "cell"),
    "G4_totals": lambda s, d: tl.distribution_totals(messy(s, d), "cell"),
    "G5_search": lambda s, d: tl.search_values(tl.value_counts(table(s, d, "orders"), "o_orderpriority"), "-N"),
    "G6_group_order": lambda s, d: tl.group_order(table(s, d, "orders"), "o_orderpriority"),
    "G6_grouped_rows": lambda s, d: tl.with_group(messy(s, d), "cell", "bucket"),
}

ORACLES = {
    "G1_counts": f"SELECT coalesce(cell, '(空)') AS value, count(*) AS n FROM {MESSY_SQL} GROUP BY 1",
    "G1_counts_dates": "SELECT strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS value, count(*) AS n FROM orders GROUP BY 1",
    "G1_grown": _PRIORITY,
    "G2_share": f"""SELECT value, n, printf('%.1f%%', n::double / sum(n) OVER ()::double * 100.0) AS share
        FROM ({_PRIORITY})""",
    "G2_order": """SELECT value, n, printf('%.1f%%', n::double / sum(n) OVER ()::double * 100.0) AS share,
        (row_number() OVER (ORDER BY n DESC, value))::int AS line_no
        FROM (SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1)""",
    "G3_bar": f"""SELECT value, n, repeat('█', floor(n::double / (max(n) OVER ())::double * 12.0)::int) AS bar
        FROM (SELECT coalesce(cell, '(空)') AS value, count(*) AS n FROM {MESSY_SQL} GROUP BY 1)""",
    "G4_totals": f"""SELECT count(DISTINCT coalesce(cell, '(空)')) AS distinct_values, count(*) AS total_rows
        FROM {MESSY_SQL}""",
    "G5_search": f"SELECT * FROM ({_PRIORITY}) WHERE contains(value, '-N')",
    "G6_group_order": """SELECT o_orderpriority AS value, count(*) AS n, min(r) AS first_row
        FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1""",
    "G6_grouped_rows": f"SELECT *, coalesce(cell, '(空)') AS bucket FROM {MESSY_SQL}",
}
