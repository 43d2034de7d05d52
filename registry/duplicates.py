"""Duplicate removal."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabloom as tl
from registry.common import grown, table
from tabloom.storage import scratch_dir

KEYS = ["user_id", "event_type"]
ORDER = ["event_id"]


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def _d2_last(spark, sf_dir):
    kept = tl.keep_last(_events(spark, sf_dir), KEYS, ORDER, position="first")
    return kept.select("*", F.col("first.event_id").alias("first_event")).drop("first")


def _d3_keys(spark, sf_dir):
    return tl.keep_first(table(spark, sf_dir, "documents"), ["text", "no such column"], ["doc_id"])


def _d3_all_columns(spark, sf_dir):
    return tl.keep_first(table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority"))


def _halves(spark, sf_dir):
    """Two folders of events, the later ids first, merged with addresses."""
    events = _events(spark, sf_dir)
    first, second = scratch_dir(spark), scratch_dir(spark)
    for path, part in ((first, events.where("event_id % 2 = 1")), (second, events.where("event_id % 2 = 0"))):
        part.repartitionByRange("event_id").sortWithinPartitions("event_id").write.parquet(path)
    return tl.merge_paths(spark, [first, second], address="at")


def _d6_exploded(spark, sf_dir):
    twice = _events(spark, sf_dir).select("event_id", *KEYS, F.posexplode(F.array(F.lit("a"), F.lit("a"))).alias("pos", "copy"))
    return tl.removed_rows(twice, [*KEYS, "copy"], order_by=["event_id", "pos"])


QUERIES = {
    "D1_first": lambda s, d: tl.keep_first(_events(s, d), KEYS, ORDER),
    "D1_first_scan_order": lambda s, d: tl.keep_first(_events(s, d), KEYS),
    "D1_first_hot_key": lambda s, d: tl.keep_first(table(s, d, "orders"), ["o_orderstatus"], ["o_orderkey"]),
    "D1_first_merged": lambda s, d: tl.keep_first(_halves(s, d), KEYS, ["at"]).drop("at"),
    "D2_last_merged": lambda s, d: tl.keep_last(_halves(s, d), KEYS, ["at"]).drop("at"),
    "D6_removed_exploded": _d6_exploded,
    "D2_last": _d2_last,
    "D2_last_scan_order": lambda s, d: tl.dedup(_events(s, d), KEYS, keep="last"),
    "D3_keys": _d3_keys,
    "D3_all_columns": _d3_all_columns,
    "D4_counts": lambda s, d: tl.dedup_counts(_events(s, d), KEYS),
    "D5_grown": lambda s, d: grown(s, d, "orders", "o_orderstatus", ["o_custkey", "o_orderpriority"]).duplicate_groups(),
    "D5_groups": lambda s, d: tl.duplicate_groups(table(s, d, "orders"), ["o_custkey", "o_orderpriority"]),
    "D6_removed": lambda s, d: tl.removed_rows(_events(s, d), KEYS, "first", ORDER),
    "D6_removed_last": lambda s, d: tl.removed_rows(_events(s, d), KEYS, "last"),
}


def _ranked(direction: str, test: str) -> str:
    return f"""SELECT event_id, ts, user_id, event_type, value, props FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id, event_type ORDER BY event_id {direction}) AS rn FROM events) WHERE rn {test}"""


ORACLES = {
    "D1_first": _ranked("", "= 1"),
    "D1_first_scan_order": _ranked("", "= 1"),
    "D1_first_hot_key": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
        (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""",
    "D2_last": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
        (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn,
        min(event_id) OVER (PARTITION BY user_id, event_type) AS first_event FROM events) WHERE rn = 1""",
    "D2_last_scan_order": _ranked("DESC", "= 1"),
    "D3_keys": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER
        (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1""",
    "D3_all_columns": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "D4_counts": """SELECT count(*) AS total, count(DISTINCT (user_id, event_type)) AS kept,
        count(*) - count(DISTINCT (user_id, event_type)) AS removed FROM events""",
    "D5_grown": """SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders
        GROUP BY ALL HAVING count(*) > 1""",
    "D5_groups": """SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders
        GROUP BY ALL HAVING count(*) > 1""",
    "D6_removed": _ranked("", "> 1"),
    "D6_removed_last": _ranked("DESC", "> 1"),
    "D1_first_merged": """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
        ORDER BY event_id % 2 = 0, event_id) AS rn FROM events) WHERE rn = 1""",
    "D2_last_merged": """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type
        ORDER BY event_id % 2 = 0 DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "D6_removed_exploded": """SELECT event_id, user_id, event_type, CAST(pos AS INTEGER) AS pos, 'a' AS copy FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id, pos) AS rn
        FROM events, (SELECT unnest([0, 1]) AS pos)) WHERE rn > 1""",
}
