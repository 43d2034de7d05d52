"""M1-M8: append tables."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabloom as tl
from registry.common import table, text_sql
from tabloom.storage import scratch_dir


def _m1_position(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    return tl.merge_by_position([customer, supplier])


def _m2_tables(spark, sf_dir):
    return tl.merge_tables(spark, sf_dir, ["customer", "supplier"])


def _m3_by_name(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    supplier = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return tl.merge_by_name([customer, supplier])


def _m4_empty_input(spark, sf_dir):
    empty = spark.createDataFrame([], "").select()
    return tl.merge_by_position([empty, table(spark, sf_dir, "nation"), empty, table(spark, sf_dir, "nation")])


def _m5_ragged(spark, sf_dir):
    return tl.merge_by_position([table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")])


def _m6_paths(spark, sf_dir):
    paths = [f"{sf_dir}/{name}.parquet" for name in ("orders", "orders", "customer")]
    return tl.merge_paths(spark, paths, source_no="source_no").groupBy("source_no").agg(F.count("*").alias("n"))


def _m6_request_order(spark, sf_dir):
    """One scan of two folders, asked for in the order that their names do not have; the first row of each key in that order."""
    orders, base = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), scratch_dir(spark)
    for name, part in (("a", "o_orderkey % 2 = 0"), ("b", "o_orderkey % 2 = 1")):
        orders.where(part).repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(f"{base}/{name}")
    merged = tl.merge_paths(spark, [f"{base}/b", f"{base}/a"], same_layout=True)
    return tl.keep_first(merged, ["o_custkey"])


def _m7_mixed_types(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")
    part = table(spark, sf_dir, "part").select("p_size", "p_name", "p_retailprice")
    return tl.merge_by_position([customer, part])


def _m2_split_tables(spark, sf_dir):
    """Tables picked from the outputs of a split by the names that listing them gives."""
    path = scratch_dir(spark)
    tl.write_split(table(spark, sf_dir, "part"), "p_brand", path, mode="sheets")
    names = [r.table_name for r in tl.list_tables(spark, path).collect()][:3]
    return tl.merge_tables(spark, path, names)


def _m7_decimals(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_acctbal").cast("decimal(10,2)").alias("amount"), F.col("c_custkey").alias("key"))
    part = table(spark, sf_dir, "part").select(F.col("p_retailprice").cast("decimal(12,3)"), F.col("p_size").cast("decimal(4,1)"))
    merged = tl.merge_by_position([customer, part])
    return merged.select(F.col("amount").cast("string").alias("amount"), F.col("key").cast("string").alias("key"))


def _m8_summary(spark, sf_dir):
    return tl.merge_summary([table(spark, sf_dir, name) for name in ("orders", "lineitem", "part")])


QUERIES = {
    "M1_position": _m1_position, "M2_tables": _m2_tables, "M3_by_name": _m3_by_name,
    "M4_empty_input": _m4_empty_input, "M5_ragged": _m5_ragged, "M6_paths": _m6_paths,
    "M6_request_order": _m6_request_order,
    "M2_split_tables": _m2_split_tables, "M7_decimals": _m7_decimals,
    "M7_mixed_types": _m7_mixed_types, "M8_summary": _m8_summary,
}

ORACLES = {
    "M1_position": """SELECT c_custkey, c_name, c_acctbal FROM customer
        UNION ALL SELECT s_suppkey, s_name, s_acctbal FROM supplier""",
    "M2_tables": "SELECT * FROM customer UNION ALL SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier",
    "M3_by_name": """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, cast(NULL AS double) AS balance
        FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
    "M4_empty_input": "SELECT * FROM nation UNION ALL SELECT * FROM nation",
    "M5_ragged": """SELECT s_suppkey, s_name, s_nationkey, s_acctbal, cast(NULL AS varchar) AS Col4 FROM supplier
        UNION ALL SELECT * FROM customer""",
    "M6_request_order": """SELECT o_custkey, arg_min(o_orderkey, (o_orderkey % 2 = 0, o_orderkey)) AS o_orderkey
        FROM orders GROUP BY 1""",
    "M6_paths": """SELECT 1 AS source_no, count(*) AS n FROM orders
        UNION ALL SELECT 2, count(*) FROM customer""",
    "M7_mixed_types": f"""SELECT c_custkey AS id, {text_sql('c_acctbal')} AS c_acctbal,
        cast(c_nationkey AS double) AS c_nationkey FROM customer
        UNION ALL SELECT p_size, p_name, p_retailprice FROM part""",
    "M8_summary": """SELECT 3::bigint AS inputs, (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem)
        + (SELECT count(*) FROM part) AS rows""",
    "M2_split_tables": """SELECT * FROM part
        WHERE p_brand IN (SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 3)""",
    "M7_decimals": """SELECT cast(cast(cast(c_acctbal AS decimal(10,2)) AS decimal(13,3)) AS varchar) AS amount,
        cast(cast(c_custkey AS decimal(20,1)) AS varchar) AS key FROM customer
        UNION ALL SELECT cast(cast(p_retailprice AS decimal(12,3)) AS varchar), cast(cast(p_size AS decimal(4,1)) AS varchar) FROM part""",
}
