"""Scans, sinks, conversion and split outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, functions as F

import tabloom as tl
from registry.common import table, text_sql
from tabloom.functions.names import safe_file_name, safe_table_name
from tabloom.storage import scratch_dir

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def _s2_header(spark, sf_dir):
    return tl.renamed(table(spark, sf_dir, "supplier"), ["id", None, "id", "balance"])


def _customer_lines(spark, sf_dir):
    """Customer rows as text lines below two title lines and a header."""
    customer = table(spark, sf_dir, "customer")
    lines = customer.select(
        F.col("c_custkey").alias("at"),
        F.concat_ws(",", "c_custkey", F.concat(F.lit('"'), "c_name", F.lit('"')), F.lit(""), "c_mktsegment").alias("value"))
    top = spark.createDataFrame(
        [(-3, "Customer report"), (-2, ""), (-1, "key,name,,key")], "at bigint, value string")
    return top.unionByName(lines).orderBy("at").select("value")


def _s3_banner(spark, sf_dir):
    path = scratch_dir(spark)
    _customer_lines(spark, sf_dir).write.text(path)
    return tl.scan_with_banner(spark, path, header_row=3)[1]


def _s3_lead(spark, sf_dir):
    path = scratch_dir(spark)
    _customer_lines(spark, sf_dir).write.text(path)
    return tl.scan_with_banner(spark, path, header_row=3)[0]


def _s3_banner_quoted(spark, sf_dir):
    """Conversations below a banner, with their line breaks inside quoted cells."""
    path = scratch_dir(spark)
    quoted = F.concat(F.lit('"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat_ws(",", "conv_id", "turn", "role", quoted).alias("value"))
    top = spark.createDataFrame(
        [(-3, 0, "Conversations"), (-2, 0, ""), (-1, 0, "conv,turn,role,text")], "conv_id bigint, turn bigint, value string")
    top.unionByName(lines).orderBy("conv_id", "turn").select("value").write.text(path)
    return tl.scan_with_banner(spark, path, header_row=3)[1]


def _s4_tables(spark, sf_dir):
    names = [r["table_name"] for r in tl.list_tables(spark, sf_dir).collect()]
    counted = [table(spark, sf_dir, n).agg(F.lit(n).alias("table_name"), F.count("*").alias("rows")) for n in names]
    return reduce(DataFrame.unionByName, counted)


def _roundtrip(name):
    def query(spark, sf_dir):
        path = scratch_dir(spark)
        tl.write_csv(table(spark, sf_dir, name), path)
        return tl.read_csv(spark, path)
    return query


def _s6_lines(spark, sf_dir):
    path = scratch_dir(spark)
    tl.write_csv(table(spark, sf_dir, "customer").withColumn("note", F.lit(None).cast("string")), path, header=False)
    return spark.read.text(path)


def _s7_convert(spark, sf_dir):
    paths = [f"{sf_dir}/{n}.parquet" for n in ("orders", "no_such_table", "customer", "embeddings")]
    done = tl.convert_many(spark, paths, "parquet", "csv", scratch_dir(spark))
    name = F.element_at(F.split("input", "/"), -1)
    return done.select(name.alias("input"), "ok", "rows")


def _s7_formats(spark, sf_dir):
    """Parquet to ORC to JSON to CSV, read back."""
    base, path, source = scratch_dir(spark), f"{sf_dir}/part.parquet", "parquet"
    for target in ("orc", "json", "csv"):
        tl.convert_many(spark, [path], source, target, base)
        path, source = f"{base}/part.{target}", target
    return tl.scan(spark, path, "csv").select("p_partkey", "p_name", "p_size", "p_retailprice")


def _s7_same_names(spark, sf_dir):
    """Two inputs of one name: each has an output and a row count of its own."""
    base = scratch_dir(spark)
    for folder, name in (("x", "customer"), ("y", "supplier")):
        table(spark, sf_dir, name).write.parquet(f"{base}/{folder}/t.parquet")
    done = tl.convert_many(spark, [f"{base}/x/t.parquet", f"{base}/y/t.parquet"], "parquet", "orc", f"{base}/out").collect()
    counted = [(r.output.rsplit("/", 1)[-1], r.ok, r.rows, spark.read.orc(r.output).count()) for r in done]
    return spark.createDataFrame(counted, "output string, ok boolean, rows long, read_back long")


def _s8_write_if(spark, sf_dir):
    """A filter with matches and one without: only the first leaves an output."""
    out, orders = scratch_dir(spark), table(spark, sf_dir, "orders")
    lines = []
    for case, least in (("some", "400000"), ("none", "1000000000")):
        found = tl.filter_rows(orders, [{"column": "o_totalprice", "operator": "gt", "value": least}])
        written = tl.write_if(found, lambda df, case=case: df.write.parquet(f"{out}/case={case}"))
        lines.append((case, written))
    rows = spark.read.parquet(out).groupBy("case").agg(F.count("*").alias("rows"))
    return spark.createDataFrame(lines, "case string, written boolean").join(rows, "case", "left")


def _s8_staged(spark, sf_dir):
    """A filter and a dedup kept, a filter without a match and a dedup that removes nothing dropped."""
    out, orders = scratch_dir(spark), table(spark, sf_dir, "orders")
    spark.range(0).write.parquet(out)
    lines = []
    for case, least in (("some", "400000"), ("none", "1000000000")):
        found = tl.filter_rows(orders, [{"column": "o_totalprice", "operator": "gt", "value": least}])
        lines.append((case, tl.write_staged(found, f"{out}/{case}")))
    for key in ("o_custkey", "o_orderkey"):
        seen = Observation()
        kept = tl.keep_first(orders.observe(seen, F.count(F.lit(1)).alias("rows")), [key], order_by=["o_orderkey"])
        removed = lambda n: n["rows"] < n["all"]
        lines.append((key, tl.write_staged(kept, f"{out}/{key}", wanted=removed, watched={"all": seen})))
    return spark.createDataFrame(lines, "case string, rows bigint")


def _s5_quoted_blocks(spark, sf_dir):
    """Texts with line breaks, quotes and commas, in files that are each written by a task of their
    own, from two splits of the input at most, and read in several blocks."""
    path = scratch_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\r", " ").alias("text"), "lang")
    tl.write_csv(docs.coalesce(max(1, (docs.rdd.getNumPartitions() + 1) // 2)), path)
    return tl.read_csv(spark, path, multiLine="blocks")


def _s9_files(spark, sf_dir):
    path = scratch_dir(spark)
    tl.write_split(table(spark, sf_dir, "orders"), "o_orderpriority", path, name_pattern="p_{value}_x")
    return tl.read_split(spark, path)


def _s9_one_file(spark, sf_dir):
    path = scratch_dir(spark)
    tl.write_split(table(spark, sf_dir, "orders"), "o_orderpriority", path, order_by=["o_orderkey"])
    return tl.read_split(spark, path, output="4-NOT SPECIFIED").drop("split_part")


def _s10_sheets(spark, sf_dir):
    path = scratch_dir(spark)
    tl.write_split(table(spark, sf_dir, "part"), "p_brand", path, mode="sheets")
    return tl.read_split(spark, path, mode="sheets")


def _s10_sheet_names(spark, sf_dir):
    path = scratch_dir(spark)
    tl.write_split(table(spark, sf_dir, "lineitem"), "l_quantity", path, mode="sheets")
    return tl.list_tables(spark, path)


def _s11_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", safe_file_name(F.col("url")).alias("file_key"),
                        safe_table_name(F.col("url")).alias("table_key"))


def _s12_no_header(spark, sf_dir):
    path = scratch_dir(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    tl.write_split(orders, "o_orderstatus", path, format="csv", keep_header=False)
    return spark.read.text(path)


QUERIES = {
    "S1_scan": lambda s, d: tl.scan(s, f"{d}/orders.parquet"),
    "S2_header": _s2_header, "S3_banner": _s3_banner, "S3_lead": _s3_lead, "S3_banner_quoted": _s3_banner_quoted,
    "S4_tables": _s4_tables,
    "S5_csv_numbers": _roundtrip("customer"), "S5_csv_line_breaks": _roundtrip("conversations"),
    "S6_csv_lines": _s6_lines, "S7_same_names": _s7_same_names, "S7_convert": _s7_convert, "S7_formats": _s7_formats, "S8_write_if": _s8_write_if,
    "S8_staged": _s8_staged, "S5_quoted_blocks": _s5_quoted_blocks,
    "S9_split_files": _s9_files, "S9_split_one": _s9_one_file, "S10_split_sheets": _s10_sheets,
    "S10_sheet_names": _s10_sheet_names, "S11_keys": _s11_keys, "S12_no_header": _s12_no_header,
    "S13_summary": lambda s, d: tl.split_summary(table(s, d, "pages"), "url"),
    "S14_collisions": lambda s, d: tl.split_collisions(table(s, d, "pages"), "url", mode="sheets"),
}

_FILE_KEY = "left(translate(url, '<>:\"/\\|?*', '_________'), 100)"
_SHEET_KEY = "left(translate(url, '[]:*?/\\', '_______'), 31)"

ORACLES = {
    "S1_scan": "SELECT * FROM orders",
    "S2_header": "SELECT s_suppkey AS id, s_name AS Col1, s_nationkey AS id_2, s_acctbal AS balance FROM supplier",
    "S3_banner": """SELECT 3 + row_number() OVER (ORDER BY c_custkey) AS row_no, cast(c_custkey AS varchar) AS key,
        c_name AS name, cast(NULL AS varchar) AS Col2, c_mktsegment AS key_2 FROM customer""",
    "S3_lead": "SELECT 1::bigint AS row_no, 'Customer report' AS value UNION ALL SELECT 2, ''",
    "S3_banner_quoted": """SELECT 3 + row_number() OVER (ORDER BY conv_id, turn) AS row_no, cast(conv_id AS varchar) AS conv,
        cast(turn AS varchar) AS turn, role, nullif(text, '') AS text FROM conversations""",
    "S4_tables": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in TABLES),
    "S5_csv_numbers": f"""SELECT cast(c_custkey AS varchar) AS c_custkey, c_name,
        cast(c_nationkey AS varchar) AS c_nationkey, {text_sql('c_acctbal')} AS c_acctbal, c_mktsegment FROM customer""",
    "S5_csv_line_breaks": """SELECT cast(conv_id AS varchar) AS conv_id, cast(turn AS varchar) AS turn, role, text
        FROM conversations""",
    "S6_csv_lines": f"""SELECT concat_ws(',', c_custkey, c_name, c_nationkey, {text_sql('c_acctbal')}, c_mktsegment, '')
        AS value FROM customer""",
    "S7_convert": """SELECT 'orders.parquet' AS input, true AS ok, count(*) AS rows FROM orders
        UNION ALL SELECT 'no_such_table.parquet', false, NULL
        UNION ALL SELECT 'customer.parquet', true, count(*) FROM customer
        UNION ALL SELECT 'embeddings.parquet', true, count(*) FROM embeddings""",
    "S7_formats": f"""SELECT cast(p_partkey AS varchar) AS p_partkey, p_name, cast(p_size AS varchar) AS p_size,
        {text_sql('p_retailprice')} AS p_retailprice FROM part""",
    "S8_staged": """SELECT 'some' AS "case", count(*) AS rows FROM orders WHERE o_totalprice > 400000
        UNION ALL SELECT 'none', NULL UNION ALL SELECT 'o_custkey', count(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 'o_orderkey', NULL""",
    "S5_quoted_blocks": """SELECT cast(doc_id AS varchar) AS doc_id, nullif(replace(text, chr(13), ' '), '') AS text, lang
        FROM documents""",
    "S8_write_if": """SELECT 'some' AS "case", true AS written, count(*) AS rows FROM orders WHERE o_totalprice > 400000
        UNION ALL SELECT 'none', false, NULL""",
    "S9_split_files": """SELECT *, 'p_' || translate(o_orderpriority, '<>:"/\\|?*', '_________') || '_x' AS split_part
        FROM orders""",
    "S9_split_one": "SELECT * FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'",
    "S10_split_sheets": "SELECT *, p_brand AS split_table FROM part",
    "S10_sheet_names": f"SELECT DISTINCT {text_sql('l_quantity')} AS table_name FROM lineitem",
    "S11_keys": f"SELECT page_id, {_FILE_KEY} AS file_key, {_SHEET_KEY} AS table_key FROM pages",
    "S12_no_header": """SELECT concat_ws(',', o_orderkey, o_orderstatus, o_orderpriority) AS value,
        o_orderstatus AS split_part FROM orders""",
    "S13_summary": f"SELECT url AS value, {_FILE_KEY} AS output, count(*) AS n FROM pages GROUP BY 1, 2",
    "S14_collisions": f"""SELECT {_SHEET_KEY} AS output, count(DISTINCT url) AS keys, count(*) AS n FROM pages
        GROUP BY 1 HAVING count(DISTINCT url) > 1""",
    "S7_same_names": """SELECT 't.orc' AS output, true AS ok, count(*) AS rows, count(*) AS read_back FROM customer
        UNION ALL SELECT 't_2.orc', true, count(*), count(*) FROM supplier""",
}
