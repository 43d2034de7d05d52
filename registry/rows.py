"""Row numbers, ranges, sections and banners."""

from __future__ import annotations

from pyspark.sql import functions as F

import tabloom as tl
from registry.common import refused, table
from tabloom.operators.split import write_banner_split
from tabloom.storage import scratch_dir


def _numbered(name):
    return lambda s, d: tl.with_row_index(table(s, d, name))


def _sections(spark, sf_dir, tail, include_lead=True):
    numbered = tl.with_row_index(table(spark, sf_dir, "events").select("event_id", "event_type", "value"))
    return tl.split_sections(numbered, header_row=3, tail=tail, include_lead=include_lead)


def _x1_many_files(spark, sf_dir):
    """Numbering over files that Spark packs into tasks by size, not by name."""
    path = scratch_dir(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    orders.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").write.parquet(path)
    return tl.with_row_index(spark.read.parquet(path))


def _x1_text_files(spark, sf_dir):
    path = scratch_dir(spark)
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.concat_ws(",", "o_orderkey", "o_orderstatus").alias("v"))
    lines.repartitionByRange("o_orderkey").sortWithinPartitions("o_orderkey").select("v").write.text(path)
    return tl.with_row_index(spark.read.text(path))


def _ordered_folder(spark, frame, key):
    """A folder whose files, in the order of their names, rise by the key, and grow in size."""
    path = scratch_dir(spark)
    frame.repartitionByRange(key).sortWithinPartitions(key).write.parquet(path)
    return spark.read.parquet(path)


def _part_numbers(spark, frame, key, first):
    """A folder whose files rise by the key and are named part-{number}, from the first number on."""
    written, path = scratch_dir(spark), scratch_dir(spark)
    frame.repartitionByRange(4, key).sortWithinPartitions(key).write.parquet(written)
    place = spark._jvm.org.apache.hadoop.fs.Path
    system = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(place(path))
    names = sorted(f.getPath().getName() for f in system.listStatus(place(written)) if f.getPath().getName().startswith("part-"))
    for k, name in enumerate(names):
        system.rename(place(f"{written}/{name}"), place(f"{path}/part-{first + k}.parquet"))
    return path


def _x1_part_numbers(spark, sf_dir):
    """File names whose numbers have five and six digits: part-99999 comes before part-100000."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return tl.with_row_index(spark.read.parquet(_part_numbers(spark, orders, "o_orderkey", 99_998)))


def _x1_merged(spark, sf_dir):
    """Numbers over a merge of two folders, whose files Spark packs by size."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    low = _ordered_folder(spark, orders.where("o_orderkey % 3 = 0"), "o_orderkey")
    high = _ordered_folder(spark, orders.where("o_orderkey % 3 > 0"), "o_orderkey")
    merged = tl.merge_by_position([high, low], address="at")
    return tl.with_row_index(merged, address="at").drop("at")


def _x2_range_files(spark, sf_dir):
    """A range over many files, of which only those that hold it are read."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return tl.source_range(_ordered_folder(spark, orders, "o_orderkey"), 100, 1400)


def _x1_filtered(spark, sf_dir):
    """A filtered scan has no physical numbers: refused, with the reason as the row."""
    orders = table(spark, sf_dir, "orders")
    return refused(orders, lambda: tl.with_row_index(orders.where("o_orderkey > 10")))


def _x5_written_order(spark, sf_dir):
    """Lines of one output with their place over all of its files, read in name order."""
    path = scratch_dir(spark)
    write_banner_split(_x5_banner(spark, sf_dir), path)
    key = table(spark, sf_dir, "events").agg(F.min("event_type").alias("k")).first().k
    return tl.with_row_index(spark.read.text(f"{path}/split_part={key}"), "line_no")


def _x5_banner(spark, sf_dir):
    return tl.attach_banner(_sections(spark, sf_dir, (901, 903)), "event_type")


def _x5_no_header(spark, sf_dir):
    sections = _sections(spark, sf_dir, None, include_lead=False)
    return tl.attach_banner(sections, "event_type", keep_header=False)


def _x5_written(spark, sf_dir):
    path = scratch_dir(spark)
    write_banner_split(_x5_banner(spark, sf_dir), path)
    return spark.read.text(path)


QUERIES = {
    "X1_row_index": _numbered("events"),
    "X1_many_files": _x1_many_files,
    "X1_text_files": _x1_text_files,
    "X1_merged": _x1_merged,
    "X1_part_numbers": _x1_part_numbers,
    "X1_filtered": _x1_filtered,
    "X2_range": lambda s, d: tl.row_range(_numbered("orders")(s, d), 100, 1400),
    "X2_range_files": _x2_range_files,
    "X2_range_beyond": lambda s, d: tl.row_range(_numbered("orders")(s, d), 1, 100_000_000),
    "X3_preview": lambda s, d: tl.row_range_preview(_numbered("orders")(s, d), 2, 5),
    "X4_sections": lambda s, d: _sections(s, d, (901, 950)),
    "X4_tail_beyond": lambda s, d: _sections(s, d, (950, 100_000_000)),
    "X5_banner": _x5_banner,
    "X5_no_header": _x5_no_header,
    "X5_written": _x5_written,
    "X5_written_order": _x5_written_order,
}

_EVENTS = "(SELECT event_id, event_type, value, row_number() OVER (ORDER BY event_id) AS row_no FROM events)"


def _sections_sql(tail: tuple[int, int]) -> str:
    return f"""(SELECT *, CASE WHEN row_no < 3 THEN 'lead' WHEN row_no = 3 THEN 'header'
        WHEN row_no BETWEEN {tail[0]} AND {tail[1]} THEN 'tail' ELSE 'data' END AS section FROM {_EVENTS}
        WHERE NOT (row_no BETWEEN {tail[0]} AND {tail[1]}) OR (SELECT count(*) FROM events) >= {tail[1]})"""


_BANNER = f"""SELECT event_type AS split_key, 2 AS place, row_no, event_id, event_type, value
    FROM {_sections_sql((901, 903))} WHERE section = 'data'
    UNION ALL SELECT k.event_type, CASE section WHEN 'lead' THEN 0 WHEN 'header' THEN 1 ELSE 3 END, row_no, event_id,
        s.event_type, value
    FROM {_sections_sql((901, 903))} s, (SELECT DISTINCT event_type FROM {_sections_sql((901, 903))}
        WHERE section = 'data') k WHERE section <> 'data'"""

_ORDERS = "SELECT *, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders"
ORACLES = {
    "X1_row_index": "SELECT *, row_number() OVER (ORDER BY event_id) AS row_no FROM events",
    "X1_many_files": "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders",
    "X1_text_files": """SELECT concat_ws(',', o_orderkey, o_orderstatus) AS value,
        row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders""",
    "X1_part_numbers": "SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders",
    "X1_merged": """SELECT o_orderkey, o_orderpriority,
        row_number() OVER (ORDER BY o_orderkey % 3 = 0, o_orderkey) AS row_no FROM orders""",
    "X1_filtered": "SELECT count(*) AS rows, 'number the rows before they are filtered' AS error FROM orders",
    "X2_range": f"SELECT * FROM ({_ORDERS}) WHERE row_no BETWEEN 100 AND 1400",
    "X2_range_files": f"SELECT o_orderkey, o_orderpriority, row_no FROM ({_ORDERS}) WHERE row_no BETWEEN 100 AND 1400",
    "X2_range_beyond": f"SELECT * FROM ({_ORDERS}) WHERE false",
    "X3_preview": f"""SELECT string_agg('Row' || row_no || ': ' || o_orderkey || ', ' || o_custkey || ', ' || o_orderstatus,
        '; ' ORDER BY row_no) AS preview FROM ({_ORDERS}) WHERE row_no BETWEEN 2 AND 5""",
    "X4_sections": f"SELECT * FROM {_sections_sql((901, 950))}",
    "X4_tail_beyond": f"SELECT * FROM {_sections_sql((950, 100_000_000))}",
    "X5_banner": _BANNER,
    "X5_no_header": f"""SELECT event_type AS split_key, 2 AS place, row_no, event_id, event_type, value
        FROM {_EVENTS} WHERE row_no > 3""",
    "X5_written": f"""SELECT event_id || ',' || event_type || ',' ||
        CASE WHEN value = floor(value) THEN cast(cast(value AS bigint) AS varchar) ELSE cast(value AS varchar) END AS value,
        split_key AS split_part FROM ({_BANNER})""",
    "X5_written_order": f"""SELECT event_id || ',' || event_type || ',' ||
        CASE WHEN value = floor(value) THEN cast(cast(value AS bigint) AS varchar) ELSE cast(value AS varchar) END AS value,
        row_number() OVER (ORDER BY place, row_no) AS line_no
        FROM ({_BANNER}) WHERE split_key = (SELECT min(event_type) FROM events)""",
}
