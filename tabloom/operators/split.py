"""Split a table into one output per value of a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.errors import MissingColumn
from tabloom.functions.cells import EMPTY_LABEL, group_text, ref
from tabloom.functions.names import safe_file_name, safe_table_name
from tabloom.operators.distribution import value_counts
from tabloom.operators.rows import with_address
from tabloom.sources.tables import _CSV_WRITE, as_cells

FILES, SHEETS = "files", "sheets"
# Name of the partition column, which is the output's folder name.
_FOLDER = {FILES: "split_part", SHEETS: "split_table"}


def output_name(key: Column, mode: str = FILES, name_pattern: str = "{value}") -> Column:
    """Name of a key's output: cleaned, cut, then put into the pattern.

    A key that is cleaned away altogether is named ``_``.
    """
    if mode == SHEETS:
        name = safe_table_name(key)
        return F.when(name == "", F.lit("_")).otherwise(name)
    before, _, after = name_pattern.partition("{value}")
    name = F.concat(F.lit(before), safe_file_name(key), F.lit(after))
    return F.when(name == "", F.lit("_")).otherwise(name)


def with_output(
    df: DataFrame, column: str, mode: str = FILES, name_pattern: str = "{value}", label: str = EMPTY_LABEL
) -> DataFrame:
    """Add the name of the output each row goes to; the key column itself stays."""
    return df.withColumn(_FOLDER[mode], output_name(group_text(df, column, label), mode, name_pattern))


def split_summary(
    df: DataFrame, column: str, mode: str = FILES, name_pattern: str = "{value}", label: str = EMPTY_LABEL
) -> DataFrame:
    """``(value, output, n)``: what a split makes of each key."""
    sizes = value_counts(df, column, label)
    return sizes.select("value", output_name(ref("value"), mode, name_pattern).alias("output"), "n")


def split_collisions(
    df: DataFrame, column: str, mode: str = FILES, name_pattern: str = "{value}", label: str = EMPTY_LABEL
) -> DataFrame:
    """``(output, keys, n)`` for outputs that hold more than one key."""
    summary = split_summary(df, column, mode, name_pattern, label)
    return (
        summary.groupBy("output").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"))
        .where("keys > 1")
    )


def write_split(
    df: DataFrame, column: str, path: str, mode: str = FILES, name_pattern: str = "{value}",
    format: str = "parquet", keep_header: bool = True, order_by: Sequence[str] | None = None,
    label: str = EMPTY_LABEL,
) -> None:
    """Write one folder of files per key; keys with the same cleaned name share it.

    Rows are dealt by ranges of output and source order: small outputs share a task, an
    output that holds a large share of the rows is spread over several, and its files in the
    order of their names hold its rows in source order. Each CSV file has the header line.
    """
    tagged, folder = with_output(df, column, mode, name_pattern, label), _FOLDER[mode]
    if order_by is None:
        placed, order = with_address(df, "_at")
        placed = with_output(placed, column, mode, name_pattern, label)
    else:
        placed, order = tagged, list(order_by)
    places = [ref(folder), *[ref(c) for c in order]]
    spread = placed.repartitionByRange(*places).sortWithinPartitions(*places)
    kept = spread.select(*[ref(c) for c in df.columns], ref(folder))
    writer = (as_cells(kept) if format == "csv" else kept).write.partitionBy(folder).format(format)
    if format == "csv":
        writer = writer.options(header=str(keep_header).lower(), **_CSV_WRITE)
    writer.save(path)


def write_banner_split(
    banner: DataFrame, path: str, mode: str = FILES, name_pattern: str = "{value}"
) -> None:
    """Write outputs that carry lead, header and tail rows (see ``rows.attach_banner``).

    The files of an output, in the order of their names, are its lines in order, however many
    there are: lead rows, one header, data rows, tail rows.
    """
    folder = _FOLDER[mode]
    cells = [c for c in banner.columns if c not in ("split_key", "place", "row_no")]
    named = banner.withColumn(folder, output_name(ref("split_key"), mode, name_pattern))
    places = [folder, "split_key", "place", "row_no"]
    spread = named.repartitionByRange(*places).sortWithinPartitions(*places)
    out = as_cells(spread.select(*[ref(c) for c in cells], ref(folder)))
    out.write.partitionBy(folder).options(header="false", **_CSV_WRITE).csv(path)


def read_split(
    spark: SparkSession, path: str, mode: str = FILES, format: str = "parquet", output: str | None = None,
    **options,
) -> DataFrame:
    """Read outputs back (one of them, if named); output names stay text."""
    folder = _FOLDER[mode]
    schema = spark.read.format(format).options(**options).load(path).schema
    if folder not in schema.fieldNames():
        raise MissingColumn(folder)
    fields = [T.StructField(f.name, T.StringType()) if f.name == folder else f for f in schema]
    df = spark.read.format(format).options(**options).schema(T.StructType(fields)).load(path)
    return df if output is None else df.where(ref(folder) == output)
