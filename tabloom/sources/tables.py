"""Table scans, CSV cells, bulk conversion and conditional sinks."""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from tabloom.errors import InsufficientData, TableError
from tabloom.functions.cells import ref, to_text
from tabloom.functions.names import normalise_headers
from tabloom.operators.rows import address_struct, file_order, number_rows, with_row_index
from tabloom.sources.blocks import csv_records, opens

# Quotes inside a cell are doubled; a cell may contain line breaks and keeps its spaces.
_CSV_READ = {
    "quote": '"', "escape": '"', "inferSchema": "false",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8",
}
_CSV_WRITE = {
    "quote": '"', "escape": '"', "emptyValue": "",
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
}


_BYTE_ORDER_MARK = "^\ufeff"


def renamed(df: DataFrame, header_cells: Iterable[object]) -> DataFrame:
    """Give a frame the normalised names of a header row; schema only, no job."""
    return df.toDF(*normalise_headers(header_cells))


def scan(
    spark: SparkSession, path: str | list[str], format: str = "parquet", header: bool = True, **options
) -> DataFrame:
    """Scan one named table: a path, or a catalog table with ``format="table"``.

    CSV cells are always text and their header names are made unique.
    """
    if format == "csv":
        return read_csv(spark, path, header=header, **options)
    if format == "table":
        return spark.read.options(**options).table(path)
    return spark.read.format(format).options(**options).load(path)


def read_csv(
    spark: SparkSession, path: str | list[str], header: bool = True, address: str | None = None, **options
) -> DataFrame:
    """CSV with every cell as text; short rows are padded with empty cells.

    A byte order mark is ignored, and a line end inside a cell is read as \\n. Files are read in
    blocks by many tasks, with ``multiLine="blocks"`` also where cells hold line breaks (see
    :mod:`tabloom.sources.blocks`), with ``"false"`` where none does; ``"true"`` reads a file by
    one task. Without it one job looks for a line that ends inside a cell. Quotes, escapes, line
    ends and encodings of their own are for ``"true"``.

    ``address`` adds a column that is unique per row and sorts like the rows lie, for
    ``order_by`` and ``with_row_index``; rows read in blocks with line breaks have no order
    without it.
    """
    options = dict(options)
    sep = options.get("sep", options.get("delimiter", ","))
    plain = len(sep) == 1 and sep != '"' and not {"quote", "escape", "lineSep", "encoding", "charset", "comment"} & set(options)
    way = options.pop("multiLine", None)
    if way is None:
        way = "true" if not plain else "false" if _open_lines(spark, path, sep).isEmpty() else "blocks"
    if way == "blocks" and not plain:
        raise TableError("CSV with its own quotes, line ends or encoding is not read in blocks")
    reader = spark.read.options(**{**_CSV_READ, **options, "multiLine": str(way != "false").lower()})
    df = reader.csv(path, header=header)
    if not df.columns:
        return df
    cells = [None if c == f"_c{i}" else c for i, c in enumerate(df.columns)]
    if header and _repeats(df.columns):
        cells = list(reader.csv(path, header=False).head())
    # With line breaks in the header's cells the reader may take the line's \r for text.
    names = normalise_headers([c.removesuffix("\r") if isinstance(c, str) else c for c in cells])
    if way != "blocks":
        renamed_ = df.toDF(*names)
        return renamed_ if address is None else renamed_.select("*", address_struct(renamed_, 1).alias(address))
    records = _records(spark, path, header, sep, options)
    folders = records.columns[4:]
    inner = names[:len(names) - len(folders)]
    parsed = F.from_csv("value", _ddl(inner), {**_CSV_READ, **options, "multiLine": "true", "mode": "PERMISSIVE"})
    place = [] if address is None else [_block_address().alias(address)]
    rows = records.select(parsed.alias("_cells"), *[ref(c) for c in folders], *place)
    return rows.select(
        *[F.col("_cells").getField(n).alias(n) for n in inner],
        *[ref(c).alias(n) for c, n in zip(folders, names[len(inner):])], *([] if address is None else [ref(address)]))


def _records(spark: SparkSession, path: str | list[str], header: bool, sep: str, options: dict) -> DataFrame:
    text = spark.read.options(**options).text(path)
    return csv_records(spark, path, header, sep, lambda file: file_order(text, file), options)


def _block_address() -> Column:
    """The place of a record, as the column that merges add."""
    return F.struct(
        F.lit(1).alias("input"), F.lpad(F.col("file_no").cast("string"), 10, "0").alias("file"), ref("block").alias("block"), ref("at").alias("at"))


def _open_lines(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    return spark.read.text(path).where(opens(F.col("value"), sep))


def _repeats(columns: list[str]) -> bool:
    """Whether the reader may have made repeated header names unique, by adding their index."""
    bases = [c.removesuffix(str(i)).lower() for i, c in enumerate(columns) if c.endswith(str(i))]
    return len(set(bases)) < len(bases)


def as_cells(df: DataFrame) -> DataFrame:
    """Every column as its cell text."""
    return df.select(*[to_text(df, c).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "errorifexists", **options) -> None:
    """CSV sink: cell text, empty cells for NULL, comma, quotes only where needed."""
    as_cells(df).write.mode(mode).options(**{**_CSV_WRITE, **options}).csv(path, header=header)


def list_tables(spark: SparkSession, path: str) -> DataFrame:
    """Names of the tables in a dataset folder, sorted: files, folders or ``key=name`` folders."""
    root = path.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select(F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*", "/").alias("path"))
    )
    below = F.substring_index(ref("path"), root + "/", -1)
    first = F.substring_index(below, "/", 1)
    name = F.when(F.contains(first, F.lit("=")), F.regexp_replace(first, "^[^=]*=", ""))
    name = name.otherwise(F.regexp_replace(first, r"\.[A-Za-z0-9]+$", ""))
    return files.select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("table_name")) \
        .distinct().orderBy("table_name")


def table_paths(spark: SparkSession, path: str) -> dict[str, str]:
    """Paths of a dataset folder's tables by the names that :func:`list_tables` gives."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = {}
    for status in hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop):
        entry = status.getPath().getName()
        if not entry.startswith(("_", ".")):
            name = unquote(entry.partition("=")[2]) if "=" in entry else re.sub(r"\.[A-Za-z0-9]+$", "", entry)
            found[name] = status.getPath().toString()
    return found


def list_catalog_tables(spark: SparkSession, database: str) -> DataFrame:
    """Names of the tables in a catalog database, sorted."""
    quoted = "`" + database.replace("`", "``") + "`"
    found = spark.sql(f"SHOW TABLES IN {quoted}").where("not isTemporary")
    return found.select(ref("tableName").alias("table_name")).orderBy("table_name")


def scan_with_banner(
    spark: SparkSession, path: str, header_row: int = 1, separator: str = ","
) -> tuple[DataFrame, DataFrame]:
    """Delimited text whose header is row ``header_row``: ``(lead rows, data rows)``.

    Both carry ``row_no``; lead rows are raw lines, data rows are text cells. Only the
    first ``header_row`` lines come to the driver. Where cells hold line breaks, rows below the
    header are numbered by record, without lines that are empty; lead lines and the header have
    no such cells.
    """
    raw = spark.read.text(path)
    lines = with_row_index(raw).select(F.regexp_replace("value", _BYTE_ORDER_MARK, "").alias("value"), "row_no")
    head = _line(spark, raw, lines, header_row)
    if head is None:
        raise InsufficientData(f"no row {header_row}")
    cells = next(csv.reader([head], delimiter=separator), [])
    names = normalise_headers([c if c != "" else None for c in cells])
    parsed = F.from_csv("value", _ddl(names),
                        {"sep": separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
    lead = lines.where(ref("row_no") < header_row).select("row_no", "value")
    if not _open_lines(spark, path, separator).isEmpty():
        # Records leave out empty lines, so they come that many numbers early.
        skipped = lines.where(ref("row_no") < header_row).agg(F.count_if(F.col("value") == "")).scalar()
        records = _records(spark, path, False, separator, {}).select("value", "file_no", "block", "at")
        numbered = number_rows(records, ["value"], ["file_no", "block"], "at", "_record")
        data = numbered.select((ref("_record") + skipped).alias("row_no"), parsed.alias("cells")).where(ref("row_no") > header_row)
        return lead, data.select("row_no", *[F.col("cells").getField(n).alias(n) for n in names])
    data = lines.where(ref("row_no") > header_row).select("row_no", parsed.alias("cells"))
    return lead, data.select("row_no", *[F.col("cells").getField(n).alias(n) for n in names])


def _line(spark: SparkSession, raw: DataFrame, lines: DataFrame, number: int) -> str | None:
    """One line of a text source, from the start of its first file if it lies there, so
    that finding the header does not read the table."""
    first = min(raw.inputFiles(), key=unquote, default=None)
    if first is not None and not set(unquote(first)) & set("*?[]{}\\"):
        start = spark.read.text(unquote(first)).head(number)
        if len(start) == number:
            return re.sub(_BYTE_ORDER_MARK, "", start[-1]["value"])
    found = lines.where(ref("row_no") == number).select("value").head()
    return None if found is None else found["value"]


def _ddl(names: list[str]) -> str:
    return ", ".join("`" + n.replace("`", "``") + "` STRING" for n in names)


def write_if(df: DataFrame, write: Callable[[DataFrame], None], found: DataFrame | None = None) -> bool:
    """Write only when there is a result; returns whether it was written.

    ``found`` is the frame that must have a row (default: the result itself). The check
    stops at the first row; only when there is none does it read everything, and then
    nothing is written.
    """
    if (df if found is None else found).isEmpty():
        return False
    write(df)
    return True


def write_staged(
    df: DataFrame, path: str, format: str = "parquet", wanted: Callable[[dict[str, int]], bool] | None = None,
    watched: dict[str, Observation] | None = None, **options,
) -> int | None:
    """Write a result that must not be empty, running its plan once; returns the rows written.

    The result goes to a hidden folder beside the target while its rows are counted, and is
    renamed to the target when it is complete and ``wanted``: by default, when it has a row.
    Otherwise, and after a failure, nothing is left and None is returned. ``wanted`` gets
    ``rows`` and the counts named ``rows`` of the ``watched`` observations, e.g. of the input,
    so that a dedup is kept only if it removed rows. The target must not exist.
    """
    spark, seen = df.sparkSession, Observation()
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(target):
        raise TableError(f"{path} exists")
    staging = spark._jvm.org.apache.hadoop.fs.Path(target.getParent(), f"_staged-{uuid.uuid4().hex}")
    try:
        counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
        counted.write.format(format).options(**options).save(staging.toString())
        counts = {"rows": int(seen.get["rows"]), **{n: int(o.get["rows"]) for n, o in (watched or {}).items()}}
        if not (counts["rows"] > 0 if wanted is None else wanted(counts)):
            return None
        if not system.rename(staging, target):
            raise TableError(f"{path} could not be made")
        return counts["rows"]
    finally:
        if system.exists(staging):
            system.delete(staging, True)


def _load(spark: SparkSession, path: str, format: str) -> DataFrame:
    options = {}
    if format == "csv":
        # One look at the lines tells both whether they are text and whether cells hold breaks.
        invalid, broken = spark.read.text(path).agg(
            F.coalesce(F.bool_or(~F.is_valid_utf8("value")), F.lit(False)),
            F.coalesce(F.bool_or(opens(F.col("value"))), F.lit(False))).first()
        if invalid:
            raise TableError("not valid UTF-8")
        options = {"multiLine": "blocks", "address": "_at"} if broken else {"multiLine": "false"}
    df = scan(spark, path, format, **options)
    if not df.columns:
        raise InsufficientData("no columns")
    return df.sort("_at").drop("_at") if "address" in options else df


def _convert(spark: SparkSession, path: str, source: str, target: str, out: str) -> tuple:
    try:
        seen = Observation()
        df = _load(spark, path, source).observe(seen, F.count(F.lit(1)).alias("rows"))
        if target == "csv":
            write_csv(df, out)
        else:
            df.write.format(target).save(out)
        return (path, True, None, int(seen.get["rows"]))
    except Exception as error:  # one bad input must not stop the others
        return (path, False, str(error), None)


def convert_many(
    spark: SparkSession, paths: list[str], source: str, target: str, output_dir: str, parallel: int = 4
) -> DataFrame:
    """Convert each input to ``target`` format in its own Spark job.

    Returns ``(input, ok, error, rows, output)``, one row per input in the given order. Inputs
    of one name get outputs of their own (``t.orc``, ``t_2.orc``). ``parallel`` jobs are
    submitted at a time so that small inputs do not leave the cluster idle.
    """
    stems = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    names = normalise_headers([s.rsplit(".", 1)[0] if "." in s else s for s in stems])
    outputs = [f"{output_dir.rstrip('/')}/{n}.{target}" for n in names]
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        done = list(pool.map(lambda p, out: (*_convert(spark, p, source, target, out), out), paths, outputs))
    return spark.createDataFrame(done, "input string, ok boolean, error string, rows bigint, output string")
