"""Physical row numbers, row ranges, and tables with lead and tail blocks.

Spark frames have no row order of their own; the numbers here come from where a row lies
in its source, and are read from the frame exactly as scanned (before filters or joins).
"""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from tabloom.errors import TableError
from tabloom.functions.cells import EMPTY_LABEL, group_text, ref, to_text

LEAD, HEADER, DATA, TAIL = "lead", "header", "data", "tail"
# Place of each section in an output.
_PLACE = {LEAD: 0, HEADER: 1, DATA: 2, TAIL: 3}
# Plan nodes that leave each source row in its place, and sources whose rows have one.
_IN_PLACE = {"Project", "SubqueryAlias", "Filter"}
_FIXED = {"LocalRelation", "Range", "LogicalRDD"}


def _nodes(df: DataFrame) -> list:
    """Nodes of the analysed plan, from the result down."""
    found, left = [], [df._jdf.queryExecution().analyzed()]
    while left:
        node = left.pop()
        found.append(node)
        left += [node.children().apply(i) for i in range(node.children().size())]
    return found


def _names(df: DataFrame) -> set[str]:
    """Names of the plan's nodes; a coalesce, which keeps the order of rows, is left out."""
    return {n.nodeName() for n in _nodes(df) if not (n.nodeName() == "Repartition" and not n.shuffle())}


def _metadata_fields(df: DataFrame) -> list[str]:
    try:
        return df.select("_metadata").schema["_metadata"].dataType.fieldNames()
    except AnalysisException:
        return []


def natural_key(path: Column) -> Column:
    """A text that sorts like a file's folder, then its name with the first number as a number."""
    name = F.substring_index(path, "/", -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    digits = F.regexp_replace(F.regexp_extract(name, "[0-9]+", 0), "^0+", "")
    return F.concat(
        folder, F.regexp_extract(name, "^[^0-9]*", 0), F.lpad(F.length(digits).cast("string"), 4, "0"), digits, F.lit("/"), name)


def _natural(path: str) -> str:
    """The same key of one path."""
    folder, _, name = path.rpartition("/")
    letters, digits = re.match("([^0-9]*)([0-9]*)", name).groups()
    digits = digits.lstrip("0")
    return f"{folder}/{letters}{len(digits):04d}{digits}/{name}"


def _roots(df: DataFrame) -> list[str]:
    """The paths a scan was asked for, in the order of the request."""
    for node in _nodes(df):
        if node.nodeName() == "LogicalRelation":
            paths = node.relation().location().rootPaths()
            return [paths.apply(i).toUri().toString() for i in range(paths.size())]
    return []


def _at_root(path: Column, roots: list[tuple[str, int]]) -> Column:
    """The number of the last root that is not behind the path, by halving the sorted roots."""
    if len(roots) == 1:
        return F.lit(roots[0][1])
    middle = len(roots) // 2
    return F.when(path < roots[middle][0], _at_root(path, roots[:middle])).otherwise(_at_root(path, roots[middle:]))


def _bare(path: str) -> str:
    """A path without its scheme, so that file:/a and file:///a are one; with / at the end."""
    return re.sub("^[a-zA-Z0-9+.-]+:/*", "/", path).rstrip("/") + "/"


def file_order(df: DataFrame, path: Column | None = None) -> Column:
    """What sorts the files of a scan: the place of their path in the request, then folder and
    name, with the number in a name as a number.

    Text order is the same for most tables (one folder, numbers of one width); the file names,
    which the scan's plan holds, tell, and then the path itself is the key and costs nothing.
    """
    path, roots = F.col("_metadata.file_path") if path is None else path, [_bare(r) for r in _roots(df)]
    keys = [_natural(f) for f in sorted(df.inputFiles())]
    if roots == sorted(roots) and keys == sorted(keys):
        return path
    key = natural_key(path)
    if len(roots) < 2:
        return key
    bare = F.concat(F.regexp_replace(path, "^[a-zA-Z0-9+.-]+:/*", "/"), F.lit("/"))
    number = _at_root(bare, sorted((root, i) for i, root in enumerate(roots)))
    return F.concat(F.lpad(number.cast("string"), 9, "0"), F.lit(":"), key)


def _address(df: DataFrame) -> list[Column]:
    """Columns that order rows as they lie in the source: file, block in the file, place.

    Parquet knows the row's index in its file; other file formats use the block's offset and
    the position inside the task that reads it. A frame made of local rows, or of a range, has
    its partitions in order. Any other frame (joined, exploded, merged, shuffled) has no place
    for its rows, or one place for several, and is refused: give ``order_by``.
    """
    names = _names(df)
    fields = _metadata_fields(df) if "LogicalRelation" in names and names <= _IN_PLACE | {"LogicalRelation"} else []
    if "row_index" in fields:
        return [file_order(df), F.lit(0).cast("bigint"), F.col("_metadata.row_index")]
    if "file_block_start" in fields:
        return [file_order(df), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    if names & _FIXED and names <= _IN_PLACE | _FIXED:
        place = F.monotonically_increasing_id()  # the partition in the upper 31 bits
        return [F.lit(""), F.shiftright(place, 33), place]
    raise TableError("the rows of this table have no order of their own; name unique columns in order_by")


def with_address(df: DataFrame, prefix: str = "_at") -> tuple[DataFrame, list[str]]:
    """Add columns that order rows as they lie in the source, without any job or shuffle."""
    names = [f"{prefix}{i}" for i in range(3)]
    return df.select("*", *[p.alias(n) for p, n in zip(_address(df), names)]), names


def address_struct(df: DataFrame, input_no: int) -> Column:
    """The place of a row among several inputs, as one column that sorts like the rows lie."""
    file, block, at = _address(df)
    return F.struct(F.lit(input_no).alias("input"), file.alias("file"), block.alias("block"), at.alias("at"))


def with_row_index(df: DataFrame, name: str = "row_no", address: str | None = None) -> DataFrame:
    """Add the 1-based physical row number over all files, in the order of :func:`file_order`.

    ``address`` names the column that a merge added (see ``merge_frames``); rows are then
    numbered input by input. Rows are numbered inside their file block, cut into pieces of a
    million rows; the first number of each piece comes from a running sum over one small row
    per piece, joined by piece, so a huge file is many keys and the table is never sorted. The
    window without partitions sees one row per piece, never table rows. A filtered frame is
    refused: what is left of a block does not tell how many rows it had.
    """
    if "Filter" in _names(df):
        raise TableError("number the rows before they are filtered")
    if address is None:
        addressed, (*block, place) = with_address(df)
    else:
        if not _names(df) <= {"Project", "SubqueryAlias", "Union", "LogicalRelation"} | _FIXED:
            raise TableError("number the rows of a merge before anything else")
        addressed = df.select("*", *[ref(address)[f].alias(f"_at{i}") for i, f in enumerate(("input", "file", "block", "at"))])
        block, place = ["_at0", "_at1", "_at2"], "_at3"
    return number_rows(addressed, df.columns, block, place, name)


def number_rows(addressed: DataFrame, columns: list[str], block: list[str], place: str, name: str) -> DataFrame:
    """The columns and a row number over blocks, in the order of the block columns, whose rows
    have places that rise by one."""
    # Places in a task start anywhere but rise by one, so pieces are whole numbers of them.
    addressed = addressed.withColumn("_piece", F.shiftright(ref(place), 20))
    keys = [*block, "_piece"]
    sizes = addressed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(ref(place)).alias("_low"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        *[ref(b).alias(f"_b{i}") for i, b in enumerate(keys)],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - ref("_low")).alias("_base"),
    )
    joined = addressed.join(bases, [ref(b) == ref(f"_b{i}") for i, b in enumerate(keys)], "inner")
    return joined.select(*[ref(c) for c in columns], (ref(place) + ref("_base") + 1).alias(name))


def source_range(df: DataFrame, start: int, end: int, name: str = "row_no") -> DataFrame:
    """Rows ``start``..``end`` of a source with their numbers, reading only the files they lie
    in; none at all when the table does not reach ``end``.

    Files are numbered in their order, so those of a range are neighbours: one job counts the
    rows of each file, without any column of the table (Parquet answers from its footers), and
    brings one row to the driver, the first and the last path and the rows before them. The
    window without partitions sees one row per file. Frames are those of ``with_row_index``.
    """
    if "Filter" in _names(df):
        raise TableError("number the rows before they are filtered")
    file = _address(df)[0]
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        df.select(file.alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    )
    wanted = (F.col("before") < end) & (F.col("before") + F.col("n") >= start)
    low, high, skipped, total = files.agg(
        F.min(F.when(wanted, F.col("file"))), F.max(F.when(wanted, F.col("file"))),
        F.min(F.when(wanted, F.col("before"))), F.sum("n"),
    ).first()
    reached = 1 <= start <= end <= (total or 0)
    kept = df.where(file.between(low, high)) if reached else df.where(F.lit(False))
    addressed = kept.select("*", *[p.alias(f"_at{i}") for i, p in enumerate(_address(df))])
    numbered = number_rows(addressed, df.columns, ["_at0", "_at1"], "_at2", name)
    shifted = numbered.select(*[ref(c) for c in df.columns], (ref(name) + F.lit(skipped or 0).cast("long")).alias(name))
    return shifted.where(ref(name).between(start, end))


def _row_count(numbered: DataFrame, row_no: str) -> Column:
    return numbered.agg(F.max(ref(row_no))).scalar()


def row_range(numbered: DataFrame, start: int, end: int, row_no: str = "row_no") -> DataFrame:
    """Rows ``start``..``end``; none at all when the table does not reach ``end``."""
    if start < 1 or end < start:
        return numbered.where(F.lit(False))
    whole = _row_count(numbered, row_no) >= end
    return numbered.where(ref(row_no).between(start, end) & whole)


def row_range_preview(
    numbered: DataFrame, start: int, end: int, max_cells: int = 3, row_no: str = "row_no"
) -> DataFrame:
    """One row, one column ``preview``: ``Row1: a, b; Row2: c`` for the asked rows.

    Empty cells among the first ``max_cells`` are left out; the text is empty when the
    table does not reach ``end``. The group collected has ``end - start + 1`` rows.
    """
    cells = [c for c in numbered.columns if c != row_no][:max_cells]
    label = F.concat(F.lit("Row"), ref(row_no).cast("string"))
    shown = F.concat_ws(", ", *[to_text(numbered, c) for c in cells])
    filled = reduce(operator.or_, [ref(c).isNotNull() for c in cells], F.lit(False))
    line = F.when(filled, F.concat(label, F.lit(": "), shown)).otherwise(label)
    rows = row_range(numbered, start, end, row_no).select(ref(row_no).alias("n"), line.alias("line"))
    ordered = F.sort_array(F.collect_list(F.struct("n", "line")))
    return rows.agg(F.array_join(F.transform(ordered, lambda r: r["line"]), "; ").alias("preview"))


def split_sections(
    numbered: DataFrame,
    header_row: int = 1,
    tail: tuple[int, int] | None = None,
    include_lead: bool = True,
    row_no: str = "row_no",
) -> DataFrame:
    """Add ``section``: lead rows, the header row, data rows and tail rows.

    Rows of the tail range are never data. If the table ends before the range does, they
    are dropped altogether. Without ``include_lead`` the lead rows are dropped.
    """
    n = ref(row_no)
    section = F.when(n < header_row, F.lit(LEAD)).when(n == header_row, F.lit(HEADER))
    keep = F.lit(True) if include_lead else n >= header_row
    if tail and tail[0] > 0 and tail[1] >= tail[0]:
        in_tail = n.between(*tail) & (n > header_row)
        section = section.when(in_tail, F.lit(TAIL))
        keep = keep & (~in_tail | (_row_count(numbered, row_no) >= tail[1]))
    return numbered.where(keep).withColumn("section", section.otherwise(F.lit(DATA)))


def attach_banner(
    sections: DataFrame,
    column: str,
    keep_header: bool = True,
    label: str = EMPTY_LABEL,
    row_no: str = "row_no",
) -> DataFrame:
    """Rows of every output: lead block, header, the key's data rows, tail block.

    Adds ``split_key`` and ``place``; an output is its key's rows ordered by
    ``(place, row_no)``. The distinct keys are joined with the banner rows by pieces of 1,024
    numbers, whose list is a scalar array: 100 million tail rows are 100,000 pieces. Data rows
    do not move.
    """
    place = F.lit(None).cast("int")
    for name, number in _PLACE.items():
        place = F.when(ref("section") == name, F.lit(number)).otherwise(place)
    fields = [c for c in sections.columns if c not in (row_no, "section")]
    placed = sections.select(
        group_text(sections, column, label).alias("split_key"), place.alias("place"),
        ref(row_no).alias("row_no"), *[ref(c) for c in fields], ref("section"),
    )
    data = placed.where(ref("section") == DATA).drop("section")
    repeated = [LEAD, TAIL] + ([HEADER] if keep_header else [])
    banner = placed.where(ref("section").isin(repeated)).drop("section", "split_key")
    banner = banner.withColumn("_piece", F.shiftright("row_no", 10))
    pieces = banner.agg(F.collect_set("_piece")).scalar()
    keys = data.select("split_key").distinct().select("split_key", F.explode(pieces).alias("_piece"))
    return data.unionByName(keys.join(banner, "_piece").drop("_piece"))
