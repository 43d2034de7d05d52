"""CSV whose cells hold line breaks, read in blocks by many tasks.

Where a block starts nobody knows whether it is inside a quoted cell. So each block first says,
for both cases, in which it ends; a running composition of these answers, one row per block,
tells how each block really starts. Then each block is cut into records by the task that reads
it. A record that lies in several blocks, at most one begins in each, is put together from its
lines.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_LINE = ("value", "file", "block", "place", "turn")
#: Blocks (a path and some numbers each) that are broadcast; more are joined by a shuffle of the lines.
BROADCAST_BLOCKS = 100_000


def _pattern(sep: str) -> tuple[str, str]:
    """Lines that end outside a quoted cell: of those that start outside, and inside one.

    A cell is quoted if it starts with a quote; what follows its closing quote, and a quote
    within an unquoted cell, are plain text. The loops are possessive, so that long lines
    neither backtrack nor nest calls.
    """
    s = "\\" + sep if not sep.isalnum() else sep
    closed = rf'[^"]*+(?:""[^"]*+)*+"[^{s}]*+'
    cell = rf'(?:"{closed}|(?!")[^{s}]*+)'
    return rf"^{cell}(?:{s}{cell})*+\z", rf"^{closed}(?:{s}{cell})*+\z"


def opens(line: Column, sep: str = ",") -> Column:
    """Whether a line that starts a record ends inside a quoted cell."""
    return F.contains(line, F.lit('"')) & ~F.rlike(line, F.lit(_pattern(sep)[0]))


def _turn(line: Column, sep: str) -> Column:
    """0 if a line leaves both states as they are, else 1 + 2 * (ends inside from outside) + (from inside)."""
    outside, inside = (F.rlike(line, F.lit(p)) for p in _pattern(sep))
    code = F.when(outside, F.when(inside, 1).otherwise(0)).otherwise(F.when(inside, 3).otherwise(4))
    return F.when(F.contains(line, F.lit('"')), code).otherwise(0)


def _after(state: Column, turn: Column) -> Column:
    """The state after a line that does not leave it as it is: 1 is inside."""
    return F.when(state == 0, F.shiftright(turn - 1, 1)).otherwise((turn - 1).bitwiseAND(1))


def _lines(spark: SparkSession, path: str | list[str], sep: str, options: dict) -> DataFrame:
    """Lines with their file, block and place, and what they do to the state. A line keeps its \\r."""
    raw = spark.read.options(**{**options, "lineSep": "\n"}).text(path)
    others = [c for c in raw.columns if c != "value"]
    block = F.col("_metadata.file_block_start")
    value = F.when(block == 0, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value"))
    placed = raw.select(
        value.alias("value"), F.col("_metadata.file_path").alias("file"), block.alias("block"),
        F.monotonically_increasing_id().alias("place"), *[F.col(f"`{c}`") for c in others])
    return placed.select(*_LINE[:4], _turn(F.col("value"), sep).alias("turn"), *[f"`{c}`" for c in others])


def _blocks(lines: DataFrame) -> DataFrame:
    """One row per block: what a start outside (o) and inside (i) a cell leads to, where an open
    cell closes, and the first line with text.

    o and i hold the state at the end and, if a record is open there, the line where it starts;
    that is null if it starts in an earlier block.
    """
    turns = F.collect_list(F.when(F.col("turn") > 0, F.struct("place", "turn")))  # only lines that change a state
    filled = ~F.col("value").isin("", "\r")
    seen = lines.groupBy("file", "block").agg(
        F.min(F.when(filled, F.col("place"))).alias("text"), F.sort_array(turns).alias("turns"))

    def end(state: int) -> Column:
        none = F.lit(None).cast("long")

        def step(s: Column, t: Column) -> Column:
            after = _after(s["state"], t["turn"])
            opened = F.when(after == 0, none).when(s["state"] == 0, t["place"]).otherwise(s["opened"])
            return F.struct(after.alias("state"), opened.alias("opened"))

        return F.aggregate("turns", F.struct(F.lit(state).alias("state"), none.alias("opened")), step)

    close = F.get(F.filter("turns", lambda t: (t["turn"] - 1).bitwiseAND(1) == 0), F.lit(0))["place"]
    return seen.select("file", "block", "text", end(0).alias("o"), end(1).alias("i"), close.alias("close"))


def _starts(blocks: DataFrame, order: Column) -> DataFrame:
    """Add how each block starts (1 is inside a cell) and ends, the block where the record that
    its first lines belong to starts, and the file's number.

    A block that ends alike from both starts sets the state; others keep or turn it, so the
    state is the last one set, turned as often as blocks since then say.
    """
    upto = Window.partitionBy("file").orderBy("block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    o, i = F.col("o.state"), F.col("i.state")
    counted = blocks.withColumn("swaps", F.sum(((o == 1) & (i == 0)).cast("int")).over(upto))
    known = F.last(F.when(o == i, F.struct(o.alias("state"), "swaps")), ignorenulls=True).over(before)
    placed = counted.withColumn("known", known).withColumn("passed", F.coalesce(F.lag("swaps").over(upto), F.lit(0)))
    turns = (F.col("passed") - F.coalesce("known.swaps", F.lit(0))).bitwiseAND(1).cast("int")
    stated = placed.withColumn("start", F.coalesce("known.state", F.lit(0)).bitwiseXOR(turns))
    begun = F.when((F.col("start") == 0) | F.col("close").isNotNull(), F.col("block"))
    end = F.when(F.col("start") == 0, F.col("o")).otherwise(F.col("i"))
    return stated.select(
        "file", "block", "text", "close", "start", end.alias("end"), F.last(begun, ignorenulls=True).over(before).alias("owner"),
        F.dense_rank().over(Window.orderBy(order)).alias("file_no"))


def _few(lines: DataFrame) -> bool:
    """Whether the files have no more blocks than may be broadcast, by their sizes."""
    spark = lines.sparkSession
    plan, size, files = lines._jdf.queryExecution().analyzed(), 0, len(lines.inputFiles())
    left = [plan]
    while left:
        node = left.pop()
        if node.nodeName() == "LogicalRelation":
            size += node.relation().location().sizeInBytes()
        left += [node.children().apply(k) for k in range(node.children().size())]
    conf = spark._jsparkSession.sessionState().conf()
    opening = conf.filesOpenCostInBytes()
    split = min(conf.filesMaxPartitionBytes(), max(opening, size // spark.sparkContext.defaultParallelism))
    return size // max(split, 1) + files <= BROADCAST_BLOCKS


def _assembler(header: bool, others: list[str]):
    """Cuts sorted lines into records. All it uses is inside, so that workers need no package."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        here, state, number = None, 0, 0
        held, first = [], None  # lines of a record that goes on, and the row of its first line
        title = False  # whether the next record is the header

        def records(values, rows):
            """A batch of complete records, without empty ones and without the header."""
            nonlocal number, title
            returns = pc.match_substring(values, "\r")
            if pc.any(returns).as_py():  # a \r outside a cell ends a record too
                parts, index = [], []
                for k, (text, odd) in enumerate(zip(values.to_pylist(), returns.to_pylist())):
                    pieces = text.split("\r") if odd else [text]
                    joined = [pieces[0]]
                    for piece in pieces[1:]:
                        if joined[-1].count('"') % 2:
                            joined[-1] += "\r" + piece
                        else:
                            joined.append(piece)
                    parts += joined
                    index += [k] * len(joined)
                values, rows = pa.array(parts, pa.string()), rows.take(pa.array(index))
            full = pc.greater(pc.binary_length(values), 0)
            if not pc.all(full).as_py():
                values, rows = values.filter(full), rows.filter(full)
            if title and len(values):
                values, rows, title = values.slice(1), rows.slice(1), False
            at = np.arange(number, number + len(values))
            number += len(values)
            columns = [values, rows.column("file_no"), rows.column("block"), pa.array(at, pa.int64())]
            return pa.RecordBatch.from_arrays(columns + [rows.column(c) for c in others], names=["value", "file_no", "block", "at", *others])

        for batch in batches:
            values, turn = batch.column("value"), batch.column("turn").to_numpy()
            ends = pc.ends_with(values, "\r")
            if pc.any(ends).as_py():
                values = pc.if_else(ends, pc.utf8_slice_codeunits(values, 0, -1), values)
            file, block, begin = (batch.column(c).to_numpy() for c in ("file_no", "block", "start"))
            change = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
            for low, high in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if low == high:
                    continue
                if here != (file[low], block[low]):
                    held = []  # a record that goes on in the next block is put together elsewhere
                    here, state, number = (file[low], block[low]), int(begin[low]), 0
                    title = header and block[low] == 0
                inside, at = np.empty(high - low, bool), 0
                for k in np.flatnonzero(turn[low:high]).tolist():
                    inside[at:k + 1] = state
                    code, at = int(turn[low + k]) - 1, k + 1
                    state = code & 1 if state else code >> 1
                inside[at:] = state
                starts = np.flatnonzero(~inside) + low
                until = int(starts[0]) if len(starts) else high
                if held:
                    held += values.slice(low, until - low).to_pylist()
                    if len(starts):
                        yield records(pa.array(["\n".join(held)], pa.string()), first)
                        held = []
                if not len(starts):
                    continue
                if state:  # the last one goes on
                    a = int(starts[-1])
                    held, first = values.slice(a, high - a).to_pylist(), batch.slice(a, 1)
                    starts, high = starts[:-1], a
                if len(starts):
                    a = int(starts[0])
                    texts = values.slice(a, high - a)
                    if len(texts) > len(starts):
                        lines = pa.ListArray.from_arrays(pa.array(np.append(starts, high) - a, pa.int32()), texts)
                        texts = pc.binary_join(lines, "\n")
                    yield records(texts, batch.take(pa.array(starts)) if len(starts) < batch.num_rows else batch)

    return run


def csv_records(spark: SparkSession, path: str | list[str], header: bool, sep: str, order, options: dict) -> DataFrame:
    """``(value, file_no, block, at)`` and the folder columns: the records of CSV files, as text.

    Records start and end as the CSV reader sees them; empty ones are left out, and with
    ``header`` the first one of each file. ``order`` makes the sort key of files from their
    paths. ``block`` is twice the block's place in the file, one more for the record that goes
    on in later blocks; ``at`` counts the records of a block from 0. Lines stay in the task
    that reads them while the blocks are few enough to be broadcast; else a block's lines meet in
    one task, where they are sorted.
    """
    lines = _lines(spark, path, sep, options)
    few = _few(lines)
    small = F.broadcast if few else lambda rows: rows
    others = [f"`{c}`" for c in lines.columns[len(_LINE):]]
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema}
    # One row per block already; as a grouping it keeps its columns, so both uses share one scan.
    starts = _starts(_blocks(lines), order(F.col("file"))).distinct()

    # Lines before the first record of a block, and those from the start of one still open at its end.
    edges = starts.where("start = 1 or end.state = 1").select(
        "file", "block", "text", "owner", "file_no", F.when(F.col("start") == 1, F.coalesce("close", F.lit((1 << 63) - 1))).alias("until"), "end.opened")
    met = lines.join(small(edges), ["file", "block"]).select(
        *others, "value", "place", "block", "file_no", (F.col("place") <= F.col("until")).alias("early"), "owner",
        F.coalesce(F.col("place") >= F.col("opened"), F.lit(False)).alias("late"), (F.col("opened") == F.col("text")).alias("title"))
    parts = met.where("early or late").select(
        *others, "file_no", F.when(F.col("late"), F.col("block")).otherwise(F.col("owner")).alias("begins"),
        F.struct("block", "place", F.regexp_replace("value", "\\r\\z", "").alias("value")).alias("line"), (F.col("late") & F.col("title") & (F.col("block") == 0)).alias("title"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list("line")), lambda line: line["value"]), "\n")
    long = parts.groupBy("file_no", "begins").agg(joined.alias("value"), F.max("title").alias("title"), *[F.first(c).alias(c.strip("`")) for c in others])
    if header:
        long = long.where("not title")
    long = long.select("value", "file_no", (2 * F.col("begins") + 1).alias("block"), F.lit(0).cast("long").alias("at"), *others)

    placed = lines.join(small(starts.select("file", "block", "start", "file_no")), ["file", "block"]).select(
        "file_no", "block", "place", "value", "turn", "start", *others)
    schema = "value string, file_no int, block long, at long" + "".join(f", {c} {kinds[c.strip('`')]}" for c in others)
    if not few:  # lines come out of a shuffle
        placed = placed.sortWithinPartitions("file_no", "block", "place")
    inside = placed.mapInArrow(_assembler(header, [c.strip("`") for c in others]), schema)
    return inside.withColumn("block", 2 * F.col("block")).unionByName(long)
