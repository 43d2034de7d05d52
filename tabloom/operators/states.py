"""Groups kept up to date: distributions, cross-tabulations and duplicates of a growing table.

Each batch of rows is reduced to one mergeable state per group, which is stored under the
batch's name; results are made from the states, so the rows are never read again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.errors import InsufficientData, MissingColumn, TableError
from tabloom.functions.cells import EMPTY_LABEL, group_key, num, ref, round_exact
from tabloom.functions.names import normalise_headers
from tabloom.operators.pivot import AGGREGATES
from tabloom.sources.tables import write_staged

_BATCH, _MERGED, _NAMES = "batch-", "merged-", "_batches"


class GroupStates:
    """States of the groups of ``columns``, with the numbers in ``values``, in a folder.

    A state is the group's rows and, for each value column, how many of its cells are numbers,
    their sum, least and greatest. Adding a batch is one aggregation of that batch; a batch
    whose name is known is left out, so a repeat, however late, changes nothing. A batch
    becomes visible by one rename, or not at all; an empty one is remembered too. All batches
    have the same types. There is one writer at a time; readers need no lock, but a frame made
    before :meth:`compact` must be made anew after it.

    The driver holds the names of batches. The folder grows by at most one line per group and
    batch until it is compacted.
    """

    def __init__(self, spark: SparkSession, folder: str, columns: Sequence[str], values: Sequence[str] = ()):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.columns, self.values = list(columns), list(values)
        if not self.columns or len(set(self.columns)) < len(self.columns):
            raise TableError("states need distinct columns to group by")

    # --- what is stored

    def _system(self):
        place = self._place()
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _place(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _stored(self) -> tuple[list[str], set[str]]:
        """Folders that hold the states, and the names of all batches in them."""
        system = self._system()
        found = [s.getPath().getName() for s in system.listStatus(self._place())] if system.exists(self._place()) else []
        merged = sorted((n for n in found if n.startswith(_MERGED)), key=lambda n: int(n[len(_MERGED):]))[-1:]
        names = {r["batch"] for n in merged for r in self.spark.read.parquet(f"{self.folder}/{n}/{_NAMES}").collect()}
        fresh = {n: unquote(n[len(_BATCH):]) for n in found if n.startswith(_BATCH)}
        folders = merged + sorted(n for n, batch in fresh.items() if batch not in names)
        return folders, names | set(fresh.values())

    def batches(self) -> list[str]:
        return sorted(self._stored()[1])

    def _read(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.folder}/{n}" for n in folders]
        states = self.spark.read.schema(self.spark.read.parquet(paths[0]).schema).parquet(*paths)
        if states.columns != self._names():
            raise TableError(f"{self.folder} holds states of other columns: {', '.join(states.columns)}")
        return states

    def _names(self) -> list[str]:
        return [*self.columns, "_rows", *[f"_of_{v}" for v in self.values]]

    # --- batches

    def _reduced(self, df: DataFrame) -> DataFrame:
        for name in (*self.columns, *self.values):
            if name not in df.columns:
                raise MissingColumn(name)
        numbers = {v: num(df, v).cast("double") for v in self.values}
        states = [
            F.struct(F.count(x).alias("numbers"), F.sum(x).alias("sum"), F.min(x).alias("low"), F.max(x).alias("high")).alias(f"_of_{v}")
            for v, x in numbers.items()
        ]
        return df.groupBy(*[ref(c) for c in self.columns]).agg(F.count(F.lit(1)).alias("_rows"), *states)

    def _state(self, name: str) -> Column:
        """The state of several states together."""
        def part(field: str) -> Column:
            return ref(name).getField(field)
        return F.struct(
            F.sum(part("numbers")).alias("numbers"), F.sum(part("sum")).alias("sum"),
            F.min(part("low")).alias("low"), F.max(part("high")).alias("high")).alias(name)

    def add(self, df: DataFrame, batch: str) -> bool:
        """Add a batch of rows under its name; False, and nothing is read, if the name is known."""
        folders, names = self._stored()
        if batch in names:
            return False
        states = self._reduced(df)
        if folders:
            if self._read(folders[:1]).dtypes != states.dtypes:
                raise TableError(f"batch '{batch}' has other types than the batches before it")
        write_staged(states, f"{self.folder}/{_BATCH}{quote(batch, safe='')}", wanted=lambda counts: True)
        return True

    def follow(self, stream: DataFrame, name: str, checkpoint: str, **trigger) -> StreamingQuery:
        """Add the micro-batches of a stream as ``name-0``, ``name-1`` and so on.

        A micro-batch that is run again after a failure has the same name and counts once. The
        name belongs to the checkpoint: a new checkpoint needs a new name.
        """
        writer = stream.writeStream.option("checkpointLocation", checkpoint)
        return (writer.trigger(**trigger) if trigger else writer).foreachBatch(
            lambda df, number: self.add(df, f"{name}-{number}") and None).start()

    def states(self) -> DataFrame:
        """One line per group of all batches: the columns, ``_rows`` and ``_of_<value>``."""
        folders, _ = self._stored()
        if not folders:
            raise InsufficientData("no batch has been added")
        read = self._read(folders)
        return read.groupBy(*[ref(c) for c in self.columns]).agg(
            F.sum("_rows").alias("_rows"), *[self._state(f"_of_{v}") for v in self.values])

    def compact(self) -> None:
        """Replace the stored states by one per group; the batches' names are kept with them.

        The new states and names become visible by one rename. Folders they replace are
        deleted afterwards; left behind by a failure, they are not read.
        """
        folders, names = self._stored()
        if len(folders) < 2:
            return
        system, staging = self._system(), f"_staged-{uuid.uuid4().hex}"
        last = [int(n[len(_MERGED):]) for n in folders if n.startswith(_MERGED)]
        try:
            self.states().write.parquet(f"{self.folder}/{staging}")
            known = self.spark.createDataFrame([(n,) for n in sorted(names)], "batch string")
            known.coalesce(1).write.parquet(f"{self.folder}/{staging}/{_NAMES}")
            if not system.rename(self._place(staging), self._place(f"{_MERGED}{(last or [0])[0] + 1}")):
                raise TableError(f"{self.folder} could not be compacted")
        finally:
            system.delete(self._place(staging), True)
        for folder in folders:
            system.delete(self._place(folder), True)

    # --- results

    def _need(self, *names: str, among: Sequence[str] | None = None) -> None:
        for name in names:
            if name not in (self.columns if among is None else among):
                raise MissingColumn(name)

    def value_counts(self, column: str, label: str = EMPTY_LABEL) -> DataFrame:
        """As :func:`tabloom.value_counts` of all batches."""
        self._need(column)
        states = self.states()
        key, text = group_key(states, column, label)
        sizes = states.groupBy(key.alias("key")).agg(F.sum("_rows").alias("n"))
        return sizes.select(text(ref("key")).alias("value"), "n")

    def duplicate_groups(self, columns: Sequence[str] | None = None) -> DataFrame:
        """As :func:`tabloom.duplicate_groups` of all batches, by default over all columns of the states."""
        names = list(columns or self.columns)
        self._need(*names)
        sizes = self.states().groupBy(*[ref(c) for c in names]).agg(F.sum("_rows").alias("_n")).where(ref("_n") > 1)
        return sizes.toDF(*normalise_headers([*names, "n"]))

    def pivot_cells(self, rows: str, columns: str, value: str | None = None, how: str = "count", label: str = EMPTY_LABEL) -> DataFrame:
        """As :func:`tabloom.pivot_cells` of all batches; a count needs no value."""
        if how not in AGGREGATES:
            raise TableError(f"unknown aggregate '{how}'")
        self._need(rows, columns)
        states = self.states()
        if how == "count":
            cell = F.sum("_rows")
        else:
            self._need(value, among=self.values)
            state = self._state(f"_of_{value}")
            numbers, total = state.getField("numbers"), state.getField("sum")
            found = {"sum": total, "avg": F.when(numbers > 0, total / numbers),
                     "min": state.getField("low"), "max": state.getField("high")}[how]
            cell = F.coalesce(found, F.lit(0.0))
        (row_key, row_text), (col_key, col_text) = group_key(states, rows, label), group_key(states, columns, label)
        cells = states.groupBy(row_key.alias("r"), col_key.alias("c")).agg(cell.alias("cell"))
        shown = round_exact(ref("cell"), 2) if how in ("sum", "avg") else ref("cell")
        return cells.select(row_text(ref("r")).alias("row_key"), col_text(ref("c")).alias("col_key"), shown.alias("cell"))
