"""Recipes as graphs: steps are named results with several inputs, consumers and sinks.

``{"name": "big", "from": "orders", "op": "filter", ...}`` is a step: a call of one operator
on an input or on another step's result. A merge may name several in ``from``. Steps may
stand in any order.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Collection, Iterable, Mapping, Sequence
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from tabloom.errors import TableError
from tabloom.operators.merge import merge_frames
from tabloom.plans.recipe import apply_op
from tabloom.sources.tables import write_staged
from tabloom.storage import delete, scratch_dir

_BY_ORDER = ("dedup", "removed_rows")
_NUMBERED = ("row_numbers", "row_range")


class Graph:
    def __init__(self, inputs: Mapping[str, DataFrame], steps: Sequence[Mapping]):
        self.inputs, self.steps = dict(inputs), {}
        for step in steps:
            if not all(step.get(k) for k in ("name", "from", "op")):
                raise TableError("a step of a graph has 'name', 'from' and 'op'")
            if step["name"] in self.steps or step["name"] in self.inputs:
                raise TableError(f"two results are named '{step['name']}'")
            self.steps[step["name"]] = dict(step)
        for name in self.steps:
            sources = self._sources(name)
            unknown = [s for s in sources if s not in self.steps and s not in self.inputs]
            if unknown:
                raise TableError(f"'{name}' reads unknown results: {', '.join(unknown)}")
            if len(sources) > 1 and self.steps[name]["op"] != "merge":
                raise TableError(f"'{name}' reads several results and is no merge")
        try:
            order = TopologicalSorter({n: self._sources(n) for n in self.steps}).static_order()
            self._order = [n for n in order if n in self.steps]
        except CycleError as error:
            raise TableError(f"steps read each other: {' -> '.join(error.args[1])}") from error

    def _sources(self, name: str) -> list[str]:
        source = self.steps[name]["from"]
        return [source] if isinstance(source, str) else list(source)

    def _reads_order(self, name: str) -> bool:
        """Whether the step goes by the place of rows in their source."""
        step = self.steps[name]
        return step["op"] in _NUMBERED or step.get("address") is not None or (
            step["op"] in _BY_ORDER and step.get("order_by") is None)

    def _needed(self, names: Iterable[str], behind: Collection[str] = ()) -> list[str]:
        """Steps the results rest on, sources first; not those only reached through ``behind``."""
        found, left = set(), list(names)
        while left:
            name = left.pop()
            if name in found or name in self.inputs:
                continue
            if name not in self.steps:
                raise TableError(f"no result is named '{name}'")
            found.add(name)
            if name not in behind:
                left += self._sources(name)
        return [n for n in self._order if n in found]

    def _built(self, name: str, frames: Mapping[str, DataFrame]) -> DataFrame:
        call = {k: v for k, v in self.steps[name].items() if k not in ("name", "from")}
        parents = [frames[s] for s in self._sources(name)]
        if call["op"] == "merge" and "paths" not in call:
            return merge_frames(parents, **{k: v for k, v in call.items() if k != "op"})
        if len(parents) > 1:
            raise TableError(f"'{name}' merges either results or paths")
        return apply_op(parents[0], call)

    def results(self, *names: str) -> dict[str, DataFrame]:
        """The named results, each as one plan down to the inputs; nothing is written between."""
        frames = dict(self.inputs)
        for name in self._needed(names):
            frames[name] = self._built(name, frames)
        return {n: frames[n] for n in names}

    def run(self, sinks: Mapping[str, str]) -> DataFrame:
        """Write results to their paths as Parquet; returns ``(result, op, rows, sink)``.

        A result that several steps read is worked out once: it is written, to its own sink
        or to the shared folder, and its readers scan those files, so an input is scanned once
        however many sinks rest on it and a lost executor costs no more than its tasks. All
        other steps are part of their reader's plan. Written results keep all their columns:
        a ``columns`` step before a shared one narrows it.

        Files written between have another order of rows than the source, so steps that go
        by the source's order (``dedup`` and ``removed_rows`` without ``order_by``, row
        numbers and ranges, merges with ``address``) read the source itself. Rows are counted
        while they are written. An empty result writes nothing and is empty for its readers;
        sinks must not exist. Tables in the shared folder are deleted at the end, also after a
        failure; sinks written before a failure stay.
        """
        unknown = [n for n in sinks if n not in self.steps]
        if unknown:
            raise TableError(f"no step is named {', '.join(unknown)}")
        by_order = {n for n in self._needed(sinks) if self._reads_order(n)}
        needed = self._needed(sinks, by_order)
        uses = Counter(s for n in needed if n not in by_order for s in self._sources(n))
        sources = dict.fromkeys(s for n in needed if n in by_order for s in self._sources(n))
        placed, frames = self.results(*sources), dict(self.inputs)
        spark = next(iter(self.inputs.values())).sparkSession
        lines, between = [], []
        try:
            for name in needed:
                df = self._built(name, placed if name in by_order else frames)
                if name in sinks or uses[name] > 1:
                    path = sinks.get(name)
                    if path is None:
                        path = scratch_dir(spark)
                        between.append(path)
                    rows = write_staged(df, path) or 0
                    df = spark.read.schema(df.schema).parquet(path) if rows else spark.createDataFrame([], df.schema)
                    lines.append((name, self.steps[name]["op"], rows, name in sinks))
                frames[name] = df
        finally:
            for path in between:
                delete(spark, path)
        return spark.createDataFrame(lines, "result string, op string, rows bigint, sink boolean")
