"""Packing of documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import give_back, numbered, ship, written
from tabloom.llm.encoding import Ids, loaded
from tabloom.llm.textbatch import slices

#: Tokens in one step of a pattern: a bundle of pieces takes whole steps.
STEP = 16
#: Share of a bundle that may be lost to whole steps before another number of pieces is tried.
LOST = 0.005


def _pieces(tokenizer_path: str, end_id: int, capacity: int, names: list[str], with_ids: bool):
    """Batches of (id, text) to the pieces of each document: whole sequences, then the rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = loaded(Ids, tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for first, stop in slices(texts):
                rows: list[tuple] = []
                encoded = ids.bytes([text or "" for text in texts.slice(first, stop - first).to_pylist()])
                for row, data in enumerate(encoded, first):
                    data += end
                    total = len(data) // 4
                    for start in range(0, total, capacity):
                        part = data[4 * start:4 * (start + capacity)]
                        rows.append((row, start, len(part) // 4, zlib.crc32(part), total, part if with_ids else None))
                columns = list(zip(*rows, strict=True))
                arrays = [keys.take(pa.array(columns[0]))] + [pa.array(c, pa.int64()) for c in columns[1:5]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(columns[5], pa.binary())] * with_ids, names=names)
        give_back()

    return run


def priced(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern that fits: an unbounded knapsack by dynamic programming."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, "right")
        best[room] = best[room - 1]
        if fits:
            offers = best[room - sizes[:fits]] + values[:fits]
            k = int(np.argmax(offers))
            if offers[k] > best[room]:
                best[room], taken[room] = offers[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), pattern


def cutting_patterns(demand: dict[int, int], capacity: int, rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns of sizes and how often each is used, which together hold exactly the demand.

    The linear program over patterns is solved by the simplex method with columns made when
    they are priced; its solution is rounded down, and what is left, less than one sequence
    for each size, is packed first-fit by falling size. `rounds` bounds the simplex steps:
    every step's solution is a packing, so stopping early costs padding only.
    """
    sizes = np.array(sorted(size for size, n in demand.items() if n), int)
    if not len(sizes):
        return []
    need = np.array([demand[s] for s in sizes], float)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(basis))
    amounts = inverse @ need
    for step in range(rounds):
        value, column = priced(inverse.sum(axis=0), sizes, capacity)
        if value <= 1 + 1e-7:
            break
        change = inverse @ column
        ratios = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(np.argmin(ratios))
        basis[:, leaves] = column
        inverse[leaves] /= change[leaves]
        others = np.arange(len(sizes)) != leaves
        inverse[others] -= np.outer(change[others], inverse[leaves])
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
        amounts = np.maximum(inverse @ need, 0)
    left = {int(s): int(demand[s]) for s in sizes}
    patterns: Counter = Counter()
    for k in np.argsort(-amounts, kind="stable"):
        pattern = {int(s): int(n) for s, n in zip(sizes, basis[:, k], strict=True) if n > 0.5}
        times = min(int(amounts[k] + 1e-6), *(left[s] // n for s, n in pattern.items()))
        if times > 0:
            patterns[tuple(sorted(pattern.items()))] += times
            for s, n in pattern.items():
                left[s] -= n * times
    for pattern, times in _first_fit(left, capacity):
        patterns[pattern] += times
    return [(dict(pattern), times) for pattern, times in sorted(patterns.items())]


def _first_fit(left: dict[int, int], capacity: int) -> Iterator[tuple[tuple, int]]:
    """Fill a sequence with the largest sizes that fit, as often as the supply allows, till nothing is left."""
    left = {s: n for s, n in left.items() if n}
    while left:
        room, pattern = capacity, {}
        for size in sorted(left, reverse=True):
            if n := min(left[size], room // size):
                pattern[size] = n
                room -= n * size
        times = min(left[s] // n for s, n in pattern.items())
        for s, n in pattern.items():
            left[s] -= n * times
            if not left[s]:
                del left[s]
        yield tuple(sorted(pattern.items())), times


def bundles(counts: dict[int, int], capacity: int, step: int) -> list[tuple[int, int, int]]:
    """(length, pieces in a bundle, bundles), so that short pieces share steps.

    A bundle holds up to half the capacity. Sequences of nothing but such bundles should hold
    nearly as many pieces as fit without steps; of the bundles that do, the smallest that loses
    at most LOST to whole steps is taken, or else the one that loses least. What is left of a
    length is one smaller bundle, so the loss beyond that is below a step for each length.
    """

    def loss(length: int, pieces: int) -> tuple[float, float, int]:
        steps, most = _steps(length, pieces, step), capacity // length
        alone = 1 - capacity // step // steps * pieces / most
        return max(alone - 2 * LOST, 0), max(steps * step / (pieces * length) - 1, LOST), pieces

    found = []
    for length, n in sorted(counts.items()):
        best = min(loss(length, pieces) for pieces in range(1, max(1, capacity // (2 * length)) + 1))[2]
        whole, rest = divmod(n, best)
        found += [(length, best, whole)] * (whole > 0) + [(length, rest, 1)] * (rest > 0)
    return found


def _steps(length: int, pieces: int, step: int) -> int:
    return -(-length * pieces // step)


def _plan(patterns: list[tuple[dict[int, int], int]], groups: list[tuple[int, int, int]], step: int) -> list[tuple]:
    """For each length, runs of ranks, how they are bundled, and the sequences that take the bundles."""
    waiting: dict[int, list[list[int]]] = {}
    for length, pieces, n in groups:
        waiting.setdefault(_steps(length, pieces, step), []).append([length, pieces, n])
    seen: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        for size, each in pattern.items():
            dealt = 0
            while dealt < each * times:
                group = waiting[size][-1]
                length, pieces, n = group
                now = min(n, each * times - dealt)
                rows.append((length, seen[length], seen[length] + now * pieces, pieces, dealt, each, sequence))
                seen[length] += now * pieces
                dealt += now
                group[2] -= now
                if not group[2]:
                    waiting[size].pop()
        sequence += times
    return rows


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 4096, id_column: str = "doc_id", text_column: str = "text", step: int = STEP, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    A document's ids, with `end_id` after them, are cut at multiples of the capacity only; full
    pieces are sequences of their own. The rests are bundled by equal length (see `bundles`), and
    bundles, in steps of `step` tokens, are what the patterns hold. Returns a row per piece: id, start, length, ids_crc32 (little-endian 32-bit
    ids), doc_tokens, sequence_id (gapless from 0), offset (in its sequence, gapless) and, if
    asked for, the ids as bytes.

    The pieces are written once, without texts; only the histogram of lengths, at most
    `capacity` numbers, comes to the driver, and the patterns over capacity / step sizes go back. Pieces
    are ranked within a length in buckets, so a common length is no hot task. A null text is an
    empty one and has the end id alone; repeated rows are packed as often as they occur; ids
    may be null; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    schema = f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    rows = docs.select(F.col(id_column), F.col(text_column))
    pieces = written(rows.mapInArrow(_pieces(tokenizer_path, end_id, capacity, names, with_ids), schema))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    groups = bundles(histogram, capacity, step)
    demand: Counter = Counter()
    for length, each, n in groups:
        demand[_steps(length, each, step)] += n
    plan = spark.createDataFrame(
        _plan(cutting_patterns(demand, capacity // step), groups, step),
        "_length long, _from long, _to long, _pieces long, _before long, _each long, _sequence long")
    ranked = numbered(pieces, "_rank", ["length"], buckets=1024)
    # Bounded: at most a line for each size of each of capacity / step patterns, and two for each length.
    dealt = ranked.join(
        F.broadcast(plan), (F.col("length") == F.col("_length")) & F.col("_rank").between(F.col("_from"), F.col("_to") - 1),
    ).withColumn("sequence_id", F.expr("_sequence + ((_rank - _from) div _pieces + _before) div _each"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return dealt.select(*names, "sequence_id", F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
