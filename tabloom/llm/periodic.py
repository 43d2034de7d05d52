"""Periodic runs of words: harmonic-grid candidates extended by a recompressed grammar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ship, text_or_empty
from tabloom.llm.textbatch import Words, slices, words

#: Words that a run has at least, and times that its period fits into it.
LEAST, TIMES = 24, 3
#: Grid points that are looked at, and candidates that are extended, at once.
GRID, EXTENDED = 1 << 20, 1 << 16


class Grammar:
    """A run-length grammar that recompression makes of a sequence, with LCE queries.

    Level 0 is the sequence. Block compression replaces each maximal block of a symbol, pair
    compression each pair of a left and a right symbol (a random half of the symbols each), in
    turns, until no symbol occurs twice in a level: no longer equal parts exist then. Equal parts
    of the sequence are cut alike but for their ends, so a query climbs while both sides stand at
    the same symbol, steps over equal symbols (over blocks as a whole) and goes down where they
    differ. The sequence must begin and end with symbols that occur nowhere else.
    """

    def __init__(self, symbols: np.ndarray):
        rng = np.random.default_rng(len(symbols))
        names = symbols.astype(np.int32)
        self.names, self.parent, self.first, self.size = [names], [], [], [np.ones(len(names), np.int32)]
        self.ahead, self.behind = [], []
        blocks = True
        while True:
            begins = np.ones(len(names), bool)
            if blocks:
                begins[1:] = names[1:] != names[:-1]
                first = np.flatnonzero(begins)
                length = np.diff(np.append(first, len(names)))
                code = names[first].astype(np.int64) << 32 | length
                inside = np.arange(len(names)) - np.repeat(first, length)
                self.behind.append((inside + 1).astype(np.int32))
                self.ahead.append((np.repeat(length, length) - inside).astype(np.int32))
            else:
                left = rng.integers(0, 2, int(names.max()) + 1).astype(bool)[names]
                begins[1:] = ~(left[:-1] & ~left[1:])
                first = np.flatnonzero(begins)
                last = np.append(first[1:], len(names)) - 1
                code = names[first].astype(np.int64) << 32 | np.where(last > first, names[last] + np.int64(1), 0)
                self.behind.append(np.ones(len(names), np.int32))
                self.ahead.append(self.behind[-1])
            self.parent.append((np.cumsum(begins) - 1).astype(np.int32))
            self.first.append(np.append(first, len(names)).astype(np.int32))
            self.size.append(np.add.reduceat(self.size[-1], first).astype(np.int32))
            distinct, names = np.unique(code, return_inverse=True)
            names = names.astype(np.int32)
            self.names.append(names)
            blocks = not blocks
            if len(distinct) == len(names):
                break
        self._flat()

    def _flat(self) -> None:
        """All levels end to end, so that queries at several levels go on together."""
        sizes = [len(n) for n in self.names]
        base = np.concatenate([[0], np.cumsum(sizes)])
        top = sizes[-1]
        index = np.int32 if base[-1] < 1 << 31 else np.int64
        self.above = np.concatenate([*[p.astype(index) + index(b) for p, b in zip(self.parent, base[1:-1], strict=True)], np.full(top, -1, index)])
        self.below = np.concatenate([np.full(sizes[0], -1, index), *[f[:-1].astype(index) + index(b) for f, b in zip(self.first, base[:-2], strict=True)]])
        self.below_last = np.concatenate([np.full(sizes[0], -1, index), *[f[1:].astype(index) + index(b - 1) for f, b in zip(self.first, base[:-2], strict=True)]])
        self.name, self.width = np.concatenate(self.names), np.concatenate(self.size)
        once = np.ones(top, np.int32)
        self.ahead, self.behind = np.concatenate([*self.ahead, once]), np.concatenate([*self.behind, once])
        self.starts, self.ends = np.zeros(base[-1], bool), np.zeros(base[-1], bool)
        self.starts[self.below[sizes[0]:]] = True
        self.ends[self.below_last[sizes[0]:]] = True
        del self.names, self.parent, self.first, self.size

    def extension(self, x: np.ndarray, y: np.ndarray, forward: bool = True) -> np.ndarray:
        """Length of the longest equal parts that begin (or end) at the places x and y, which differ."""
        edge, down, left = (self.starts, self.below, self.ahead) if forward else (self.ends, self.below_last, self.behind)
        x, y, query = x.astype(np.int64), y.astype(np.int64), np.arange(len(x))
        matched = np.zeros(len(x), np.int64)
        while len(x):
            up_x, up_y = self.above[x], self.above[y]
            climb = edge[x] & edge[y] & (self.name[up_x] == self.name[up_y])
            same = ~climb & (self.name[x] == self.name[y])
            steps = np.where(same, np.minimum(left[x], left[y]), 0).astype(np.int64)
            matched[query] += steps * self.width[x]
            if not forward:
                steps = -steps
            lower = ~climb & ~same
            x, y = (np.where(climb, up, np.where(lower, down[p], p + steps)) for p, up in ((x, up_x), (y, up_y)))
            going = x >= 0
            x, y, query = x[going], y[going], query[going]
        return matched


def _identities(found: Words) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    marks = np.zeros(len(found.bytes) + 1, np.int8)
    marks[found.start] += 1
    marks[found.end] -= 1
    data = found.bytes[np.cumsum(marks[:-1], dtype=np.int8).astype(bool)]
    edges = np.concatenate([[0], np.cumsum(found.end - found.start)]).astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), len(found.start), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
    return texts.dictionary_encode().indices.to_numpy().astype(np.int32)


def _grid(symbols: np.ndarray, first: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places g and periods q, in order of q, that may lie in a run: the words at g, g + q and
    g + 2q are equal, and two more words of the stretch between g and g + q.

    A run of three periods or more holds a multiple of its period among its first words, and
    two periods from there.
    """
    counts = counts.astype(np.int64)
    order = np.argsort(-counts, kind="stable")
    longest, starts = counts[order], first[order].astype(np.int64)
    most, period = int(longest[0]) // TIMES, 1
    while period <= most:
        # Pairs of a period and a document that has room for it; documents are sorted by length.
        periods = np.arange(period, min(most, period + (1 << 14)) + 1)
        having = np.searchsorted(-longest, -np.maximum(TIMES * periods, LEAST), "right")
        taken = max(1, int(np.searchsorted(np.cumsum(having), GRID // 8, "right")))
        having, period = having[:taken], period + taken
        q = np.repeat(periods[:taken], having)
        document = np.arange(len(q)) - np.repeat(np.cumsum(having) - having, having)
        points = (longest[document] - 1) // q - 1
        ends = np.concatenate([[0], np.cumsum(points)])
        low = 0
        while low < len(q):
            high = max(low + 1, int(np.searchsorted(ends, ends[low] + GRID, "right")) - 1)
            total = int(ends[high] - ends[low])
            for begin in range(0, total, GRID):  # more than once for one pair only
                stop = min(begin + GRID, total)
                row = np.repeat(np.arange(low, high), points[low:high]) if high > low + 1 else np.full(stop - begin, low)
                step = q[row]
                place = starts[document[row]] + (np.arange(begin, stop) - (ends[row] - ends[low])) * step
                for shift in (lambda q: 0, lambda q: q, lambda q: q // 2, lambda q: q - 1):
                    word = place + shift(step)
                    keep = symbols[word] == symbols[word + step]
                    place, step = place[keep], step[keep]
                if len(place):
                    yield place, step
            low = high


def _sequence(symbols: np.ndarray, first: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen documents with a symbol of its own before, between and after them, and how
    much further right each document's words stand there."""
    parts, shift, at, free = [], np.zeros(len(first) - 1, np.int64), 1, int(symbols.max()) + 1
    for k, document in enumerate(which.tolist()):
        a, b = int(first[document]), int(first[document + 1])
        parts += [np.array([free + k], np.int32), symbols[a:b]]
        shift[document] = at - a
        at += b - a + 1
    return np.concatenate([*parts, np.array([free + len(which)], np.int32)]), shift


def runs_of(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs in documents whose words are the symbols
    first[i]:first[i + 1], by start and period."""
    candidates = _grid(symbols, first, np.diff(first))
    if len(first) > 2:  # a long document alone is not gathered, it may be one run
        several = list(candidates)
        candidates = iter([tuple(map(np.concatenate, zip(*several, strict=True)))] if several else [])
    found, grammar = np.zeros((0, 3), np.int64), None
    for place, step in candidates:
        document = np.searchsorted(first, place, "right") - 1
        if grammar is None:
            which = np.unique(document)
            sequence, shift = _sequence(symbols, first, which)
            grammar = Grammar(sequence)
            # The run found so far that reaches furthest from each word: its end and its period.
            reach, lasts = np.zeros(len(sequence), np.int64), np.ones(len(sequence), np.int64)
        place = place + shift[document]
        for k in range(0, len(place), EXTENDED):
            new = _extended(grammar, place[k:k + EXTENDED], step[k:k + EXTENDED].astype(np.int64), reach, lasts)
            for a, b, p in new.tolist():
                further = np.flatnonzero(reach[a:b] < b) + a
                reach[further], lasts[further] = b, p
            found = np.concatenate([found, new])
    if not len(found):
        return (np.zeros(0, np.int64),) * 3
    found = _distinct(found)
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    # Back to the places in the documents.
    own = which[np.searchsorted(first[which] + shift[which], found[:, 0], "right") - 1]
    return found[:, 0] - shift[own], found[:, 1] - shift[own], found[:, 2]


def _distinct(runs: np.ndarray) -> np.ndarray:
    """One row (start, end, period) for each stretch, with its smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])]


def _extended(grammar: Grammar, g: np.ndarray, q: np.ndarray, reach: np.ndarray, lasts: np.ndarray) -> np.ndarray:
    """The runs (start, end, period) that candidates lie in, but for those known already."""
    # Inside a run of a divisor of q nothing else has period q.
    apart = ~((g + 2 * q < reach[g]) & (q % lasts[g] == 0))
    g, q = g[apart], q[apart]
    ahead = grammar.extension(g, g + q)
    full = ahead >= q
    g, q, ahead = g[full], q[full], ahead[full]
    start, end = g - grammar.extension(g - 1, g + q - 1, forward=False), g + q + ahead
    runs = np.stack([start, end, q], axis=1)[end - start >= np.maximum(LEAST, TIMES * q)]
    return _distinct(runs) if len(runs) else runs


def _collapsed(text: bytes, gone: np.ndarray) -> bytes:
    parts = text.split()
    return b" ".join(parts if not gone.any() else [w for w, g in zip(parts, gone.tolist(), strict=True) if not g])


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, stop in slices(batch.column(1)):
            ids, texts = batch.slice(begin, stop - begin).columns
            found = words(texts)
            start, end, period = runs_of(_identities(found), found.first) if len(found.start) else (np.zeros(0, np.int64),) * 3
            document = np.searchsorted(found.first, start, "right") - 1
            edges = np.searchsorted(document, np.arange(len(ids) + 1))
            steps = np.zeros(len(found.start) + 1, np.int64)
            np.add.at(steps, start + period, 1)
            np.add.at(steps, end, -1)
            gone = np.cumsum(steps[:-1]) > 0
            kept = [_collapsed(t, gone[a:b]) for t, a, b in zip(texts.cast(pa.binary()).to_pylist(), found.first[:-1], found.first[1:], strict=True)]
            runs = pa.StructArray.from_arrays(
                [pa.array(start - found.first[document]), pa.array(end - start), pa.array(period)], names=["start", "length", "period"])
            yield pa.RecordBatch.from_arrays(
                [ids, pa.ListArray.from_arrays(pa.array(edges, pa.int32()), runs), pa.array(kept, pa.binary()).cast(pa.string())],
                names=[batch.schema.names[0], "runs", "collapsed"])


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, runs (start, length, period, by start and period), collapsed.

    Words are runs of bytes other than ASCII white space, numbered from 0. A run is a stretch of
    words with smallest period q and at least max(24, 3q) words that cannot be extended. collapsed
    has the words that no run contains after its first q words, joined by one space.

    For each period the words at its multiples are looked at; where three in a row are equal, the
    stretch is extended both ways by exact queries to a grammar of the texts at hand, which only
    texts with such places enter. Words are compared themselves, not their hashes. Rows are
    judged one by one, in place: nothing is shuffled, and rows with equal ids or texts are returned
    as often as they occur. A null or empty text has no runs and collapses to an empty text; null
    ids are kept. An empty table gives an empty result. Other columns are not read. A task holds
    1 MB of texts at a time, or one longer text with some 100 bytes of memory a word of it.
    """
    ship(docs.sparkSession)
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    found = docs.select(F.col(id_column).alias("id"), text_or_empty(text_column).alias("text")).mapInArrow(
        _found, f"id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return found.select(F.col("id").alias(id_column), "runs", "collapsed")
