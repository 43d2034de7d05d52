"""Removal of repeated word sequences, found by anchors at difference-cover positions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import give_back, ship
from tabloom.llm.exchange import answered, ask, bucket_bits, flags, pack, rows_of, unpack, write_chunks
from tabloom.llm.linear import per_document
from tabloom.llm.textbatch import Words, joined, runs_hash, slices, spans_hash, words

#: Consecutive words that may not be repeated. For any two positions some shift below PERIOD
#: takes both to residues in COVER (the differences of COVER are all residues), so two equal
#: windows share an anchor of ANCHOR words at the same place in both.
WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of an anchor's hash that are sent beside its bucket. Anchors only choose the windows
#: that are compared, so two anchors taken for equal cost time, not correctness.
SENT = 5

#: Bytes of text in a chunk. Hashes and places take some 12 times as much memory.
CHUNK_BYTES = 4 << 20

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_LAST = int(np.iinfo(np.int64).max)


def _make(columns: list[pa.Array]) -> dict:
    """A chunk: ids, columns that are carried along, and the texts end to end."""
    ids, texts, carried = columns
    data, edges = joined(texts)
    total = sum(len(words(texts.slice(start, stop - start)).start) for start, stop in slices(texts))
    return {"ids": ids, "carried": carried, "words": total, "size": len(data), "edges": edges.astype("<i8").tobytes(), "text": pack(data)}


class _Chunk:
    """Words of a chunk: their hashes, the first word of each text, and positions in the text."""

    def __init__(self, row: dict):
        self.ids, self.data = row["ids"], unpack(row["text"], row["size"])
        self.edges = np.frombuffer(row["edges"], "<i8")
        whole = pa.py_buffer(self.data)
        texts = pa.Array.from_buffers(pa.large_string(), len(self.edges) - 1, [None, pa.py_buffer(row["edges"]), whole])
        hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for start, stop in slices(texts):
            found: Words = words(texts.slice(start, stop - start))
            hashes.append(spans_hash(found.bytes, found.start, found.end))
            counts.append(found.counts)
        self.hashes, self.counts = np.concatenate(hashes), np.concatenate(counts)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.document = np.repeat(np.arange(len(self.counts)), self.counts)
        self.position = np.arange(len(self.hashes)) - self.first[self.document]
        self.left = self.counts[self.document] - self.position

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and places of the anchors, by hash."""
        runs = runs_hash(self.hashes, ANCHOR)
        place = np.flatnonzero((self.left[:len(runs)] >= ANCHOR) & _IN_COVER[self.position[:len(runs)] % PERIOD])
        place = place[np.argsort(runs[place], kind="stable")]
        return runs[place], place

    def candidates(self, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows with a repeated anchor, by hash, then id, then start: hash, id, place."""
        steps = np.zeros(len(self.hashes) + 1, np.int64)
        lowest = np.maximum(repeated - (WINDOW - ANCHOR), self.first[self.document[repeated]])
        np.add.at(steps, lowest, 1)
        np.add.at(steps, repeated + 1, -1)
        place = np.flatnonzero((np.cumsum(steps[:-1]) > 0) & (self.left >= WINDOW))
        hashes = runs_hash(self.hashes, WINDOW)[place] if len(place) else np.zeros(0, np.uint64)
        ids = self.ids.fill_null(_LAST).to_numpy()[self.document[place]]
        order = np.lexsort((self.position[place], ids, hashes))
        return hashes[order], ids[order], place[order]


def _firsts(values: np.ndarray) -> np.ndarray:
    """Whether each of the sorted values is the first of its kind."""
    return np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)


def _anchor_entries(row: dict, bits: int):
    hashes, _ = _Chunk(row).anchors()
    first = _firsts(hashes)
    distinct = hashes[first]
    more_than_once = np.diff(np.append(np.flatnonzero(first), len(hashes))) > 1

    def encode(a: int, b: int) -> bytes:
        shift = np.uint64(64 - bits - 8 * SENT)
        sent = (distinct[a:b] >> shift).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SENT]
        return sent.tobytes() + np.packbits(more_than_once[a:b]).tobytes()

    return distinct, encode


def _repeated_anchors(rows: list[dict]) -> list[bytes]:
    """For each chunk, which of its anchors are there twice or more, in it or in all."""
    parts, more = [], []
    for row in rows:
        n = row["size"]
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :SENT] = np.frombuffer(row["data"], np.uint8, n * SENT).reshape(n, SENT)
        parts.append(wide.view("<u8").reshape(-1))
        more.append(np.unpackbits(np.frombuffer(row["data"], np.uint8, offset=n * SENT), count=n).astype(bool))
    values, again = np.concatenate(parts), np.concatenate(more)
    order = np.argsort(values, kind="stable")
    group = np.cumsum(_firsts(values[order])) - 1
    many = (np.bincount(group) > 1) | (np.bincount(group, again[order]) > 0)
    repeated = np.empty(len(values), bool)
    repeated[order] = many[group]
    return _packed(repeated, rows)


def _packed(marks: np.ndarray, rows: list[dict]) -> list[bytes]:
    ends = np.cumsum([row["size"] for row in rows])
    return [np.packbits(part).tobytes() for part in np.split(marks, ends[:-1])]


def _candidates(row: dict, bits: int):
    chunk = _Chunk(row)
    hashes, place = chunk.anchors()
    first = _firsts(hashes)
    distinct = flags(row["answers"], hashes[first], bits)
    return chunk, chunk.candidates(place[distinct[np.cumsum(first) - 1]] if len(place) else place)


def _earliest(rows: list[dict]) -> list[bytes]:
    """For each chunk, which of its windows start where the sequence starts first of all."""
    hashes, ids, starts = [], [], []
    for row in rows:
        n = row["size"]
        data = unpack(row["data"], 20 * n)
        hashes.append(np.frombuffer(data, "<u8", n))
        ids.append(np.frombuffer(data, "<i8", n, 8 * n))
        starts.append(np.frombuffer(data, "<i4", n, 16 * n))
    hashes, ids, starts = np.concatenate(hashes), np.concatenate(ids), np.concatenate(starts)
    order = np.lexsort((starts, ids, hashes))
    first = np.flatnonzero(_firsts(hashes[order]))
    leader = order[first][np.cumsum(_firsts(hashes[order])) - 1]
    least = np.empty(len(hashes), bool)
    least[order] = (ids[order] == ids[leader]) & (starts[order] == starts[leader])
    return _packed(least, rows)


def _removed(chunk: _Chunk, found: tuple, least: np.ndarray) -> np.ndarray:
    """Words covered by a window that is not where its sequence starts first."""
    hashes, ids, place = found
    first = _firsts(hashes)
    head = np.flatnonzero(first)[np.cumsum(first) - 1] if len(hashes) else np.zeros(0, np.int64)
    # Rows with one id are one document: windows at the same start are the same window.
    kept = least[np.cumsum(first) - 1] & (ids == ids[head]) & (chunk.position[place] == chunk.position[place[head]]) if len(hashes) else first
    steps = np.zeros(len(chunk.hashes) + 1, np.int64)
    np.add.at(steps, place[~kept], 1)
    np.add.at(steps, place[~kept] + WINDOW, -1)
    return np.cumsum(steps[:-1]) > 0


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", carry: Sequence[str] | None = None) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256; with `carry`, more.

    Words are runs of bytes other than ASCII white space. Every word goes that is covered by a
    window of 20 words whose sequence also starts earlier: in a smaller id, or at an earlier
    start under the same id. All windows are judged on the input. kept_sha256 is the SHA-256 of
    the kept words with one space between them. With `carry`, a list of other columns, these
    are added as a struct `carried`, and kept_text: the text as it was if nothing was removed,
    else the kept words with one space between them.

    Chunks send anchor hashes, then hashes and places of the windows that have a repeated
    anchor, so a passage costs an entry per chunk however many documents share it. Windows are
    equal if their 64-bit hashes are. Ids must be integers; a null id is later than all others,
    and rows with one id are one document whose windows may start at the same place. Null and
    empty texts have no words; an empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_column} is {kind}; an integer is needed to tell which document is earlier")
    others = F.struct(*carry) if carry else F.struct(F.lit(0).alias("none"))
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"), others.alias("carried"))
    carried = rows.schema["carried"].dataType.simpleString()
    chunks = write_chunks(rows, _make, f"ids array<long>, carried array<{carried}>, words long, size long, edges binary, text binary", CHUNK_BYTES)
    total = chunks.agg(F.sum("words")).first()[0] or 0
    bits = bucket_bits(spark, total * len(COVER) // PERIOD)

    repeated = answered(ask(chunks, lambda row: _anchor_entries(row, bits), bits), _repeated_anchors)
    marked = chunks.join(repeated, "chunk", "left")

    def window_entries(row: dict):
        chunk, (hashes, ids, place) = _candidates(row, bits)
        first = np.flatnonzero(_firsts(hashes))
        distinct, ids, starts = hashes[first], ids[first].astype("<i8"), chunk.position[place[first]].astype("<i4")
        return distinct, lambda a, b: pack(distinct[a:b].astype("<u8"), ids[a:b], starts[a:b])

    least = answered(ask(marked, window_entries, bits), _earliest).withColumnRenamed("answers", "least")

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                chunk, found = _candidates(row, bits)
                hashes = found[0]
                removed = _removed(chunk, found, flags(row["least"], hashes[_firsts(hashes)], bits))
                arrays = [chunk.ids, pa.array(chunk.counts.astype(np.int64)), pa.array(per_document(removed, chunk.first).astype(np.int64))]
                kept, texts = [], []
                for k in range(len(chunk.counts)):
                    text = bytes(chunk.data[chunk.edges[k]:chunk.edges[k + 1]])
                    gone = removed[chunk.first[k]:chunk.first[k + 1]]
                    left = text.split()
                    if gone.any():
                        left = [w for w, g in zip(left, gone.tolist(), strict=True) if not g]
                        text = b" ".join(left)
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                    texts.append(text.decode())
                arrays += [pa.array(kept, pa.string())] + ([pa.array(texts, pa.string()), row["carried"]] if carry else [])
                yield pa.RecordBatch.from_arrays(arrays, names=names)
        give_back()

    names = ["id", "n_words", "n_removed", "kept_sha256"] + (["kept_text", "carried"] if carry else [])
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + (f", kept_text string, carried {carried}" if carry else "")
    done = marked.join(least, "chunk", "left").mapInArrow(results, schema)
    return done.select(F.col("id").cast(kind).alias(id_column), *names[1:])
