"""Documents in chunks that ask buckets of hashes and get their answers back.

A chunk is a few megabytes of documents, written once as one row. It sends each of its
distinct hashes once, sorted, to the bucket of the hash, so a passage or word that stands in a
third of all documents costs one entry per chunk; a bucket answers each chunk in the order of
its entries. Chunks lie in a table bucketed by chunk, so answers move and texts don't.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import give_back
from tabloom.llm.encoding import forget
from tabloom.llm.textbatch import slices
from tabloom.storage import scratch_dir

#: Bytes of text in a chunk, and entries that a bucket is meant to hold.
CHUNK_BYTES = 8 << 20
BUCKET_ENTRIES = 1 << 20


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed object."""
    return pa.compress(b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), "zstd", asbytes=True)


def unpack(data: bytes, size: int) -> memoryview:
    return memoryview(pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True)) if size else memoryview(b"")


def bucketed(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows as a table in the shared folder, bucketed by the key: joins by it don't move them."""
    spark, name = rows.sparkSession, f"tabloom_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).option("path", scratch_dir(spark)).option("compression", "none").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the entry only; the files stay for the frame
    return table


def write_chunks(docs: DataFrame, make: Callable, fields: str, most: int = CHUNK_BYTES) -> DataFrame:
    """A row per chunk of (id, text, ...) rows: chunk, and what `make(columns)` returns for it."""
    spark = docs.sparkSession
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0

        def chunk():
            columns = pa.Table.from_batches(held).combine_chunks()
            made = make([columns.column(k).chunk(0) for k in range(columns.num_columns)])
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number], pa.int64())] + [_one(made[n]) for n in names], names=["chunk", *names])

        for batch in batches:
            for start, stop in slices(batch.column(1), max(most // 4, 1)):
                part = batch.slice(start, stop - start)
                held.append(part)
                size += part.nbytes
                if size >= most:
                    yield chunk()
                    held, size, number = [], 0, number + 1
        if held:
            yield chunk()
        held.clear()
        give_back()

    rows = docs.mapInArrow(run, f"chunk long, {fields}")
    return bucketed(rows, "chunk", int(spark.conf.get("spark.sql.shuffle.partitions")))


def _one(value) -> pa.Array:
    """A column of one row; an array is a row's list."""
    if isinstance(value, pa.Array):
        return pa.ListArray.from_arrays(pa.array([0, len(value)], pa.int32()), value)
    return pa.array([value])


def bucket_bits(spark, entries: int) -> int:
    """Bits of a hash that name its bucket: enough for even tasks and buckets of bounded size."""
    wanted = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), entries // BUCKET_ENTRIES, 1)
    return min((wanted - 1).bit_length(), 24)


def cuts(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (leading bits) that sorted hashes fall into, and the first entry of each, with the end."""
    buckets = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    firsts = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.zeros(0, np.int64)
    return buckets[firsts], np.append(firsts, len(hashes))


def ask(chunks: DataFrame, entries: Callable, bits: int) -> DataFrame:
    """Rows (bucket, chunk, size, data). `entries(row)` gives sorted hashes and a function that
    makes (entries, data) of a range of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                hashes, encode = entries(row)
                buckets, ends = cuts(hashes, bits)
                data = [encode(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(buckets.astype(np.int32)), pa.array([row["chunk"]] * len(buckets), pa.int64()),
                    pa.array([int(b - a) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()), pa.array(data, pa.binary()),
                ], names=["bucket", "chunk", "size", "data"])
        give_back()

    return chunks.mapInArrow(run, "bucket int, chunk long, size long, data binary")


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """One row at a time as Python values; lists of ids and other columns stay arrays."""
    for k in range(batch.num_rows):
        row = {name: batch.column(i)[k] for i, name in enumerate(batch.schema.names)}
        yield {name: value.values if name in ("ids", "carried") else value.as_py() for name, value in row.items()}


def answered(asked: DataFrame, answer: Callable) -> DataFrame:
    """A row per chunk: chunk, and its answers as an array of (bucket, data).

    `answer(rows)` gets the rows of one bucket, at most one per chunk, and returns one object
    for each.
    """

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda row: row["chunk"])
        return pa.table({
            "chunk": pa.array([row["chunk"] for row in rows], pa.int64()), "bucket": pa.array([row["bucket"] for row in rows], pa.int32()),
            "data": pa.array(answer(rows), pa.binary())})

    return gathered(asked.groupBy("bucket").applyInArrow(run, "chunk long, bucket int, data binary"))


def gathered(answers: DataFrame) -> DataFrame:
    return answers.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "data")).alias("answers"))


def by_bucket(answers: list[dict] | None) -> dict[int, bytes]:
    return {a["bucket"]: a["data"] for a in answers or []}


def flags(answers: list[dict] | None, hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bits that the buckets answered, in the order of the hashes asked for."""
    found = by_bucket(answers)
    buckets, ends = cuts(hashes, bits)
    parts = [np.unpackbits(np.frombuffer(found[int(b)], np.uint8), count=int(stop - start)) for b, start, stop in zip(buckets, ends[:-1], ends[1:], strict=True)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)
