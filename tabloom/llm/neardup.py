"""Near-duplicate documents: 64-bit SimHash, candidates by fuzzy hashing with the Golay code."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import ship, text_or_empty, written
from tabloom.llm.textbatch import slices

#: Bits at which fingerprints still link; the keys below are complete for 3, not for more.
LINK_BITS = 3
#: First bit and width of the segments; each is a word of the 23-bit code, short ones with zeros.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
GENERATOR = 0b101011100011  # of the binary [23, 12, 7] Golay code
SHINGLE = 3


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half the XXH64 values of a text's shingles, repeats included."""
    from xxhash import xxh64_intdigest

    parts = text.lower().split()
    if not parts:
        return 0
    line = b" ".join(parts)
    if len(parts) <= shingle:
        return xxh64_intdigest(line, 42)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    count = len(parts) - shingle + 1
    hashes = np.fromiter(
        [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[:count].tolist(), ends[shingle - 1:].tolist(), strict=True)], np.uint64, count)
    ones = np.zeros(64, np.int64)
    for k in range(0, count, 1 << 16):
        bits = np.unpackbits(hashes[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > count, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            ids, texts, digests = batch.slice(start, stop - start).columns
            found = [fingerprint(text) for text in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [ids, digests, pa.array(np.array(found, np.uint64).view(np.int64))], names=[batch.schema.names[0], "digest", "fingerprint"])


def simhash(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, text digest and fingerprint (signed 64-bit numbers) of every row; a null text is empty."""
    ship(docs.sparkSession)
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    text = text_or_empty(text_column)
    return docs.select(F.col(id_column).alias("id"), text, F.xxhash64(text).alias("digest")).mapInArrow(
        _fingerprints, f"id {kind}, digest long, fingerprint long")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the errors of weight 4 or less that have it, lightest first, and how many.

    The code is perfect: the first has weight 3 or less and leads to the nearest codeword, and
    there are five of weight 4 if and only if that weight is 3.
    """
    errors = [0]
    for k in range(23):
        errors += [e | 1 << k for e in errors if e.bit_count() < 4]
    errors = np.array(sorted(errors, key=lambda e: (e.bit_count(), e)), np.int64)
    near, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for e, s in zip(errors, _syndrome(errors), strict=True):
        near[s, count[s]] = e
        count[s] += 1
    return near, count


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64)
    for k in range(22, 10, -1):
        rest = np.where(rest >> k & 1, rest ^ GENERATOR << (k - 11), rest)
    return rest


def codeword_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword of each word; indices of those within 4 bits; how many."""
    near, count = _golay()
    syndromes = _syndrome(words)
    within = (words[:, None] ^ near[syndromes]) >> 11
    return within[:, 0], within, count[syndromes]


def search_keys(fingerprints: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Keys to ask with and keys to be found under, each with the row of its fingerprint.

    Of 3 differing bits, two of the three segments get one each at most. In a segment with one
    differing bit, the codeword nearest to one side is within 3 + 1 bits of the other side. So
    a question has, for each pair of segments, the nearest codeword of the first and all within
    4 bits of the second, an answer the reverse: each linked pair shares a key either way.
    """
    parts = [codeword_indices((fingerprints >> np.uint64(a) & np.uint64((1 << n) - 1)).astype(np.int64)) for a, n in SEGMENTS]
    rows = np.arange(len(fingerprints))
    asked, found = [], []
    for pair, (i, j) in enumerate(PAIRS):
        for (one, many), into, shifts in (((i, j), asked, (12, 0)), ((j, i), found, (0, 12))):
            nearest, (_, within, count) = parts[one][0], parts[many]
            valid = np.arange(6)[None, :] < count[:, None]
            keys = (pair << 24) + (nearest[:, None] << shifts[0]) + (within << shifts[1])
            into.append((keys[valid], np.broadcast_to(rows[:, None], valid.shape)[valid]))
    return tuple(tuple(np.concatenate(x) for x in zip(*side, strict=True)) for side in (asked, found))


def _keyed(asks: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 20_000):
                part = batch.slice(start, 20_000)
                prints = part.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                keys, rows = search_keys(prints)[0 if asks else 1]
                taken = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *taken.columns], names=["key", *batch.schema.names])

    return run


def _keys(prints: DataFrame, asks: bool) -> DataFrame:
    fields = ", ".join(f"{name} {kind}" for name, kind in prints.dtypes)
    return prints.mapInArrow(_keyed(asks), f"key long, {fields}")


def links(prints: DataFrame) -> DataFrame:
    """Enough links (a, b) between distinct fingerprints to connect all that link directly.

    `prints` has the distinct fingerprints and their number of documents. First, each points to
    the most frequent fingerprint that it links to among the heads of its keys: in a dense group
    that is its centre, and costs a row per key. Then all pairs with a common key are compared;
    those that point to the same place, or to one another, are connected already and aren't made.
    """
    heads = _keys(prints, asks=False).groupBy("key").agg(F.max(F.struct("documents", "fingerprint")).alias("head"))
    close = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("head.fingerprint"))) <= LINK_BITS
    pointed = (
        _keys(prints, asks=True).join(heads, "key").where(close)
        .groupBy("fingerprint").agg(F.max("head").alias("head"))
        .select(F.col("fingerprint").alias("_print"), F.col("head.fingerprint").alias("_head"))
    )
    centred = written(
        prints.join(pointed, F.col("fingerprint") == F.col("_print"), "left")
        .select("fingerprint", F.coalesce("_head", "fingerprint").alias("head")))
    left = _keys(centred, asks=True).toDF("key", "a", "a_head")
    right = _keys(centred, asks=False).toDF("key", "b", "b_head")
    apart = (
        (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= LINK_BITS)
        & (F.col("a_head") != F.col("b_head")) & (F.col("a_head") != F.col("b")) & (F.col("b_head") != F.col("a"))
    )
    pairs = left.join(right, (left["key"] == right["key"]) & apart).select("a", "b").distinct()
    stars = centred.where("fingerprint <> head").select(F.col("fingerprint").alias("a"), F.col("head").alias("b"))
    return stars.unionByName(pairs)


def components(edges: DataFrame) -> DataFrame:
    """Node and root (the smallest node of its component) of every node that is not a root itself.

    Alternating large and small stars: neighbours are handed to the smallest neighbour until
    every component is a star. Each round is a written table, so a lost executor costs a round
    at most and plans stay short.
    """
    edges = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select("a", F.col("m").alias("b")).unionByName(met.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        edges = written(small.distinct())
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if tuple(state) == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = tuple(state)


def classes(marked: DataFrame) -> DataFrame:
    """Fingerprint, root (of its component) and least_id of every distinct fingerprint."""
    prints = written(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("documents"), F.min("id").alias("least_id")))
    roots = components(links(prints.select("fingerprint", "documents")))
    return prints.join(roots, prints["fingerprint"] == roots["node"], "left").select(
        "fingerprint", "least_id", F.coalesce("root", "fingerprint").alias("root"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in 3 bits or fewer are linked; component_id is the
    smallest id that can be reached over links, the document itself included. Copies meet in
    one row before fingerprints are compared, so a large group of copies costs one fingerprint.
    A null or empty text has fingerprint zero, linked like any other. Rows with the same id are
    documents of their own; a null id is never the smallest, and a component of null ids only
    has a null component_id. An empty table gives an empty result. Other columns are not read.
    """
    marked = written(simhash(docs, id_column, text_column))
    members = classes(marked)
    smallest = members.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = members.join(smallest, "root").select("fingerprint", "component_id")
    return marked.join(found, "fingerprint").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def without_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, with one document of each component: the smallest id,
    and of rows with that id the smallest text digest, once. Null ids come last."""
    marked = written(simhash(docs, id_column, text_column))
    stays = (
        marked.join(classes(marked).select("fingerprint", "root"), "fingerprint")
        .groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "digest")).alias("_stays"))
        .select(F.col("_stays.id").alias("_stays_id"), F.col("_stays.digest").alias("_stays_digest"))
    )
    keyed = docs.withColumn("_stays_key", F.xxhash64(text_or_empty(text_column)))
    same = F.col(id_column).eqNullSafe(F.col("_stays_id")) & (F.col("_stays_key") == F.col("_stays_digest"))
    kept = keyed.join(stays, same, "left_semi")
    # Whole rows move once more only if there are rows equal in id and text.
    if not marked.groupBy("id", "digest").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([id_column, "_stays_key"])
    return kept.select(*[f"`{c}`" for c in docs.columns])
