"""Words of many texts at once, as numpy arrays over one byte buffer."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are taken apart at once; one longer text is taken alone.
SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of words without signs: ASCII letters and digits, and all beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Primes below 2^31 and a base for each.
PRIMES = ((2147483647, 1103515245), (2147483629, 1566083941))
#: Bytes of spans that are hashed at once.
BLOCK_BYTES = 1 << 20
_tables = [[np.ones(1, np.uint32), np.ones(1, np.uint32)] for _ in PRIMES]


class Words(NamedTuple):
    """Words are bytes[start:end]; document i has the words first[i] .. first[i + 1] - 1."""

    bytes: np.ndarray
    edges: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most so many bytes, or one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0))
    ends, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, stop
        start = stop


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes, and the edges between the texts; a null is an empty text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[edges[0]:edges[-1]], edges - edges[0]


def words(texts: pa.Array, lower: bool = False, inside: np.ndarray = ~_SPACE) -> Words:
    """Runs of the bytes inside words, all but ASCII white space (space, and 9 to 13) unless
    told otherwise; `lower` changes A-Z only."""
    data, edges = joined(texts)
    if lower:
        data = _LOWER[data]
    inside = inside[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = edges[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start = np.flatnonzero(begins)
    return Words(data, edges, start, np.flatnonzero(ends) + 1, np.searchsorted(start, edges))


def _powers(part: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo a prime, as far as a block of text needs them."""
    prime, base = PRIMES[part]
    if len(_tables[part][0]) < size:
        size = max(size, BLOCK_BYTES + 1)
        for k, step in enumerate((base, pow(base, -1, prime))):
            table = np.ones(1, np.uint64)
            while len(table) < size:
                table = np.concatenate([table, table * np.uint64(pow(step, len(table), prime)) % np.uint64(prime)])
            _tables[part][k] = table[:size].astype(np.uint32)
    return _tables[part][0], _tables[part][1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """62-bit hashes of data[start:end], equal for equal bytes wherever they stand; spans are in order.

    The bytes are digits of numbers modulo two primes. Two texts of n bytes collide for at most n
    of the 2^31 bases of each prime, so no pattern makes words collide whatever the base, as it
    does modulo a power of two. Spans are worked off by blocks of 1 MB, a longer one alone.
    """
    found, at = np.empty(len(start), np.uint64), 0
    while at < len(start):
        low = int(start[at])
        stop = max(at + 1, int(np.searchsorted(end[at:], low + BLOCK_BYTES, "right")) + at)
        found[at:stop] = _block_hash(data[low:int(end[stop - 1])], start[at:stop] - low, end[at:stop] - low)
        at = stop
    return found


def _block_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    parts = []
    for k, (prime, _) in enumerate(PRIMES):
        up, down = _powers(k, len(data) + 1)
        digits = (data.astype(np.uint64) + np.uint64(1)) * up[:len(data)]
        if len(data) > 1 << 24:  # else no sum of 40-bit numbers exceeds 64 bits
            digits %= np.uint64(prime)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(digits, out=sums[1:])
        parts.append((sums[end] - sums[start]) % np.uint64(prime) * down[start] % np.uint64(prime))
    return mixed(parts[0] << np.uint64(32) | parts[1])


def runs_hash(values: np.ndarray, length: int) -> np.ndarray:
    """Hashes of each run of `length` values, at the run's first index."""
    count = len(values) - length + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    result = np.zeros(count, np.uint64)
    for k in range(length):
        result = result * np.uint64(_MULTIPLIER) + values[k:k + count]
    return mixed(result)


def ngram_hash(data: np.ndarray, length: int) -> np.ndarray:
    """32-bit hashes of each run of `length` bytes (at most 4 bytes make no two runs equal)."""
    count = max(len(data) - length + 1, 0)
    result = np.zeros(count, np.uint32)
    for k in range(length):
        result = result * np.uint32(257) + data[k:k + count]
    result = (result ^ (result >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return result ^ (result >> np.uint32(13))
