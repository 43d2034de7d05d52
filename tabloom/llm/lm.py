"""Language-model scores: a hierarchical Pitman-Yor model, seated by Gibbs sampling."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import delete, in_fold, ship
from tabloom.llm.exchange import answered, ask, bucket_bits, bucketed, by_bucket, cuts, gathered, rows_of, unpack, write_chunks
from tabloom.llm.linear import per_document
from tabloom.llm.textbatch import slices, spans_hash, words
from tabloom.storage import scratch_dir

#: Strengths of the context restaurants and the root, and the base measure's share for words
#: that training doesn't have; the rest is even over those that it has.
STRENGTH, ROOT_STRENGTH, UNKNOWN = 5.0, 1.0, 0.5
#: Gibbs sweeps before the first sample, and samples whose predictions are averaged.
BURN_IN, SAMPLES = 2, 3
#: Customers of a dish up to which all numbers of tables are weighed; above, Metropolis steps a sweep.
SMALL, STEPS = 64, 8
CHUNK_BYTES = 8 << 20
#: Contexts that a room is meant to hold. Buckets of words and rooms exchange a message a pair, so
#: there are no more rooms than the contexts need, whatever the number of partitions.
ROOM_CONTEXTS = 1 << 16

_END = spans_hash(np.frombuffer(b"\n", np.uint8), np.array([0]), np.array([1]))  # no word holds a line break


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed object, byte by byte of all numbers, as their upper bytes are mostly alike."""
    planes = [np.ascontiguousarray(a).reshape(-1).view("u1").reshape(-1, a.dtype.itemsize).T.tobytes() for a in arrays]
    return pa.compress(b"".join(planes), "zstd", asbytes=True)


def _parts(data: bytes, *parts: tuple[int, str]) -> list[np.ndarray]:
    """The arrays that were packed together, by their lengths and types."""
    kinds = [np.dtype(k) for _, k in parts]
    raw, ends = unpack(data, sum(n * k.itemsize for (n, _), k in zip(parts, kinds))), np.cumsum([0, *(n * k.itemsize for (n, _), k in zip(parts, kinds))])
    return [
        np.ascontiguousarray(np.frombuffer(raw[a:b], "u1").reshape(k.itemsize, -1).T).reshape(-1).view(k) if b > a else np.zeros(0, k)
        for k, a, b in zip(kinds, ends[:-1], ends[1:], strict=True)]


def _make(columns: list[pa.Array]) -> dict:
    """A chunk: ids, training flags, tokens of each text, and the tokens as codes of its words,
    the most frequent first."""
    ids, texts, train = columns
    keys, counts = [], []
    for start, stop in slices(texts):
        found = words(texts.slice(start, stop - start), lower=True)
        keys.append(np.insert(spans_hash(found.bytes, found.start, found.end), found.first[1:], _END[0]))
        counts.append(found.counts + 1)
    distinct, codes, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return {
        "ids": ids, "train": np.packbits(np.asarray(train.to_numpy(zero_copy_only=False), bool)).tobytes(),
        "counts": np.concatenate(counts).astype("<i8").tobytes(), "keys": distinct[order].astype("<u8").tobytes(), "codes": pack(place[codes].astype("<i4")),
        "times": pack(times[order].astype("<i8")), "tokens": len(codes), "distinct": len(distinct), "last": int(place[np.searchsorted(distinct, _END[0])]),
    }


_FIELDS = "train binary, counts binary, keys binary, codes binary, times binary, tokens long, distinct long, last long"


def _words(row: dict):
    """Each word of a chunk and how often it stands there, for the numbers of words."""
    keys = np.frombuffer(row["keys"], "<u8")
    (times,) = _parts(row["times"], (len(keys), "<i8"))
    order = np.argsort(keys)
    return keys[order], lambda a, b: pack(keys[order[a:b]], times[order[a:b]])


def _ranks(rows: list[dict]) -> list[bytes]:
    """The rank of each word in its bucket, the most frequent first, for each chunk that asks."""
    parts = [_parts(row["data"], (row["size"], "<u8"), (row["size"], "<i8")) for row in rows]
    names, place = np.unique(np.concatenate([keys for keys, _ in parts]), return_inverse=True)
    times = np.zeros(len(names), np.int64)
    np.add.at(times, place, np.concatenate([n for _, n in parts]))
    ranks = np.empty(len(names), "<i8")
    ranks[np.lexsort((names, -times))] = np.arange(len(names))
    ends = np.cumsum([0, *(len(keys) for keys, _ in parts)])
    return [pack(ranks[place[a:b]]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _word_keys(row: dict, bits: int) -> np.ndarray:
    """The key of each word of a chunk: its bucket, in the upper bits, and its rank there."""
    hashes = np.frombuffer(row["keys"], "<u8")
    order, numbers = np.argsort(hashes), by_bucket(row["numbers"])
    keys = np.empty(len(hashes), np.uint64)
    buckets, ends = cuts(hashes[order], bits)
    for b, start, stop in zip(buckets.tolist(), ends[:-1], ends[1:], strict=True):
        (ranks,) = _parts(numbers[b], (int(stop - start), "<i8"))
        keys[order[start:stop]] = ranks.astype(np.uint64) + np.uint64(b << (64 - bits))
    return keys


class _Tokens:
    """A chunk's tokens as places of sorted keys, and for each the token before it in its text."""

    def __init__(self, row: dict, bits: int):
        self.ids = row["ids"]
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.train = np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(self.counts)).astype(bool)
        keys = _word_keys(row, bits)
        order = np.argsort(keys)
        place = np.empty(len(keys), np.int64)
        place[order] = np.arange(len(keys))
        self.keys = keys[order]
        self.codes = place[_parts(row["codes"], (row["tokens"], "<i4"))[0]]
        self.before = np.empty(len(self.codes), np.int64)
        self.before[1:] = self.codes[:-1]
        self.before[self.first[:-1]] = place[row["last"]]  # each text has an end

    def pairs(self) -> np.ndarray:
        """Each token and the one before in one number that sorts like the keys."""
        return self.codes * len(self.keys) + self.before

    def apart(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the tokens of pairs and of those before them."""
        return self.keys[pairs // len(self.keys)], self.keys[pairs % len(self.keys)]

    def training(self) -> np.ndarray:
        return np.repeat(self.train, self.counts)


def _begins(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values of sorted columns begin."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def _encode(keys: np.ndarray, dishes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted (key, restaurant) pairs: number of keys, keys, pairs of each key, restaurants, more."""
    begin = _begins(keys)
    each = np.diff(np.append(begin, len(keys))).astype("<i4")
    return len(begin).to_bytes(4, "little") + pack(keys[begin].astype("<u8"), each, dishes, *columns)


def _decode(data: bytes, pairs: int, *kinds: str) -> tuple:
    """What _encode was given, with the keys' runs: keys, word of each pair, restaurants, more."""
    count = int.from_bytes(data[:4], "little")
    keys, each, *more = _parts(data[4:], (count, "<u8"), (count, "<i4"), *((pairs, k) for k in kinds))
    return keys, np.repeat(np.arange(count), each), *more


def _training_entries(bits: int):
    def entries(row: dict):
        tokens = _Tokens(row, bits)
        pairs, n = np.unique(tokens.pairs()[tokens.training()], return_counts=True)
        keys, contexts = tokens.apart(pairs)
        return keys, lambda a, b: _encode(keys[a:b], contexts[a:b], n[a:b].astype("<i8"))

    return entries


def _asked_entries(bits: int):
    def entries(row: dict):
        tokens = _Tokens(row, bits)
        keys, contexts = tokens.apart(np.unique(tokens.pairs()))
        return keys, lambda a, b: _encode(keys[a:b], contexts[a:b])

    return entries


def _asked_contexts(bits: int):
    def entries(row: dict):
        keys = np.sort(_word_keys(row, bits))
        return keys, lambda a, b: pack(keys[a:b])

    return entries


def _merged(table: pa.Table) -> pa.Table:
    """The counts of one bucket of words, over all chunks, as one row; it numbers its contexts."""
    rows = table.to_pylist()
    keys, contexts, counts = [], [], []
    for row in rows:
        own, word, context, n = _decode(row["data"], row["size"], "<u8", "<i8")
        keys.append(own[word])
        contexts.append(context)
        counts.append(n)
    keys, contexts, counts = np.concatenate(keys), np.concatenate(contexts), np.concatenate(counts)
    order = np.lexsort((contexts, keys))
    keys, contexts = keys[order], contexts[order]
    begin = _begins(keys, contexts)
    counts = np.add.reduceat(counts[order], begin)
    names, dishes = np.unique(contexts[begin], return_inverse=True)
    return pa.table({
        "bucket": pa.array([rows[0]["bucket"]], pa.int32()), "size": pa.array([len(begin)], pa.int64()),
        "data": pa.array([_encode(keys[begin], dishes.astype("<i4"), counts.astype("<i8"))], pa.binary()),
        "restaurants": pa.array([len(names)], pa.int64()), "contexts": pa.array([pack(names.astype("<u8"))], pa.binary())})


class Totals(NamedTuple):
    """Tables and customers of the root, and the draws of what pulls customers to new tables: in
    the root, and in each context restaurant of a bucket."""

    root_tables: float
    root_customers: float
    root_pull: float
    pulls: np.ndarray | None = None


class Settings(NamedTuple):
    """What all buckets need: words, discounts, totals after each sweep."""

    words: int
    discount: float
    root_discount: float
    history: list[Totals]
    seed: int


class State(NamedTuple):
    """Tables of each dish and of each word in the root, and the customers at the largest of them."""

    seated: np.ndarray
    rest: np.ndarray
    tables: np.ndarray
    root_rest: np.ndarray


class Bucket:
    """The dishes of a bucket of words: every customer of a word, in whichever restaurant."""

    def __init__(self, row: dict):
        self.number = row["bucket"]
        self.restaurants = row["restaurants"]
        (self.contexts,) = _parts(row["contexts"], (self.restaurants, "<u8"))
        self.keys, self.word, dish, self.count = _decode(row["data"], row["size"], "<i4", "<i8")
        self.dish = dish.astype(np.int64)
        self.total = np.bincount(self.word, self.count, len(self.keys)).astype(np.int64)

    def root_customers(self, seated: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, seated, len(self.keys)).astype(np.int64)

    def start(self) -> State:
        ones = np.ones(len(self.count), np.int64)
        return State(ones, self.count, np.ones(len(self.keys), np.int64), self.root_customers(ones))

    def root_prediction(self, customers, tables, totals: Totals, settings: Settings) -> np.ndarray:
        base = (1 - UNKNOWN) / max(settings.words, 1)
        mass = customers - settings.root_discount * tables
        return (mass + (ROOT_STRENGTH + settings.root_discount * totals.root_tables) * base) / (totals.root_customers + ROOT_STRENGTH)

    def sweep(self, state: State, k: int, totals: Totals, settings: Settings) -> State:
        """One Gibbs sweep: the root's probabilities, then the tables of all dishes given them,
        then the tables of the root.

        Given the pulls (gamma variables that stand for the restaurants' totals) and the root's
        probabilities, drawn from their law given the tables at hand, dishes are independent, and
        each gets its number of tables from the exact law given its customers. Only the root's
        total mass is not drawn but set to its mean.
        """
        rng = np.random.default_rng([settings.seed, self.number, k])
        base = (1 - UNKNOWN) / max(settings.words, 1)
        root_pull, pulls = totals.root_pull, totals.pulls
        before = self.root_customers(state.seated)
        mass = rng.gamma(before - settings.root_discount * state.tables) + _tilted_stable(len(before), root_pull * base, settings.root_discount, rng)
        above = mass / (totals.root_customers + ROOT_STRENGTH)
        seated, rest = reseat(self.count, pulls[self.dish] * above[self.word], settings.discount, rng, state.seated, state.rest)
        customers = self.root_customers(seated)
        # Metropolis steps start from tables that the new customers allow.
        tables, root_rest = reseat(customers, np.full(len(customers), root_pull * base), settings.root_discount, rng, *_fitted(state, before, customers))
        return State(seated, rest, tables, root_rest)

    def pack_state(self, state: State) -> bytes:
        return pack(state.seated.astype("<i8"), state.rest.astype("<i8"), state.tables.astype("<i8"), state.root_rest.astype("<i8"))

    def unpack_state(self, data: bytes) -> State:
        n, words_ = len(self.count), len(self.keys)
        return State(*_parts(data, (n, "<i8"), (n, "<i8"), (words_, "<i8"), (words_, "<i8")))


def _fitted(state: State, before: np.ndarray, customers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Root tables to go on from: those of the sweep before with the change in customers at the
    largest, or one table for all where that can't be."""
    rest = state.root_rest + customers - before
    fits = (state.root_rest > 0) & (rest > 0)
    return np.where(fits, state.tables, 1), np.where(fits, rest, customers)


def _tilted_stable(n: int, opening: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Masses that new tables have, with Laplace exponent opening / discount ((1 + s)^discount - 1):
    stable variables (Kanter's form), each kept with probability exp(-itself)."""
    found, left = np.zeros(n), np.arange(n)
    while opening > 0 and len(left):
        u = rng.uniform(0, np.pi, len(left))
        shape = np.sin((1 - discount) * u) * np.sin(discount * u) ** (discount / (1 - discount)) / np.sin(u) ** (1 / (1 - discount))
        drawn = (opening / discount) ** (1 / discount) * (shape / rng.exponential(size=len(left))) ** ((1 - discount) / discount)
        kept = rng.random(len(left)) < np.exp(-drawn)
        found[left[kept]] = drawn[kept]
        left = left[~kept]
    return found


@lru_cache(4)
def _ways(discount: float) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers: weights of t tables for n <= SMALL customers."""
    ways = np.zeros((SMALL + 1, SMALL + 1))
    ways[1, 1] = 1
    for n in range(1, SMALL):
        t = np.arange(1, n + 2)
        ways[n + 1, t] = ways[n, t - 1] + np.maximum(n - t * discount, 0) * ways[n, t]
    with np.errstate(divide="ignore"):
        return np.log(ways)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) - sum(np.log(x + k) for k in range(8))


def seat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes that start with one table each."""
    return reseat(customers, opening, discount, rng, np.minimum(customers, 1), customers)[0]


def reseat(customers: np.ndarray, opening: np.ndarray, discount: float, rng: np.random.Generator, tables: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draw the number of tables of each dish given its customers: t tables of n customers weigh
    opening^t times the generalised Stirling number of n, t and the discount.

    Up to SMALL customers the draw is direct (and leaves 0 as `rest`). Above, all tables but the
    largest come from the law without the condition on n, and the largest takes the `rest`;
    Metropolis steps from the tables at hand correct for that, so the law is the same.
    """
    few = customers <= 1
    tables, rest = np.where(few, customers, tables).astype(np.int64), np.where(few, customers, rest).astype(np.int64)
    if discount == 0:  # customers open tables independently
        for n in np.unique(customers[customers > 1]):
            own = np.flatnonzero(customers == n)
            tables[own] = 1 + sum(rng.random(len(own)) < opening[own] / (opening[own] + k) for k in range(1, n))
        return tables, rest
    some = np.flatnonzero((customers > 1) & (customers <= SMALL))
    some = some[np.argsort(customers[some], kind="stable")]
    begin = np.append(_begins(customers[some]), len(some))
    for first, last in zip(begin[:-1], begin[1:]):
        n = int(customers[some[first]])
        for a in range(first, last, 1 << 14):
            own = some[a:min(a + (1 << 14), last)]
            weight = np.log(np.maximum(opening[own], 1e-300))[:, None] * np.arange(1, n + 1) + _ways(discount)[n, 1:n + 1]
            upto = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            tables[own] = 1 + (upto < rng.random((len(own), 1)) * upto[:, -1:]).sum(axis=1)
            rest[own] = 0
    many = np.flatnonzero(customers > SMALL)
    if len(many):
        tables[many], rest[many] = _steps(customers[many], opening[many] / discount, discount, rng, tables[many], rest[many])
    return tables, rest


def _steps(customers, rate, discount, rng, tables, rest):
    """Metropolis steps: the tables but the largest are a Poisson number of Sibuya sizes, thinned
    by tilt^size so that together they have no more than about as many customers as there are."""
    wanted = np.log(customers / (rate * discount))
    low, high = -(np.maximum(wanted, 0) + 1) / (1 - discount) - 1, np.full(len(customers), -1e-9)
    for _ in range(60):
        y = (low + high) / 2
        above = np.log1p(-np.exp(y)) - (1 - discount) * y > wanted
        low, high = np.where(above, y, low), np.where(above, high, y)
    tilt = np.log1p(-np.exp(low))

    def weight(r):
        r = np.maximum(r, 1).astype(float)
        return _log_gamma(r - discount) - _log_gamma(r + 1) + r * tilt

    now = weight(rest)
    for _ in range(STEPS):
        owner = np.repeat(np.arange(len(customers)), rng.poisson(rate))
        p = np.clip(rng.beta(discount, 1 - discount, len(owner)), 1e-18, 1 - 1e-16)
        sizes = 1 + np.floor(np.log(1 - rng.random(len(owner))) / np.log1p(-p))
        kept = rng.random(len(owner)) < np.exp(sizes * tilt[owner])
        owner, sizes = owner[kept], np.minimum(sizes[kept], 1e17)
        t = 1 + np.bincount(owner, minlength=len(customers))
        r = customers - np.bincount(owner, sizes, len(customers))
        # Of equal largest tables any may be the rest.
        ties = 1 + np.bincount(owner, sizes == r[owner], len(customers))
        fits = (r >= 1) & (np.bincount(owner, sizes > r[owner], len(customers)) == 0) & (rng.random(len(t)) * ties < 1)
        then = weight(r)
        taken = fits & (np.log(1 - rng.random(len(t))) < then - now)
        tables, rest, now = np.where(taken, t, tables), np.where(taken, r, rest).astype(np.int64), np.where(taken, then, now)
    return tables, rest


def _start(bucket: Bucket) -> np.ndarray:
    """Customers and dishes of each context, then counts of the root."""
    n = bucket.restaurants
    root = (len(bucket.keys), bucket.total.sum(), len(bucket.dish), (bucket.count == 1).sum(), (bucket.count == 2).sum(), (bucket.total == 1).sum(), (bucket.total == 2).sum())
    return np.concatenate([np.bincount(bucket.dish, bucket.count, n), np.bincount(bucket.dish, minlength=n), root])


def _discount(once: float, twice: float) -> float:
    """The usual estimate from dishes met once and twice, kept inside (0, 1)."""
    return float(min(max(once / max(once + 2 * twice, 1), 0.05), 0.95))


def _sums(bucket: Bucket, state: State) -> np.ndarray:
    """Tables of each context, then tables and customers of the root."""
    return np.concatenate([np.bincount(bucket.dish, state.seated, bucket.restaurants), [state.tables.sum(), state.seated.sum()]])


def _unknown_root(totals: Totals, settings: Settings) -> float:
    return (ROOT_STRENGTH + settings.root_discount * totals.root_tables) / (totals.root_customers + ROOT_STRENGTH) * UNKNOWN


def _sampled(bucket: Bucket, states: list[State], after: list[Totals], settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Root predictions of each word in each sample, and the tables of each dish in all samples together."""
    roots = [bucket.root_prediction(bucket.root_customers(s.seated), s.tables, totals, settings) for s, totals in zip(states, after, strict=True)]
    return np.stack(roots, axis=1), np.sum([s.seated for s in states], axis=0)


#: Messages between buckets of words and of contexts. Rows of a bucket's own have no room (-1).
_MESSAGE = "bucket int, room int, data binary, tables double, customers double"


def _messages(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64())
    return pa.table({n: pa.array(c, k) for n, c, k in zip(("bucket", "room", "data", "tables", "customers"), columns, kinds, strict=True)})


def _uneven(bucket: Bucket) -> np.ndarray:
    """Contexts whose tables in this bucket may change: those with a dish of two customers or more."""
    found = np.zeros(bucket.restaurants, bool)
    found[bucket.dish[bucket.count > 1]] = True
    return found


def _links(bits: int):
    """Model rows to what the rooms start from: contexts, their customers and dishes, and whether they change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                bucket = Bucket(row)
                start, uneven, n = _start(bucket), _uneven(bucket).astype("u1"), bucket.restaurants
                rooms, ends = cuts(bucket.contexts, bits)
                rows = []
                for room, a, b in zip(rooms, ends[:-1], ends[1:], strict=True):
                    rows.append((bucket.number, int(room), pack(bucket.contexts[a:b], start[a:b].astype("<i8"), start[n + a:n + b].astype("<i8"), uneven[a:b]), float(b - a), None))
                yield from _messages(rows).to_batches()

    return run


_ROOM = "room int, size long, links long, data binary, askers binary"


def _room(table: pa.Table) -> pa.Table:
    """A bucket of contexts as one row: contexts, customers, dishes, tables that never change,
    and for each asking bucket the places of its contexts that do."""
    keys, customers, dishes, links = [], [], [], []
    for row in sorted(table.to_pylist(), key=lambda row: row["bucket"]):
        n = int(row["tables"])
        key, c, d, uneven = _parts(row["data"], (n, "<u8"), (n, "<i8"), (n, "<i8"), (n, "u1"))
        keys.append(key)
        customers.append(c)
        dishes.append(d)
        links.append((row["bucket"], uneven.astype(bool)))
    names, place = np.unique(np.concatenate(keys), return_inverse=True)
    total = lambda values: np.bincount(place, np.concatenate(values), len(names)).astype("<i8")
    fixed = total([np.where(uneven, 0, d) for d, (_, uneven) in zip(dishes, links, strict=True)])
    changing = place[np.concatenate([uneven for _, uneven in links])].astype("<i4")
    askers = np.array([(b, uneven.sum()) for b, uneven in links if uneven.any()], "<i8").reshape(-1, 2)
    return pa.table({
        "room": pa.array([table["room"][0].as_py()], pa.int32()), "size": pa.array([len(names)], pa.int64()), "links": pa.array([len(changing)], pa.int64()),
        "data": pa.array([pack(names, total(customers), total(dishes), fixed, changing)], pa.binary()), "askers": pa.array([askers.tobytes()], pa.binary())})


class Room:
    """A bucket of contexts."""

    def __init__(self, row: dict):
        n = row["size"]
        self.number = row["room"]
        self.keys, self.customers, self.dishes, self.fixed, self.changing = _parts(row["data"], (n, "<u8"), (n, "<i8"), (n, "<i8"), (n, "<i8"), (row["links"], "<i4"))
        self.askers = np.frombuffer(row["askers"], "<i8").reshape(-1, 2)


def _drawn(discount: float, seed: int, k: int):
    """Tables that the buckets sent to the totals of the contexts, and the pulls drawn for them."""

    def run(sent: pa.Table, rooms: pa.Table) -> pa.Table:
        room = Room(rooms.to_pylist()[0])
        tables = room.dishes.astype(float)
        if k:
            data = [_parts(row["data"], (int(row["tables"]), "<i8"))[0] for row in sorted(sent.to_pylist(), key=lambda row: row["bucket"])]
            tables = room.fixed + np.bincount(room.changing, np.concatenate([np.zeros(0), *data]), len(room.keys))
        pulls = discount * np.random.default_rng([seed, room.number, k, 1]).gamma(STRENGTH / discount + tables)
        ends = np.concatenate([[0], np.cumsum(room.askers[:, 1])])
        rows = [(-1, room.number, pack(tables.astype("<i8")), None, None)]
        for (bucket, n), a in zip(room.askers.tolist(), ends[:-1]):
            rows.append((bucket, room.number, pack(pulls[room.changing[a:a + n]].astype("<f4")), float(n), None))
        return _messages(rows)

    return run


def _swept(settings: Settings, k: int, bits: int):
    """A sweep of a bucket: its state, and for each room the tables of the contexts that change."""
    totals = settings.history[-1]

    def run(got: pa.Table, model: pa.Table) -> pa.Table:
        bucket = Bucket(model.to_pylist()[0])
        rows = sorted(got.to_pylist(), key=lambda row: row["room"])
        uneven = np.flatnonzero(_uneven(bucket))
        pulls = np.ones(bucket.restaurants)  # of no matter where each dish has one customer
        pulls[uneven] = np.concatenate([np.zeros(0), *[_parts(r["data"], (int(r["tables"]), "<f4"))[0] for r in rows if r["room"] >= 0]])
        before = [bucket.unpack_state(r["data"]) for r in rows if r["room"] < 0]
        state = bucket.sweep(before[0] if before else bucket.start(), k, totals._replace(pulls=pulls), settings)
        sums = _sums(bucket, state)
        out = [(bucket.number, -1, bucket.pack_state(state), *map(float, sums[-2:]))]
        rooms, ends = cuts(bucket.contexts[uneven], bits)
        for room, a, b in zip(rooms, ends[:-1], ends[1:], strict=True):
            out.append((bucket.number, int(room), pack(sums[uneven[a:b]].astype("<i8")), float(b - a), None))
        return _messages(out)

    return run


_ANSWER = "chunk long, bucket int, data binary"


def _answers(rows: list[dict], data: list[bytes], sign: int = 1) -> pa.Table:
    """Buckets of words answer under their number, rooms under -1 - theirs."""
    return pa.table({
        "chunk": pa.array([r["chunk"] for r in rows], pa.int64()), "bucket": pa.array([r["bucket"] if sign > 0 else -1 - r["bucket"] for r in rows], pa.int32()), "data": pa.array(data, pa.binary())})


def _answer(settings: Settings):
    """For each key asked: customers and root predictions; for each pair customers and tables of its dish."""
    after = settings.history[-SAMPLES:]
    unknown = np.array([_unknown_root(t, settings) for t in after])

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        rows = sorted(asked.to_pylist(), key=lambda row: row["chunk"])
        parts = sorted(model.to_pylist(), key=lambda row: row["sample"])
        bucket = Bucket(parts[0]) if parts else None
        if bucket:
            roots, seated = _sampled(bucket, [bucket.unpack_state(p["data"]) for p in parts[1:]], after, settings)
            places = bucket.word * bucket.restaurants + bucket.dish
        data = []
        for row in rows:
            keys, word, contexts = _decode(row["data"], row["size"], "<u8")
            count, chances = np.zeros(len(keys), "<i8"), np.tile(unknown, (len(keys), 1))
            own, tables = np.zeros(len(word), "<i8"), np.zeros(len(word), "<i8")
            if bucket:
                at = np.minimum(np.searchsorted(bucket.keys, keys), len(bucket.keys) - 1)
                known = bucket.keys[at] == keys
                count[known], chances[known] = bucket.total[at[known]], roots[at[known]]
                dish = np.minimum(np.searchsorted(bucket.contexts, contexts), bucket.restaurants - 1)
                pairs = np.flatnonzero(known[word] & (bucket.contexts[dish] == contexts))
                wanted = at[word[pairs]] * bucket.restaurants + dish[pairs]
                found = np.minimum(np.searchsorted(places, wanted), len(places) - 1)
                served = places[found] == wanted
                own[pairs], tables[pairs] = np.where(served, bucket.count[found], 0), np.where(served, seated[found], 0)
            data.append(len(keys).to_bytes(4, "little") + pack(count, chances.astype("<f4"), own, tables))
        return _answers(rows, data)

    return run


def _context_answer(asked: pa.Table, rooms: pa.Table) -> pa.Table:
    """For each context asked: its customers, and its tables in each sample."""
    rows = sorted(asked.to_pylist(), key=lambda row: row["chunk"])
    parts = sorted(rooms.to_pylist(), key=lambda row: row["sample"])
    room = Room(parts[0]) if parts else None
    if room:
        values = np.stack([room.customers, *[_parts(p["data"], (len(room.keys), "<i8"))[0] for p in parts[1:]]], axis=1)
    data = []
    for row in rows:
        (keys,) = _parts(row["data"], (row["size"], "<u8"))
        found = np.zeros((len(keys), 1 + SAMPLES), "<i8")
        if room:
            at = np.minimum(np.searchsorted(room.keys, keys), len(room.keys) - 1)
            known = room.keys[at] == keys
            found[known] = values[at[known]]
        data.append(pack(found))
    return _answers(rows, data, -1)


def _document_scores(row: dict, settings: Settings, bits: int, room_bits: int, tokens_total: int) -> dict:
    tokens = _Tokens(row, bits)
    pairs, which = np.unique(tokens.pairs(), return_inverse=True)
    word, context = pairs // len(tokens.keys), pairs % len(tokens.keys)
    answers = by_bucket(row["answers"])
    counts, roots, own = [np.zeros(0, np.int64)], [np.zeros((0, SAMPLES), "<f4")], [np.zeros(0)]
    buckets, ends = cuts(tokens.keys[word], bits)
    for b, start, stop in zip(buckets, ends[:-1], ends[1:], strict=True):
        n = int.from_bytes(answers[int(b)][:4], "little")
        count, root, customers, tables = _parts(answers[int(b)][4:], (n, "<i8"), (SAMPLES * n, "<f4"), *[(int(stop - start), "<i8")] * 2)
        counts.append(count)
        roots.append(root.reshape(-1, SAMPLES))
        own.append(customers - settings.discount * tables / SAMPLES)
    rooms, ends = cuts(tokens.keys, room_bits)
    found = [_parts(answers[-1 - int(b)], (int(stop - start) * (1 + SAMPLES), "<i8"))[0].reshape(-1, 1 + SAMPLES) for b, start, stop in zip(rooms, ends[:-1], ends[1:], strict=True)]
    found = np.concatenate([np.zeros((0, 1 + SAMPLES), np.int64), *found])
    customers = found[:, 0] + STRENGTH
    shares = (STRENGTH + settings.discount * found[:, 1:]) / customers[:, None]
    count, roots = np.concatenate(counts), np.concatenate(roots)
    chance = np.concatenate(own) / customers[context]
    for k in range(SAMPLES):
        chance += roots[word, k] * shares[context, k] / SAMPLES
    base = np.log10(count + 1.0) - np.log10(float(tokens_total + settings.words + 1))
    return {
        "id": row["ids"], "n_tokens": tokens.counts, "n_known": per_document(count[tokens.codes] > 0, tokens.first).astype(np.int64),
        "base_score": per_document(base[tokens.codes], tokens.first), "score": per_document(np.log10(chance)[which], tokens.first),
    }


class _Sweep(NamedTuple):
    """What a sweep leaves, as two tables: the rows that stay, and those for the next step only."""

    path: str
    stays: DataFrame
    passes: DataFrame


def _kept(rows: DataFrame, stays: Column) -> _Sweep:
    """Write messages; they are compressed already."""
    spark, path = rows.sparkSession, scratch_dir(rows.sparkSession)
    rows.withColumn("stays", stays.cast("int")).write.option("compression", "none").partitionBy("stays").parquet(path)
    table = spark.read.schema(f"{_MESSAGE}, stays int").parquet(path)
    return _Sweep(path, table.where("stays = 1").drop("stays"), table.where("stays = 0").drop("stays"))


def score_documents(docs: DataFrame, train: Column | None = None, id_column: str = "doc_id", text_column: str = "text", seed: int = 1) -> DataFrame:
    """One row per document: id, n_tokens, n_known, train_tokens, base_score and score.

    Tokens are runs of bytes other than ASCII white space, with A-Z lowered, and one end after
    each text. Scores are log10 probabilities of the whole text: base_score by add-one counts,
    score by the model, learned from the rows where `train` holds (all if it is None).

    Every previous token has a restaurant of its own below the root, which has a customer for
    each table there. Dishes lie in buckets of words, restaurants in buckets of contexts
    (rooms). A sweep sends each bucket the pulls of its contexts, drawn in their rooms, and the
    rooms the tables; contexts whose dishes have one customer each are sent once. Tables are
    written after each sweep, so a lost executor changes nothing, and removed when the next step
    that reads them is written.

    A null text is empty and has the end only; without training rows all tokens are unknown;
    ids may be null; rows with one id are documents of their own; an empty table gives an empty
    result. Other columns are not read. Words are told apart by 64-bit hashes, and numbered in
    their buckets by falling frequency, so that pairs of words travel in some 2 bytes a word.
    """
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    flag = F.lit(True) if train is None else F.coalesce(train, F.lit(False))
    chunks = write_chunks(
        docs.select(F.col(id_column), F.col(text_column).alias("text"), flag.alias("train")), _make, f"ids array<{kind}>, {_FIELDS}", CHUNK_BYTES)
    entries = chunks.agg(F.sum("tokens")).first()[0] or 0
    bits, parts = bucket_bits(spark, entries), int(spark.conf.get("spark.sql.shuffle.partitions"))
    numbers = answered(ask(chunks, _words, bits), _ranks).withColumnRenamed("answers", "numbers")
    chunks = chunks.join(bucketed(numbers, "chunk", parts), "chunk")

    model = bucketed(
        ask(chunks, _training_entries(bits), bits).groupBy("bucket").applyInArrow(_merged, "bucket int, size long, data binary, restaurants long, contexts binary"), "bucket", parts)

    def root(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                yield pa.RecordBatch.from_arrays([pa.array([int(v)]) for v in _start(Bucket(row))[-7:]], names=[f"n{k}" for k in range(7)])

    counted = model.mapInArrow(root, ", ".join(f"n{k} long" for k in range(7))).agg(*[F.sum(f"n{k}") for k in range(7)]).first()
    n_words, n_tokens, root_customers, *counts = (n or 0 for n in counted)
    room_bits = min((n_words // ROOM_CONTEXTS).bit_length(), bits)
    rooms = bucketed(model.mapInArrow(_links(room_bits), _MESSAGE).groupBy("room").applyInArrow(_room, _ROOM), "room", parts)
    settings = Settings(n_words, _discount(*counts[:2]), _discount(*counts[2:]), [], seed)
    rng = np.random.default_rng(seed)
    after, states, tables = (n_words, root_customers), [], []
    for k in range(BURN_IN + SAMPLES + 1):
        pull = settings.root_discount * rng.gamma(ROOT_STRENGTH / settings.root_discount + after[0])
        settings = settings._replace(history=[*settings.history, Totals(*after, pull)])
        sent = states[-1].passes if k else spark.createDataFrame([], _MESSAGE)
        drawn = _kept(sent.groupBy("room").cogroup(rooms.groupBy("room")).applyInArrow(_drawn(settings.discount, seed, k), _MESSAGE), F.col("bucket") < 0)
        tables.append(drawn.stays)
        if k:
            delete(spark, f"{states[-1].path}/stays=0")
        if k <= BURN_IN:  # the tables before sample j are those drawn with k = BURN_IN + 1 + j
            delete(spark, f"{drawn.path}/stays=1")
        if k == BURN_IN + SAMPLES:
            break
        got = drawn.passes.unionByName(states[-1].stays) if k else drawn.passes
        states.append(_kept(got.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(_swept(settings, k, room_bits), _MESSAGE), F.col("room") < 0))
        delete(spark, f"{drawn.path}/stays=0")
        if 0 < k <= BURN_IN:
            delete(spark, states[-2].path)
        after = tuple(n or 0 for n in states[-1].stays.agg(F.sum("tables"), F.sum("customers")).first())

    # Of the model: its own rows as sample -1, then what the samples left.
    def with_samples(own: DataFrame, name: str, samples: list[DataFrame]) -> DataFrame:
        for k, rows in enumerate(samples):
            own = own.unionByName(rows.select(name, "data", F.lit(k).alias("sample")), allowMissingColumns=True)
        return own.withColumnRenamed(name, "bucket")

    learned = with_samples(model.withColumn("sample", F.lit(-1)), "bucket", [s.stays for s in states[-SAMPLES:]])
    seated = with_samples(rooms.withColumn("sample", F.lit(-1)), "room", tables[-SAMPLES:]).withColumn("room", F.col("bucket"))
    replies = gathered(
        ask(chunks, _asked_entries(bits), bits).groupBy("bucket").cogroup(learned.groupBy("bucket")).applyInArrow(_answer(settings), _ANSWER)
        .unionByName(ask(chunks, _asked_contexts(bits), room_bits).groupBy("bucket").cogroup(seated.groupBy("bucket")).applyInArrow(_context_answer, _ANSWER)))

    def results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                found = _document_scores(row, settings, bits, room_bits, int(n_tokens))
                yield pa.RecordBatch.from_arrays(
                    [found["id"]] + [pa.array(found[k]) for k in ("n_tokens", "n_known", "base_score", "score")],
                    names=["id", "n_tokens", "n_known", "base_score", "score"])

    done = chunks.join(replies, "chunk", "left").mapInArrow(results, f"id {kind}, n_tokens long, n_known long, base_score double, score double")
    return done.select(F.col("id").alias(id_column), "n_tokens", "n_known", F.lit(int(n_tokens)).cast("long").alias("train_tokens"), "base_score", "score")


def held_out_scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, id_column: str = "doc_id", **more) -> DataFrame:
    """score_documents with held_out, true where crc32 of the id as text leaves the remainder;
    the model learns from the others. A null id counts as empty text."""
    held_out = in_fold(id_column, modulus, remainder)
    scores = score_documents(docs, ~held_out, id_column=id_column, **more)
    return scores.select(id_column, held_out.alias("held_out"), *scores.columns[1:])


def perplexity(scores: DataFrame, *groups: str) -> DataFrame:
    """Perplexity per token of the model and of the base, by the columns given."""
    per = lambda column: F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens"))
    return scores.groupBy(*groups).agg(per("score").alias("perplexity"), per("base_score").alias("base_perplexity"))
