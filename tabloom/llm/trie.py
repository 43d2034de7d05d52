"""Prefix trie of conversations: ternary search trees per range shard, merged at their borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import ship, written

#: Bytes of a coded turn: of the SHA-256 of its role and text, then the code points of its text.
DIGEST, WIDTH = 16, 20
#: Bytes of coded conversations in a shard, counting some for each conversation.
SHARD_BYTES, ROW_BYTES = 2 << 20, 32

NODES = (
    "shard long, shared boolean, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ends string")


def coded(turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """One row per conversation: id (long), turns: its turns in order, 20 bytes each.

    A turn is coded as 16 bytes of the SHA-256 of role and text and the number of code points of
    its text, before anything moves. Turns are ordered by their number, null first; turns of one
    number by their code, so repeated rows are turns of their own. A null role or text is empty.
    Rows without an id belong to no conversation and are left out. The turns of a conversation
    meet in one task. An empty table gives an empty result.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_column, text_column))
    whole = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    code = F.concat(F.substring(F.sha2(whole.cast("binary"), 256), 1, 2 * DIGEST), F.lpad(F.hex(F.char_length(text)), 8, "0"))
    rows = turns.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("_id"), F.struct(F.col(turn_column).isNotNull().alias("known"), F.col(turn_column).alias("turn"), code.alias("code")).alias("_turn"))
    ordered = F.transform(F.sort_array(F.collect_list("_turn")), lambda turn: turn["code"])
    return rows.groupBy("_id").agg(F.unhex(F.array_join(ordered, "")).alias("turns")).withColumnRenamed("_id", id_column)


def head(column: str, turns: Column) -> Column:
    """The first so many turns of a coded conversation."""
    return F.substring(F.col(column), F.lit(1), turns * WIDTH)


def tail(column: str, turns: Column) -> Column:
    """What follows the first so many turns."""
    return F.substring(F.col(column), turns * WIDTH + 1, F.lit((1 << 31) - 1))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations, cut into shards that are numbered in their order."""
    task, number, ids, turns, size = TaskContext.get().partitionId(), 0, [], [], 0

    def shard():
        return pa.RecordBatch.from_arrays([
            pa.array([(task << 32) + number], pa.int64()), pa.array([turns[0]], pa.binary()), pa.array([turns[-1]], pa.binary()),
            pa.array([ids], pa.list_(pa.int64())), pa.array([turns], pa.list_(pa.binary()))], names=["shard", "first", "last", "ids", "turns"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            turns.append(t)
            size += len(t) + ROW_BYTES
            if size >= SHARD_BYTES:
                yield shard()
                number, ids, turns, size = number + 1, [], [], 0
    if ids:
        yield shard()


class TernaryTree:
    """A ternary search tree of sequences of numbers; each node is also a node of their trie.

    `lower` and `higher` lead to siblings with smaller and greater numbers, `inner` to the
    children, `parent` to the node above in the trie.
    """

    def __init__(self):
        self.number, self.parent, self.lower, self.higher, self.inner = [-1], [-1], [-1], [-1], [-1]
        self.depth, self.members, self.least, self.ends = [0], [0], [None], {}

    def _node(self, number: int, parent: int) -> int:
        for field, value in (
                (self.number, number), (self.parent, parent), (self.lower, -1), (self.higher, -1), (self.inner, -1),
                (self.depth, self.depth[parent] + 1), (self.members, 0), (self.least, None)):
            field.append(value)
        return len(self.number) - 1

    def insert(self, sequence: list[int], ids: list[int]) -> None:
        """Add a sequence with its members, smallest first."""
        at = 0
        self._count(at, ids)
        for number in sequence:
            node = self.inner[at]
            if node < 0:
                node = self.inner[at] = self._node(number, at)
            while number != self.number[node]:
                side = self.lower if number < self.number[node] else self.higher
                if side[node] < 0:
                    side[node] = self._node(number, at)
                node = side[node]
            at = node
            self._count(at, ids)
        self.ends[at] = ids

    def _count(self, node: int, ids: list[int]) -> None:
        self.members[node] += len(ids)
        if self.least[node] is None or ids[0] < self.least[node]:
            self.least[node] = ids[0]

    def insert_sorted(self, sequences: list[list[int]], ids: list[list[int]]) -> None:
        """Add distinct sorted sequences, medians first, so that siblings are balanced."""
        ranges = [(0, len(sequences))]
        while ranges:
            low, high = ranges.pop()
            if low < high:
                middle = (low + high) // 2
                self.insert(sequences[middle], ids[middle])
                ranges += [(low, middle), (middle + 1, high)]

    def order(self) -> list[int]:
        """All nodes, each after the node above it in the trie."""
        found, left = [], [0]
        while left:
            node = left.pop()
            found.append(node)
            left += [n for n in (self.lower[node], self.higher[node], self.inner[node]) if n >= 0]
        return found

    def path(self, sequence: list[int]) -> list[int]:
        """The root and the nodes of a sequence that is in the tree."""
        found = [0]
        for number in sequence:
            node = self.inner[found[-1]]
            while number != self.number[node]:
                node = (self.lower if number < self.number[node] else self.higher)[node]
            found.append(node)
        return found


def _codes(turns: bytes) -> list[bytes]:
    return [turns[k:k + WIDTH] for k in range(0, len(turns), WIDTH)]


def _common(a: bytes | None, b: bytes | None) -> int:
    """First turns that two conversations have in common; -1 if there is no such conversation."""
    if a is None or b is None:
        return -1
    count = 0
    for x, y in zip(_codes(a), _codes(b), strict=False):
        if x != y:
            break
        count += 1
    return count


def _keys(turns: bytes, depth: int) -> list[bytes]:
    """Keys of the trie nodes of a conversation down to a depth."""
    state, keys = hashlib.sha256(), []
    for k in range(depth + 1):
        state.update(turns[max(k - 1, 0) * WIDTH:k * WIDTH])
        keys.append(state.copy().digest()[:DIGEST])
    return keys


def _joined(ids: list[int]) -> str:
    return ",".join(map(str, ids))


def shard_nodes(shard: int, ids: list[int], turns: list[bytes], before: bytes | None, after: bytes | None) -> dict[str, list]:
    """The trie nodes of a shard of sorted conversations, as columns of NODES.

    A node that the last conversation before the shard has too is shared to the left, one that
    the first after it has is shared to the right. All figures of a shared node are made so that
    they add up over the shards: a node counts itself as a child, and takes the one member that
    saves nothing, in its first shard only, and as a leaf in its last (conversations that end at
    a node stand before those that go on, so a last shard without children means no children).
    """
    numbers = {code: k for k, code in enumerate(sorted({c for t in turns for c in _codes(t)}))}
    lengths = [int.from_bytes(code[DIGEST:], "big") for code in numbers]
    sequences, members = [], []
    for k, t in enumerate(turns):
        if k and t == turns[k - 1]:
            members[-1].append(ids[k])
        else:
            sequences.append([numbers[c] for c in _codes(t)])
            members.append([ids[k]])
    tree = TernaryTree()
    tree.insert_sorted(sequences, members)

    left, right = _common(before, turns[0]), _common(turns[-1], after)
    on_left = tree.path(sequences[0][:max(left, 0)])[:left + 1]
    on_right = tree.path(sequences[-1][:max(right, 0)])[:right + 1]
    keys = dict(zip(on_left, _keys(turns[0], left), strict=True)) | dict(zip(on_right, _keys(turns[-1], right), strict=True))
    on_left, on_right = set(on_left), set(on_right)

    order = tree.order()
    count = len(order)
    children, leaves, saved = [0] * count, [0] * count, [0] * count
    for node in reversed(order):  # each before the node above it
        if tree.inner[node] < 0 and node not in on_right:
            leaves[node] += 1
        above = tree.parent[node]
        if above >= 0:
            first = node not in on_left
            saved[node] += lengths[tree.number[node]] * (tree.members[node] - first)
            children[above] += first
            leaves[above] += leaves[node]
            saved[above] += saved[node]
    shared = [node in keys for node in order]
    ends = [_joined(tree.ends.get(node, [])) for node in order]
    above = [tree.parent[node] for node in order]
    return {
        "shard": [shard] * count, "shared": shared, "key": [keys.get(node) for node in order], "parent": [keys.get(a) for a in above],
        "depth": [tree.depth[node] for node in order], "conv_id": [tree.least[node] for node in order],
        "parent_conv_id": [tree.least[a] if a >= 0 and a not in keys else None for a in above],
        "n_convs": [tree.members[node] for node in order], "n_children": [children[node] for node in order],
        "n_leaves": [leaves[node] for node in order], "saved_tokens": [saved[node] for node in order],
        "ends_sha256": [None if s else hashlib.sha256(e.encode()).hexdigest() for s, e in zip(shared, ends, strict=True)],
        "ends": [e if s else None for s, e in zip(shared, ends, strict=True)],
    }


_ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = [field.split(" ") for field in NODES.split(", ")]
    for batch in batches:
        for k in range(batch.num_rows):
            found = shard_nodes(*(batch.column(i)[k].as_py() for i in range(5)))
            whole = pa.RecordBatch.from_arrays([pa.array(found[name], _ARROW[kind]) for name, kind in fields], names=[name for name, _ in fields])
            yield from (whole.slice(at, 10_000) for at in range(0, whole.num_rows, 10_000))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of each key, whose parts come in order; only one part is held."""
    key, state, some = None, hashlib.sha256(), False
    for batch in batches:
        done = []
        for k, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if key is not None:
                    done.append((key, state.hexdigest()))
                key, state, some = k, hashlib.sha256(), False
            if part:
                state.update((b"," if some else b"") + part.encode())
                some = True
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.binary()), pa.array([s for _, s in done])], names=["key", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])


def prefix_trie(conversations: DataFrame, id_column: str = "conv_id", turns_column: str = "turns") -> DataFrame:
    """One row per node of the trie of coded conversations (see `coded`).

    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs (members),
    n_children, n_leaves (childless nodes in the subtree), saved_tokens (over the subtree, code
    points of the node's last text for all members but one), ends_sha256 (of the ids of members
    that end at the node, ascending, joined by commas).

    Conversations are sorted by turns and id and cut into shards of some 2 MB, so a conversation
    that a third of the rows repeat is cut into several shards by id. Each shard numbers its turns
    and builds one ternary search tree; nodes that no neighbour has are done there. The others, at
    most a path on either side, are added up over the shards; their lists of members are hashed
    in order from parts of one shard each.

    Each row is a member, also with an id that others have. Null turns are no turns; rows
    without an id are left out. An empty table gives no rows, not even a root. Other columns are
    not read. One conversation, 20 bytes a turn, is held in one piece.
    """
    spark = conversations.sparkSession
    ship(spark)
    rows = written(conversations.where(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.coalesce(F.col(turns_column), F.lit("").cast("binary")).alias("turns")))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = written(rows.repartitionByRange(parts, "turns", "id").sortWithinPartitions("turns", "id").mapInArrow(
        _shards, "shard long, first binary, last binary, ids array<long>, turns array<binary>"))
    # The window sees one row per shard, without its conversations.
    row = Window.orderBy("shard")
    borders = shards.select("shard", F.lag("last").over(row).alias("before"), F.lead("first").over(row).alias("after"))
    nodes = written(shards.select("shard", "ids", "turns").join(borders, "shard").mapInArrow(_trees, NODES))

    shared = nodes.where("shared")
    lists = shared.select("key", "ends", "shard").repartition(parts, "key").sortWithinPartitions("key", "shard").mapInArrow(
        _ends, "key binary, ends_sha256 string")
    sums = shared.groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    merged = written(sums.join(lists, "key"))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = merged.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # Each shard has its own copy of the shared nodes above, so many children of one node are not one key.
    near = shared.select("shard", "key").join(merged.select("key", F.col("conv_id").alias("parent_conv_id")), "key").select(
        "shard", F.col("key").alias("parent"), "parent_conv_id")
    inside = nodes.where("not shared")
    result = (
        inside.where("parent is null").select(*names)
        .unionByName(inside.where("parent is not null").drop("parent_conv_id").join(near, ["shard", "parent"]).select(*names))
        .unionByName(merged.join(above, "parent", "left").select(*names)))
    return result if id_column == "conv_id" else result.withColumnRenamed("conv_id", id_column)
