"""Prefix trie of conversations against SQL and plain Python."""

import hashlib
import random

import oracle
from pyspark.sql import functions as F

from tabloom.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def slow(rows):
    """Nodes of the trie of (id, sequence of (role, text))."""
    members = {}
    for i, turns in rows:
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append((i, len(turns) == d))
    own = lambda node: (len(members[node]) - 1) * len(node[-1][1]) if node else 0
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    below = {node: [(0 if node in kids else 1), own(node)] for node in members}
    for node in sorted(members, key=len, reverse=True):
        if node:
            for k in (0, 1):
                below[node[:-1]][k] += below[node][k]
    least = {node: min(i for i, _ in m) for node, m in members.items()}
    return sorted(
        (least[node], len(node), least[node[:-1]] if node else -1, len(m), len(kids.get(node, [])), *below[node],
         hashlib.sha256(",".join(map(str, sorted(i for i, end in m if end))).encode()).hexdigest())
        for node, m in members.items())


def conversations(rows, seed=0):
    """Random conversations with common beginnings; copies, prefixes of one another, and one long."""
    rng = random.Random(seed)
    found = []
    for i in rng.sample(range(-50, 5_000), rows):
        length = rng.choice([0, 1, 2, 3, 5, 7])
        found.append((i, [(rng.choice(["user", "assistant"]), "word " * rng.randrange(2)) for _ in range(length)]))
    copied = [("user", "the same"), ("", "\U0001f600 reply")]
    found += [(10_000 + k, copied) for k in range(rows // 3)] + [(20_000, copied + [("user", f"turn {k}") for k in range(300)])]
    return found


def frame(spark, rows):
    turns = [(i, k, role, text) for i, turns in rows for k, (role, text) in enumerate(turns)]
    random.Random(1).shuffle(turns)
    return spark.createDataFrame(turns, SCHEMA).repartition(5)


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def test_against_plain_python(spark, monkeypatch):
    rows = [r for r in conversations(300) if r[1]]
    turns = frame(spark, rows)
    assert got(trie.prefix_trie(trie.coded(turns))) == slow(rows)


def test_borders_of_shards():
    """All figures add up over shards cut anywhere."""
    rows = sorted(((i, b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] + len(t[1]).to_bytes(4, "big") for t in turns), turns) for i, turns in conversations(120, 3)), key=lambda r: (r[1], r[0]))
    want = {(n[0], n[1]): n for n in slow([(i, turns) for i, _, turns in rows])}
    for cut in (1, 2, 3, 17, 50, 1000):
        parts = [rows[k:k + cut] for k in range(0, len(rows), cut)]
        done, shared = [], {}
        for k, part in enumerate(parts):
            found = trie.shard_nodes(k, [r[0] for r in part], [r[1] for r in part], parts[k - 1][-1][1] if k else None, parts[k + 1][0][1] if k + 1 < len(parts) else None)
            for values in zip(*found.values(), strict=True):
                node = dict(zip(found, values, strict=True))
                if node["shared"]:
                    shared.setdefault(node["key"], []).append(node)
                else:
                    done.append((node["conv_id"], node["depth"], node["n_convs"], node["n_children"], node["n_leaves"], node["saved_tokens"], node["ends_sha256"]))
        for nodes in shared.values():
            ends = ",".join(n["ends"] for n in nodes if n["ends"])
            done.append((min(n["conv_id"] for n in nodes), nodes[0]["depth"], *[sum(n[c] for n in nodes) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], hashlib.sha256(ends.encode()).hexdigest()))
        assert sorted(done) == sorted((n[0], n[1], *n[3:]) for n in want.values())


def test_shards_on_spark(spark, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_BYTES", 1 << 10)
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        rows = conversations(200, 7)
        plain = spark.createDataFrame([(i, b"".join(hashlib.sha256(repr(t).encode()).digest()[:16] + len(t[1]).to_bytes(4, "big") for t in turns)) for i, turns in rows], "conv_id long, turns binary")
        assert got(trie.prefix_trie(plain)) == slow(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_edges(spark):
    rows = [
        (1, 2, "user", "b"), (1, None, "user", "first"), (1, 1, None, None), (2, None, "user", "first"), (2, 5, "", ""), (2, 7, "user", "b"),
        (3, 1, "user", "same"), (3, 1, "user", "same"), (None, 1, "user", "nobody"), (4, 1, "use", "rsame"), (-1, 1, "user", "é" * 5000)]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("turns", "code", "key", "shard", "depth", "_id", "_turn")})
    same = [("user", "first"), ("", ""), ("user", "b")]
    want = [(1, same), (2, same), (3, [("user", "same")] * 2), (4, [("use", "rsame")]), (-1, [("user", "é" * 5000)])]
    assert got(trie.prefix_trie(trie.coded(turns))) == slow(want)
    assert trie.prefix_trie(trie.coded(turns.limit(0))).collect() == []
    empty = spark.createDataFrame([(7, None), (7, b""), (None, b"")], "conv_id int, turns binary")
    assert got(trie.prefix_trie(empty)) == [(7, 0, -1, 2, 0, 1, 0, hashlib.sha256(b"7,7").hexdigest())]


def test_tree_is_balanced():
    tree = trie.TernaryTree()
    tree.insert_sorted([[k] for k in range(1023)], [[k] for k in range(1023)])
    deepest, left = 0, [(tree.inner[0], 1)]
    while left:
        node, depth = left.pop()
        deepest = max(deepest, depth)
        left += [(n, depth + 1) for n in (tree.lower[node], tree.higher[node]) if n >= 0]
    assert deepest == 10


def test_query(spark, sf):
    for folder in (sf, sf.replace("0.001", "0.01")):
        found = queries.op13_prefix_trie(spark, folder)
        assert oracle.difference(found, oracle.connect(folder), queries.OP13_SQL) is None
