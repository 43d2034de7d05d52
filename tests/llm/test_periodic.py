"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabloom.llm import periodic, queries

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def slow_runs(words):
    """All runs, by trying each period over the whole text; the smallest period of each stretch."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and words[end] == words[end - q]:
                end += 1
            if end - start >= max(24, 3 * q):
                found.setdefault((start, end), q)
            start = end - q + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_collapsed(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def fast_runs(words, others=()):
    texts = [list(words), *map(list, others)]
    names = {w: k for k, w in enumerate(dict.fromkeys(w for t in texts for w in t))}
    symbols = np.array([names[w] for t in texts for w in t], np.int32)
    first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    found = [[] for _ in texts]
    if len(symbols):
        for s, e, q in zip(*map(np.ndarray.tolist, periodic.runs_of(symbols, first)), strict=True):
            d = int(np.searchsorted(first, s, "right")) - 1
            found[d].append((s - int(first[d]), e - s, q))
    return found


@st.composite
def periodic_texts(draw):
    """Texts of few words with planted repetitions, some nested or next to one another."""
    parts, alphabet = [], draw(st.integers(1, 4))
    for _ in range(draw(st.integers(1, 4))):
        unit = draw(st.lists(st.integers(0, alphabet), min_size=1, max_size=9))
        parts += unit * draw(st.integers(1, 12))
        parts = parts[draw(st.integers(0, 3)):]
        if draw(st.booleans()):
            parts = parts * draw(st.integers(1, 4))
    return parts[:400]


@settings(max_examples=300, deadline=None)
@given(st.lists(periodic_texts(), min_size=1, max_size=4))
def test_runs_against_brute_force(texts):
    assert fast_runs(texts[0], texts[1:]) == [slow_runs(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(periodic_texts(), st.integers(0, 10_000))
def test_grammar_extensions(text, seed):
    words = np.array([99, *text, 98], np.int32)
    grammar, rng = periodic.Grammar(words), np.random.default_rng(seed)
    x = rng.integers(0, len(words), 60)
    y = rng.integers(0, len(words), 60)
    x, y = x[x != y], y[x != y]
    ahead, behind = grammar.extension(x, y), grammar.extension(x, y, forward=False)
    for a, b, f, g in zip(x.tolist(), y.tolist(), ahead.tolist(), behind.tolist(), strict=True):
        n = 0
        while max(a, b) + n < len(words) and words[a + n] == words[b + n]:
            n += 1
        m = 0
        while min(a, b) - m >= 0 and words[a - m] == words[b - m]:
            m += 1
        assert (f, g) == (n, m)


@pytest.mark.parametrize("words, runs", [
    ([], []), ("a" * 23, []), ("a" * 24, [(0, 24, 1)]), ("ab" * 12, [(0, 24, 2)]), ("ab" * 11 + "a", []),
    ("x" + "abcdefghi" * 3, [(1, 27, 9)]), ("abcdefghi" * 3 + "a", [(0, 28, 9)]), ("abcdefghi" * 2 + "abcdefgh", []),
    ("a" * 30 + "b" * 30, [(0, 30, 1), (30, 30, 1)]),
])
def test_bounds(words, runs):
    assert fast_runs(words) == [runs]


def test_one_long_run(monkeypatch):
    """A long text of one word and a long text of two, cut into many parts."""
    monkeypatch.setattr(periodic, "GRID", 1 << 10)
    monkeypatch.setattr(periodic, "EXTENDED", 1 << 8)
    assert fast_runs("a" * 20_000) == [[(0, 20_000, 1)]]
    assert fast_runs("b" + "ab" * 9_000 + "cc") == [[(0, 18_001, 2)]]
    texts = ["a" * 300 + "b", "ab" * 100 + "abc" * 50, "abcd" * 40]
    assert fast_runs(texts[0], texts[1:]) == [slow_runs(t) for t in texts]


def test_a_million_words():
    rng = np.random.default_rng(5)
    symbols = rng.integers(0, 50_000, 1_000_000).astype(np.int32)
    symbols[300_000:700_000] = np.resize(symbols[300_000:400_000], 400_000)
    start, end, period = periodic.runs_of(symbols, np.array([0, len(symbols)]))
    assert period.tolist() == [100_000] and start[0] <= 300_000 and end[0] >= 700_000


def expected(rows):
    found = []
    for i, text in rows:
        words = SPACE.findall((text or "").encode())
        runs = slow_runs(words)
        found.append((i, runs, b" ".join(slow_collapsed(words, runs)).decode()))
    return found


def order(row):
    return (row[0] is None, row[0], row[2])


def test_operator(spark, docs, none):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect() if r["text"] is None or len(r["text"]) < 10_000]
    rows += [(30, "go " * 40 + "stop " + "a\tb\n" * 20), (31, "É é " * 15)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r[0], [tuple(x) for x in r[1]], r[2]) for r in periodic.periodic_runs(df).collect()]
    assert sorted(found, key=order) == sorted(expected(rows), key=order)
    assert periodic.periodic_runs(none).collect() == []
    whole = periodic.periodic_runs(docs)  # a text of 30,000 words and columns of other names
    assert whole.count() == docs.count()


def planted(i, text):
    words = SPACE.findall((text or "").encode())
    h, n = zlib.crc32(str(i).encode()), len(words)
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = {r["doc_id"]: r for r in queries.op12_recompression(spark, sf).collect()}
    assert len(found) == len(docs) and sum(r["n_runs"] for r in found.values()) > 10
    for i, text in docs:
        words = planted(i, text)
        runs = slow_runs(words)
        best = None
        for run in runs:
            if best is None or run[1] * best[2] > best[1] * run[2]:
                best = run
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        row = found[i]
        assert row["n_runs"] == len(runs)
        assert (row["start"], row["length"], row["period"]) == (best or (None, None, None))
        assert row["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert row["runs_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(slow_collapsed(words, runs))).hexdigest()
