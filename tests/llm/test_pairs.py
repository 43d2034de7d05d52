"""Near duplicates, repeated passages and benchmark passages against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash

from conftest import words
from tabloom.llm import decontaminate, neardup, substrings

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def split(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = bytes(c + 32 if 65 <= c <= 90 else c for c in data)
    return SPACE.findall(data)


def key(row):
    return tuple((value is None, value) for value in row)


def same(found, expected):
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)


# --- near duplicates

def slow_fingerprint(text):
    parts = split(text, lower=True)
    if not parts:
        return 0
    runs = [b" ".join(parts[k:k + 3]) for k in range(max(1, len(parts) - 2))]
    hashes = [xxhash.xxh64_intdigest(run, 42) for run in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    """Root of each distinct fingerprint, by comparing all pairs."""
    distinct = sorted(set(prints))
    root = {p: p for p in distinct}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for k, p in enumerate(distinct):
        for q in distinct[k + 1:]:
            if (p ^ q).bit_count() <= 3:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in distinct}


def slow_near_duplicates(rows):
    prints = [slow_fingerprint(text) for _, text in rows]
    roots = slow_components(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    return [(i, f"{p:016x}", least.get(roots[p])) for (i, _), p in zip(rows, prints)]


def pairs_of(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_near_duplicates(spark, docs, none):
    same(neardup.near_duplicates(docs).collect(), slow_near_duplicates(pairs_of(docs, "doc_id", "text")))
    assert neardup.near_duplicates(none).collect() == []


def test_near_duplicates_of_the_table(labelled):
    same(neardup.near_duplicates(labelled[0]).collect(), slow_near_duplicates(pairs_of(labelled[0], "doc_id", "text")))


def test_golay_code():
    near, count = neardup._golay()
    assert (np.bitwise_count(near[:, 0].astype(np.uint64)) <= 3).all() and set(count) == {1, 6}
    rng = np.random.default_rng(0)
    some = rng.integers(0, 1 << 23, 200)
    first, within, n = neardup.codeword_indices(some)
    everything = np.arange(1 << 23)
    codewords = everything[neardup._syndrome(everything) == 0]
    assert len(codewords) == 4096
    for word, index, indices, k in zip(some, first, within, n):
        distance = np.bitwise_count((codewords ^ word).astype(np.uint64))
        assert set(indices[:k]) == set(codewords[distance <= 4] >> 11)
        assert index == codewords[distance.argmin()] >> 11


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_linked_fingerprints_share_a_key_either_way(bits):
    rng = np.random.default_rng(bits)
    one = rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    other = one.copy()
    for k in range(len(one)):
        for b in rng.choice(64, bits, replace=False):
            other[k] ^= np.uint64(1) << np.uint64(b)
    for a, b in ((one, other), (other, one)):
        asked, found = neardup.search_keys(a)[0], neardup.search_keys(b)[1]
        linked = set(zip(*map(np.ndarray.tolist, asked))) & set(zip(*map(np.ndarray.tolist, found)))
        assert {row for _, row in linked} == set(range(len(one)))


def test_dense_groups_are_connected_without_all_pairs(spark):
    rng = np.random.default_rng(3)
    prints = set()
    for centre in rng.integers(0, 1 << 63, 4, dtype=np.int64).tolist():
        prints.add(centre)
        prints |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 62, (300, 2))}
    prints = sorted(prints)
    table = spark.createDataFrame([(p, 1 + (k % 7)) for k, p in enumerate(prints)], "fingerprint long, documents long")
    edges = neardup.links(table)
    found = {r["node"]: r["root"] for r in neardup.components(edges).collect()}
    assert {p: found.get(p, p) for p in prints} == slow_components(prints)
    assert edges.count() < 20 * len(prints)


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)}


def test_one_document_of_each_component_stays(docs, none):
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = pairs_of(docs, "doc_id", "text")
    prints = {slow_fingerprint(text) for _, text in rows}
    roots = slow_components(prints)
    stay = pairs_of(kept, "doc_id", "text")
    assert len(stay) == len(set(roots.values()))
    assert {roots[slow_fingerprint(text)] for _, text in stay} == set(roots.values())
    assert (1 in [i for i, _ in stay]) and (2 not in [i for i, _ in stay])
    assert neardup.without_near_duplicates(none).collect() == []


# --- repeated passages

def slow_removal(rows):
    """Windows by their place (id, start), a null id last; rows of one id share their places."""
    first = {}
    for i, text in rows:
        parts = split(text)
        for s in range(len(parts) - 19):
            at = ((i is None, i or 0), s)
            run = tuple(parts[s:s + 20])
            first[run] = min(first.get(run, at), at)
    result = []
    for i, text in rows:
        parts = split(text)
        gone = [False] * len(parts)
        for s in range(len(parts) - 19):
            if first[tuple(parts[s:s + 20])] != ((i is None, i or 0), s):
                gone[s:s + 20] = [True] * 20
        left = b" ".join(w for w, g in zip(parts, gone) if not g)
        result.append((i, len(parts), sum(gone), hashlib.sha256(left).hexdigest()))
    return result


def test_removed_repeats(docs, none):
    same(substrings.remove_repeats(docs).collect(), slow_removal(pairs_of(docs, "doc_id", "text")))
    assert substrings.remove_repeats(none).collect() == []


@pytest.mark.parametrize("chunk", [200, 1 << 23])
def test_removed_repeats_across_chunks(spark, labelled, monkeypatch, chunk):
    monkeypatch.setattr("tabloom.llm.substrings.CHUNK_BYTES", chunk)
    small = labelled[0].where("doc_id < 60") if chunk == 200 else labelled[0]
    same(substrings.remove_repeats(small).collect(), slow_removal(pairs_of(small, "doc_id", "text")))


def test_every_alignment_and_length(spark):
    """Shared runs of 19, 20 and 21 words at every residue of the period in both documents."""
    rows, i = [], 0
    for n in (19, 20, 21):
        for a in range(13):
            for b in (0, 5, 11):
                run = words(n, f"s{n}.{a}.{b}.")
                rows += [(i, f"{words(a, f'a{i}.')} {run} {words(3, f'b{i}.')}"), (i + 1, f"{words(b, f'c{i}.')} {run} {words(2, f'd{i}.')}")]
                i += 2
    found = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    same(found.collect(), slow_removal(rows))
    assert found.where("n_removed > 0").count() == 2 * 13 * 3


def test_difference_cover():
    period, cover = substrings.PERIOD, substrings.COVER
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))
    assert substrings.ANCHOR + period - 1 == substrings.WINDOW


def test_carried_columns_and_kept_text(docs):
    carry = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = substrings.remove_repeats(docs, carry=carry).collect()
    by_text = {(r["doc_id"], r["n_removed"] == 0): r for r in rows}
    assert by_text[1, True]["kept_text"].startswith("The quick brown fox")
    assert by_text[15, True]["kept_text"] == "same line\nsame line\n\n\nsame line\nother"
    assert by_text[10, False]["kept_text"] == "before two two"  # "after" ends a run that document 9 has
    assert sorted(r["carried"]["n_words"] for r in rows) == list(range(len(rows)))


def test_ids_must_be_integers(spark):
    with pytest.raises(TypeError):
        substrings.remove_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# --- benchmark passages

TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return TOKEN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def slow_contamination(rows, items):
    windows = {}
    for item, text in items:
        parts = lowered(text)
        if item is None or not parts:
            continue
        n = min(10, len(parts))
        for s in range(len(parts) - n + 1):
            windows.setdefault(tuple(parts[s:s + n]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    result = []
    for i, text in rows:
        parts, hit, found = lowered(text), set(), set()
        for n in lengths:
            for s in range(len(parts) - n + 1):
                if items_of := windows.get(tuple(parts[s:s + n])):
                    hit |= set(range(s, s + n))
                    found |= items_of
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        result.append((i, len(parts), len(hit), len(found), digest, bool(hit)))
    return result


ITEMS = [
    (1, "QUICK brown fox jumps over the lazy dog near the river bank"),
    (2, words(40, "p")[:150]),
    (10, "two words"),
    (3, "the River"),
    (4, None),
    (5, "!!"),
    (None, "word"),
    (6, words(12, "u")),
    (7, words(12, "u")),
    (8, "a b a b a b a b a b a b"),
    (9, "漢字 😀 Àb"),
    (2, "the river"),
]


def test_contamination(spark, docs, none):
    items = spark.createDataFrame([(*row, 1, "x") for row in ITEMS], "item_id long, text string, doc_id long, words string")
    same(decontaminate.contamination(docs, items).collect(), slow_contamination(pairs_of(docs, "doc_id", "text"), ITEMS))
    assert decontaminate.contamination(none, items).collect() == []
    clean = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(clean) == docs.count() and not any(r["contaminated"] or r["n_hit"] for r in clean)


def test_contamination_without_broadcast(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(decontaminate.contamination(docs, items).collect(), slow_contamination(pairs_of(docs, "doc_id", "text"), ITEMS))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_contamination_uses_no_python(docs, labelled, spark, sf):
    plan = decontaminate.contamination(labelled[0], spark.read.parquet(f"{sf}/benchmark.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_clean_documents_stay(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontaminate.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    rows = pairs_of(docs, "doc_id", "text")
    expected = [row for row, found in zip(rows, slow_contamination(rows, ITEMS)) if not found[-1]]
    same(pairs_of(kept, "doc_id", "text"), expected)


def test_patterned_words_are_kept(spark):
    """Documents that differ in one word of 1,024 characters, which weak hashes take for another."""
    morse = lambda flip: "".join("ab"[(k.bit_count() + flip) % 2] for k in range(1024))
    text = lambda flip: " ".join([f"w{k}" for k in range(15)] + [morse(flip)] + [f"v{k}" for k in range(15)])
    df = spark.createDataFrame([(1, text(0)), (2, text(1)), (3, text(0))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeats(df).collect()} == {1: 0, 2: 0, 3: 31}


def test_substrings_against_sql(spark, sf):
    import oracle
    from tabloom.llm import queries

    assert oracle.difference(queries.op3_difference_cover(spark, sf), oracle.connect(sf), queries.OP3_SQL) is None


def test_chunk_of_repeats_takes_little_memory():
    """Two chunks are at work in an executor at a time, beside what the pipeline's other stages left there."""
    import tracemalloc

    import pyarrow as pa

    from tabloom.llm import substrings

    text = " ".join(f"w{k}" for k in range(2000))
    count = substrings.CHUNK_BYTES // len(text)
    row = substrings._make([pa.array(range(count)), pa.array([text] * count), pa.nulls(count)])
    tracemalloc.start()
    try:
        substrings._anchor_entries({**row, "ids": pa.array(range(count))}, 8)
        assert tracemalloc.get_traced_memory()[1] < 75 << 20
    finally:
        tracemalloc.stop()
