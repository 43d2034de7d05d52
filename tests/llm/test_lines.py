"""Line dedup against SQL and plain Python."""

import hashlib

import oracle
from pyspark.sql import functions as F

from tabloom.llm import lines, queries
from tabloom.llm.common import folders
from tabloom.storage import scratch_dir

STRIP = " \t\n\x0b\x0c\r"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def slow(rows):
    """Id, lines, dropped lines and kept text of each row."""
    last = float("inf")
    key = lambda line: lowered(line.strip(STRIP))
    owner = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            owner[key(line)] = min(owner.get(key(line), last), last if i is None else i)
    found = []
    for i, text in rows:
        split = (text or "").split("\n")
        kept = [line for line in split if len(key(line)) < 10 or owner[key(line)] == (last if i is None else i)]
        found.append((i, len(split), len(split) - len(kept), "\n".join(kept)))
    return found


def order(row):
    return tuple((value is None, value) for value in row)


def check(found, rows):
    assert sorted(map(tuple, found.collect()), key=order) == sorted(slow(rows), key=order)


def test_against_plain_python(spark, docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    common = "A Line that  many hold"
    rows += [(k, f"start {k}\n {common}\t\n{common.lower()}\n\nshort\nown line number {k}\n") for k in range(20, 60)]
    rows += [(k, f"{common}\r\n{common}") for k in (19, 61, 62)] + [(63, "É" * 10 + "\nnine char"), (64, "é" * 10 + "\nNINE char"), (65, "É" * 10 + "\nx")]
    rows += [(None, common), (-5, "own line number 33")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(4)
    for batches in (1, 7):
        check(lines.without_repeated_lines(df, batches=batches), rows)


def test_edges(spark, docs, none):
    assert lines.without_repeated_lines(none).collect() == []
    ten = [(1, "0123456789"), (2, " 0123456789"), (3, "012345678"), (4, "012345678"), (2, "0123456789"), (None, None), (None, "0123456789")]
    check(lines.without_repeated_lines(spark.createDataFrame(ten, "doc_id long, text string")), ten)
    long = [(1, "\n".join(f"line number {k}" for k in range(30_000))), (2, "\n".join(f"line number {k}" for k in range(0, 60_000, 2)))]
    check(lines.without_repeated_lines(spark.createDataFrame(long, "doc_id long, text string")), long)
    clashing = docs.select("doc_id", "text", *[F.lit("x").alias(n) for n in ("id", "row", "place", "batch", "places", "split", "_id", "_row", "owner")])
    check(lines.without_repeated_lines(clashing), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_runs_are_levelled_and_reopened(spark):
    folder = scratch_dir(spark)
    rows = [(k, f"line of every document\nline of document {k % 40}") for k in range(80)]
    for part in range(8):
        runs = lines.LineRuns(spark, folder, fanout=3)
        batch = rows[part * 10:part * 10 + 10]
        got = {r[0]: r[3] for r in lines.without_repeated_lines(spark.createDataFrame(batch, "doc_id long, text string"), runs=runs, batches=1).collect()}
        want = {i: text for i, _, _, text in slow(rows[:part * 10 + 10])}
        assert got == {i: want[i] for i, _ in batch}
    levels = [r[0] for r in runs.runs]
    assert sorted(levels) == [0, 0, 1, 1] and len(folders(spark, folder)) == 4
    assert runs.owners().count() == 41 == runs.owners().select("digest").distinct().count()
    # The same rows once more change neither the runs' keys nor the result.
    again = {r[0]: r[3] for r in lines.without_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"), runs=runs, batches=2).collect()}
    assert again == {i: text for i, _, _, text in slow(rows)} and runs.owners().count() == 41


def test_runs_are_merged_where_they_lie(spark):
    runs = lines.LineRuns(spark, scratch_dir(spark))
    keys = lambda n: spark.range(n).select(F.col("id").cast("string").cast("binary").alias("digest"), F.col("id").alias("owner"))
    runs.add(keys(10))
    left = keys(20).groupBy("digest").agg(F.min("owner").alias("owner")).join(runs.read(runs.runs[0]).hint("merge"), "digest", "left_anti")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan
    assert left.count() == 10


def test_native(spark, sf):
    plan = queries.op11_sorted_runs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_query(spark, sf):
    found = queries.op11_sorted_runs(spark, sf)
    assert oracle.difference(found, oracle.connect(sf), queries.OP11_SQL) is None
    assert found.agg(F.sum("n_dropped")).first()[0] > 0
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, _, _, t in slow(list(texts.items()))}
    assert {r["doc_id"]: r["kept_sha256"] for r in found.collect()} == want
