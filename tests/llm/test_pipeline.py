"""The pipeline stage by stage against brute force, on its own input and on odd rows."""

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabloom.llm import quality
from tabloom.llm.common import written
from test_pairs import key, pairs_of, same, slow_components, slow_contamination, slow_fingerprint, slow_removal


def stages(spark, docs, sf):
    """Each stage's input and output."""
    found = []
    for name, stage in corpus_pipeline.STAGES:
        result = written(stage(spark, docs, sf))
        found.append((name, docs, result))
        docs = result
    return found


@pytest.fixture(scope="module")
def done(spark, sf):
    return stages(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)


def test_columns_stay_until_packing(done):
    for _, before, after in done[:-1]:
        assert before.dtypes == after.dtypes


def test_quality_rules(spark, done, sf):
    _, before, after = done[0]
    model = quality.fit_quality(before, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = pairs_of(before, "doc_id", "text")
    kept = quality.judge(model, pa.array([text for _, text in rows]))["kept"]
    same(pairs_of(after, "doc_id", "text"), [row for row, k in zip(rows, kept) if k])


def test_near_dedup(done):
    _, before, after = done[1]
    rows = pairs_of(before, "doc_id", "text")
    roots = slow_components({slow_fingerprint(text) for _, text in rows})
    least = {}
    for i, text in rows:
        root = roots[slow_fingerprint(text)]
        least[root] = min(least.get(root, i), i)
    same(pairs_of(after, "doc_id"), [(i,) for i in least.values()])


def test_substring_dedup(done):
    _, before, after = done[2]
    rows = dict(pairs_of(before, "doc_id", "text"))
    removed = {i: n for i, _, n, _ in slow_removal(list(rows.items()))}
    assert after.count() == before.count() and any(removed.values())
    for i, text, n in pairs_of(after, "doc_id", "text", "n_chars"):
        assert (text == rows[i]) if not removed[i] else (len(text.split()) == len(rows[i].split()) - removed[i] and n == len(text))


def test_decontamination(spark, done, sf):
    _, before, after = done[3]
    rows = pairs_of(before, "doc_id", "text")
    items = pairs_of(spark.read.parquet(f"{sf}/benchmark.parquet"), "item_id", "text")
    hit = [found[-1] for found in slow_contamination(rows, items)]
    assert any(hit)
    same(pairs_of(after, "doc_id", "text"), [row for row, h in zip(rows, hit) if not h])


def test_packing(done, spark, sf):
    _, before, after = done[4]
    assert {r[0] for r in pairs_of(after, "doc_id")} == {r[0] for r in pairs_of(before, "doc_id")}
    run = corpus_pipeline.run(spark, sf)
    same(pairs_of(run.drop("sequence_id", "offset"), *run.columns[:5]), pairs_of(after, *run.columns[:5]))


def test_odd_rows_and_clashing_columns(spark, docs, sf):
    found = stages(spark, docs, sf)
    for _, before, after in found[:-1]:
        assert before.dtypes == after.dtypes
    assert found[0][2].count() > 3
    for _, _, after in stages(spark, docs.limit(0), sf):
        assert after.isEmpty()


def test_repeated_rows_leave_one(spark, sf):
    text = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(7, text, "en", "s", 1)] * 5 + [(None, text + " end", "en", "s", 1)] * 3, "doc_id long, text string, lang string, source string, n_chars long")
    after = corpus_pipeline.simhash_near_dedup(spark, docs, sf)
    assert len(after.collect()) == len(set(slow_components({slow_fingerprint(r[0]) for r in pairs_of(docs, "text")}).values()))
    assert after.select(F.max("doc_id")).first()[0] == 7
    assert key((1, None)) < key((None, 1))
