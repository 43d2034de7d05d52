"""Recipes as graphs: sharing, source order, refusals, clean-up; merges of streams."""

import os

import pytest

import tabloom as tl
from tabloom.errors import TableError
from tabloom.streaming.stateless import merge_streams, run_stateless

LINES = "/root/testdata/sf0.001/lineitem.parquet"
STEPS = [
    {"name": "modes", "from": "kept", "op": "value_counts", "column": "l_linenumber"},
    {"name": "kept", "from": "lines", "op": "filter", "conditions": [{"column": "l_quantity", "operator": "gt", "value": "30"}]},
    {"name": "flags", "from": "kept", "op": "value_counts", "column": "l_returnflag"},
    {"name": "firsts", "from": "kept", "op": "dedup", "columns": ["l_linenumber"]},
    {"name": "unused", "from": "kept", "op": "type_kinds"},
]


@pytest.fixture
def lines(spark):
    return spark.read.parquet(LINES)


@pytest.fixture
def shared(spark, tmp_path, monkeypatch):
    base = tmp_path / "shared"
    base.mkdir()
    monkeypatch.setattr("tabloom.storage._base", lambda spark: str(base))
    return base


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_graph_equals_chains(spark, lines, shared, tmp_path):
    graph = tl.Graph({"lines": lines}, STEPS)
    sinks = {n: str(tmp_path / n) for n in ("modes", "flags", "firsts")}
    summary = {r["result"]: (r["op"], r["rows"], r["sink"]) for r in graph.run(sinks).collect()}
    whole = graph.results(*sinks)
    for name, path in sinks.items():
        assert rows(spark.read.parquet(path)) == rows(whole[name])
        assert summary[name][1:] == (whole[name].count(), True)
    kept = lines.where("l_quantity > 30")
    assert summary["kept"] == ("filter", kept.count(), False) and "unused" not in summary
    # dedup goes by the source's order, although its parent is shared.
    assert rows(whole["firsts"]) == rows(tl.keep_first(kept, ["l_linenumber"]))
    assert os.listdir(shared) == []


def test_shared_results_are_scanned_once(spark, lines, shared, tmp_path, monkeypatch):
    seen = []
    real = tl.plans.graph.write_staged
    monkeypatch.setattr("tabloom.plans.graph.write_staged", lambda df, path: (seen.append((path, sorted(df.inputFiles()))), real(df, path))[1])
    tl.Graph({"lines": lines}, STEPS).run({n: str(tmp_path / n) for n in ("modes", "flags")})
    assert [LINES in str(files) for _, files in seen] == [True, False, False]
    assert all(str(shared) in files[0] for _, files in seen[1:])


def test_a_sink_serves_its_readers(spark, lines, shared, tmp_path, monkeypatch):
    sinks = {n: str(tmp_path / n) for n in ("kept", "modes", "flags")}
    monkeypatch.setattr("tabloom.plans.graph.scratch_dir", None)
    tl.Graph({"lines": lines}, STEPS).run(sinks)
    assert spark.read.parquet(sinks["kept"]).count() == lines.where("l_quantity > 30").count()


def test_empty_results_and_failures(spark, lines, shared, tmp_path):
    none = [{**s, "conditions": [{"column": "l_quantity", "operator": "lt", "value": "0"}]} if s["op"] == "filter" else s for s in STEPS]
    summary = tl.Graph({"lines": lines}, none).run({n: str(tmp_path / n) for n in ("modes", "flags")}).collect()
    assert {r["rows"] for r in summary} == {0} and not (tmp_path / "modes").exists()
    (tmp_path / "flags").mkdir()
    with pytest.raises(TableError, match="exists"):
        tl.Graph({"lines": lines}, STEPS).run({n: str(tmp_path / n) for n in ("modes", "flags")})
    assert os.listdir(shared) == []


def test_several_inputs(spark):
    a, b = spark.createDataFrame([(1, "x")], "a int, b string"), spark.createDataFrame([(2,)], "c int")
    graph = tl.Graph({"a": a, "b": b}, [{"name": "both", "from": ["a", "b", "a"], "op": "merge"}])
    assert rows(graph.results("both")["both"]) == [(1, "x"), (1, "x"), (2, None)]


@pytest.mark.parametrize("steps, message", [
    ([{"name": "x", "op": "filter"}], "has 'name'"),
    ([{"name": "x", "from": "no", "op": "filter"}], "unknown results: no"),
    ([{"name": "lines", "from": "lines", "op": "filter"}], "two results"),
    ([{"name": "x", "from": ["lines", "lines"], "op": "filter"}], "no merge"),
    ([{"name": "x", "from": "y", "op": "filter"}, {"name": "y", "from": "x", "op": "filter"}], "read each other"),
])
def test_refusals(lines, steps, message):
    with pytest.raises(TableError, match=message):
        tl.Graph({"lines": lines}, steps)


def test_unknown_sinks(lines, tmp_path):
    with pytest.raises(TableError, match="no step is named nothing"):
        tl.Graph({"lines": lines}, STEPS).run({"nothing": str(tmp_path / "x")})


def test_merge_of_streams(spark, tmp_path):
    frames = [spark.createDataFrame([(1, "x"), (2, "y:z")], "k int, v string"), spark.createDataFrame([(3.5,)], "w double")]
    streams = []
    for i, df in enumerate(frames):
        df.write.parquet(str(tmp_path / f"in{i}"))
        streams.append(spark.readStream.schema(df.schema).parquet(str(tmp_path / f"in{i}")))
    stream = run_stateless(merge_streams(streams, source_no="input"), [{"op": "split", "column": "v"}])
    batch = tl.apply_op(tl.merge_by_position(frames, source_no="input"), {"op": "split", "column": "v"})
    query = stream.writeStream.format("parquet").trigger(availableNow=True) \
        .option("checkpointLocation", str(tmp_path / "at")).start(str(tmp_path / "out"))
    query.awaitTermination(120)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
    with pytest.raises(TableError, match="streams only"):
        merge_streams([streams[0], frames[1]])
