"""Groups kept up to date, against one run over all rows."""

import os

import pytest

import tabloom as tl
from tabloom.errors import InsufficientData, MissingColumn, TableError

ROWS = [(k, ["a", "b", None, "c"][k % 4], k % 3, None if k % 7 == 0 else str(k * 1.25), "x" if k % 5 else " 7 ") for k in range(400)]
SCHEMA = "id int, flag string, part int, price string, odd string"


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def same(states, table):
    assert rows(states.value_counts("flag")) == rows(tl.value_counts(table, "flag"))
    assert rows(states.value_counts("part")) == rows(tl.value_counts(table, "part"))
    assert rows(states.duplicate_groups()) == rows(tl.duplicate_groups(table, ["flag", "part"]))
    for value in ("price", "odd"):
        for how in ("count", "sum", "avg", "min", "max"):
            assert rows(states.pivot_cells("flag", "part", value, how)) == rows(tl.pivot_cells(table, "flag", "part", value, how))


def test_ten_batches_equal_one_run(spark, table, tmp_path):
    states = tl.GroupStates(spark, str(tmp_path / "s"), ["flag", "part"], ["price", "odd"])
    with pytest.raises(InsufficientData):
        states.states()
    for batch in range(10):
        assert states.add(table.where(f"id div 40 = {batch}"), f"day/{batch}")
        if batch in (3, 4, 7):
            states.compact()
    assert not states.add(table, "day/0") and not states.add(table, "day/9")  # late repeats, compacted or not
    assert states.batches() == [f"day/{b}" for b in range(10)]
    same(states, table)
    states.compact()
    states.compact()
    same(tl.GroupStates(spark, str(tmp_path / "s"), ["flag", "part"], ["price", "odd"]), table)
    assert len(os.listdir(tmp_path / "s")) == 1


def test_folders_left_by_a_failure_are_not_read(spark, table, tmp_path, monkeypatch):
    states = tl.GroupStates(spark, str(tmp_path / "s"), ["flag", "part"], ["price", "odd"])
    states.add(table.where("id < 100"), "1")
    states.add(table.where("id >= 100"), "2")
    import shutil
    shutil.copytree(tmp_path / "s" / "batch-2", tmp_path / "kept")
    states.compact()
    shutil.copytree(tmp_path / "kept", tmp_path / "s" / "batch-2")  # as if deleting it had failed
    same(states, table)
    assert not states.add(table, "2")


def test_a_failed_batch_leaves_nothing(spark, table, tmp_path):
    states = tl.GroupStates(spark, str(tmp_path / "s"), ["flag"], ["price"])
    states.add(table, "1")
    broken = table.selectExpr("if(id = 7, raise_error('lost'), flag) AS flag", "price")
    with pytest.raises(Exception, match="lost"):
        states.add(broken, "2")
    assert states.batches() == ["1"] and sorted(os.listdir(tmp_path / "s")) == ["batch-1"]


def test_empty_batches_and_refusals(spark, table, tmp_path):
    states = tl.GroupStates(spark, str(tmp_path / "s"), ["flag"], ["price"])
    assert states.add(table.limit(0), "none") and not states.add(table, "none")
    assert rows(states.value_counts("flag")) == []
    with pytest.raises(TableError, match="other types"):
        states.add(table.selectExpr("id AS flag", "price"), "2")
    with pytest.raises(TableError, match="other columns"):
        tl.GroupStates(spark, str(tmp_path / "s"), ["part"]).states()
    for call in (lambda: states.add(table.drop("price"), "3"), lambda: states.value_counts("part"),
                 lambda: states.pivot_cells("flag", "flag", "odd", "sum")):
        with pytest.raises(MissingColumn):
            call()


def test_states_of_a_stream(spark, table, tmp_path):
    for i in range(3):
        table.where(f"id % 3 = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    states = tl.GroupStates(spark, str(tmp_path / "s"), ["flag", "part"], ["price", "odd"])
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        query = states.follow(stream, "in", str(tmp_path / "at"), availableNow=True)
        assert query.awaitTermination(120)
    assert states.batches() == ["in-0", "in-1", "in-2"]
    # A new checkpoint under the old name repeats the same batches.
    states.follow(stream, "in", str(tmp_path / "again"), availableNow=True).awaitTermination(120)
    same(states, table)
