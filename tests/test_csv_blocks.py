"""CSV with line breaks in cells, cut into small blocks, against one task per file."""

import random

import pytest
from pyspark.sql import functions as F

import tabloom as tl
from tabloom.sources.blocks import opens

OPTIONS = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture(params=["97b", "1k"])
def small_blocks(spark, request):
    for name in OPTIONS:
        spark.conf.set(name, request.param)
    yield
    for name in OPTIONS:
        spark.conf.unset(name)


def cell(rng):
    plain = "".join(rng.choice("abc é5'") for _ in range(rng.randrange(6)))
    kind = rng.randrange(9)
    if kind == 0:
        return '"' + "".join(rng.choice(['""', ",", "\n", "\r\n", "x", "é"]) for _ in range(rng.choice([1, 5, 300]))) + '"'
    if kind == 1:
        return 'a"b'  # a quote inside an unquoted cell
    if kind == 2:
        return '""'
    if kind == 3:
        return f'"{plain}"'
    if kind == 4:
        return '"\n"'
    return plain


def text(seed, rows, end="\n"):
    rng = random.Random(seed)
    lines = ["id,a,b"] + [f"r{k}," + ",".join(cell(rng) for _ in range(rng.choice([1, 2, 2, 2, 3]))) for k in range(rows)]
    return end.join(lines) + (end if rng.random() < 0.7 else "")


def key(row):
    return tuple((v is None, v) for v in row)


@pytest.mark.parametrize("seed", range(4))
def test_equal_to_one_task(spark, tmp_path, small_blocks, seed):
    folder = tmp_path / "t"
    folder.mkdir()
    for k in range(2):
        (folder / f"{k}.csv").write_bytes(text(seed * 10 + k, 120, "\r\n" if seed % 2 else "\n").encode())
    blocks = tl.read_csv(spark, str(folder), multiLine="blocks")
    whole = tl.read_csv(spark, str(folder), multiLine="true")
    assert blocks.columns == whole.columns == ["id", "a", "b"]
    got, want = ([tuple(r) for r in df.collect()] for df in (blocks, whole))
    want = [tuple(v if v is None else v.replace("\r\n", "\n") for v in r) for r in want]
    assert sorted(got, key=key) == sorted(want, key=key) and len(got) == 240
    assert blocks.rdd.getNumPartitions() > 5


def test_order_and_numbers(spark, tmp_path, small_blocks):
    folder = tmp_path / "t"
    folder.mkdir()
    n = 0
    for k in (9, 10):  # 9 comes before 10
        rows = []
        for _ in range(80):
            rows.append(f'{n},"line one\nline ""two"" of {n}"' if n % 3 else f"{n},plain")
            n += 1
        (folder / f"f{k}.csv").write_text("\n".join(["id,v", "", *rows]) + "\n")
    df = tl.read_csv(spark, str(folder), address="at")
    rows = df.orderBy("at").collect()
    assert [int(r.id) for r in rows] == list(range(160))
    assert rows[1].v == 'line one\nline "two" of 1'
    first = tl.keep_first(df.withColumn("k", F.col("id").cast("int") % 7), ["k"], order_by=["at"])
    assert sorted(int(r.id) for r in first.collect()) == list(range(7))
    with pytest.raises(tl.TableError):
        tl.with_row_index(df.drop("at"))


def test_long_cell_over_many_blocks(spark, tmp_path, small_blocks):
    """A cell without quotes inside that fills whole blocks, and one that never closes."""
    body = "\n".join(f"line {k}" for k in range(400))
    (tmp_path / "a.csv").write_text(f'id,v\n1,"{body}"\n2,x\n3,"open\n{body}')
    for way in ("blocks", "true"):
        rows = sorted(map(tuple, tl.read_csv(spark, str(tmp_path / "a.csv"), multiLine=way).collect()))
        assert rows == [("1", body), ("2", "x"), ("3", f"open\n{body}")], way


def test_no_job_before_it_is_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,v\n1,"a\nb"\n')
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("blocks", "blocks")
    try:
        df = tl.read_csv(spark, str(tmp_path / "a.csv"), multiLine="blocks")
        jobs = len(tracker.getJobIdsForGroup("blocks"))  # the header only
        assert jobs <= 1
        assert [tuple(r) for r in df.collect()] == [("1", "a\nb")]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_headers_marks_and_folders(spark, tmp_path, small_blocks):
    for k in ("x", "y"):
        folder = tmp_path / "t" / f"part={k}"
        folder.mkdir(parents=True)
        (folder / "a.csv").write_bytes(f'﻿"id\nno",v,v\r\n1,"{k}\r\n{k}"\r\n\r\n2\r\n3,4,5,6\r\n'.encode())
    df = tl.read_csv(spark, str(tmp_path / "t"))
    assert df.columns == ["id\nno", "v", "v_2", "part"]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(
        [t for k in ("x", "y") for t in (("1", f"{k}\n{k}", None, k), ("2", None, None, k), ("3", "4", "5", k))], key=key)
    bare = tl.read_csv(spark, str(tmp_path / "t"), header=False, multiLine="blocks")
    assert bare.count() == 8 and bare.columns[:2] == ["Col0", "Col1"]


def test_separators(spark, tmp_path, small_blocks):
    for name, sep in (("a", ";"), ("b", "\t"), ("c", "|"), ("d", "x")):
        (tmp_path / f"{name}.csv").write_text(f'id{sep}v\n1{sep}"a{sep}\n{sep}""b"\n2{sep}c"d\n')
        df = tl.read_csv(spark, str(tmp_path / f"{name}.csv"), sep=sep)
        assert sorted(map(tuple, df.collect())) == [("1", f'a{sep}\n{sep}"b'), ("2", 'c"d')]
    with pytest.raises(tl.TableError):
        tl.read_csv(spark, str(tmp_path / "a.csv"), multiLine="blocks", quote="'")


@pytest.mark.parametrize("line, open_", [
    ("a,b", False), ('"a', True), ('a,"b', True), ('a"b,c', False), ('a"b,"c', True), ('"a""', True), ('"a"""', False),
    ('"a"b,"c', True), ('"a"b"c,d', False), ("", False), ('""', False), ('"', True), (' "a', False), (',"",,"', True),
    ('"' + 'x""' * 50_000, True), ("y," * 50_000 + '"a"', False),
])
def test_lines_that_open_a_cell(spark, line, open_):
    assert spark.createDataFrame([(line,)], "value string").select(opens(F.col("value"))).head()[0] is open_


def test_convert_keeps_the_order(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("id,v\n" + "".join(f'{k},"a\n{k}"\n' for k in range(300)))
    done = tl.convert_many(spark, [str(tmp_path / "a.csv")], "csv", "parquet", str(tmp_path / "out")).collect()
    assert [(r.ok, r.rows) for r in done] == [(True, 300)]
    numbered = tl.with_row_index(spark.read.parquet(done[0].output))
    assert [int(r.id) for r in numbered.orderBy("row_no").collect()] == list(range(300))


def test_quoted_blocks_are_not_written_by_one_task(spark, tmp_path):
    """Eight splits of the documents make four files, with all rows."""
    from registry.sources import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    docs.repartition(8).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["S5_quoted_blocks"](spark, str(tmp_path))
    assert len(found.inputFiles()) == 4
    assert {r.doc_id for r in found.collect()} == {str(r.doc_id) for r in docs.select("doc_id").collect()}
