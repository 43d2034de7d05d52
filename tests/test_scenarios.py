"""The scenario tables of FIXTURES.md, as literal frames and files."""

import pytest
from pyspark.sql import functions as F

import tabloom as tl
from tabloom.operators.split import write_banner_split

# A library's loans: names and values are ours, only the numbers of rows, columns and keys matter.
HEADERS = ["shelf", "clerk", "title", "copies", "fee", "note", "borrower", "branch", "genre", "desk", "tongue", "spine", "cover",
           "remark", "rating"]


@pytest.fixture(scope="module")
def report(spark):
    """20,000 loans of 15 columns: 50 shelves, 12 clerks, no empty cell, no mixed column."""
    df = spark.range(1, 20001)
    made = {
        "shelf": F.format_string("shelf%02d", F.col("id") % 50),
        "clerk": F.concat(F.lit("clerk"), F.col("id") % 12),
        "title": F.concat(F.lit("title "), F.md5(F.col("id").cast("string"))),
        "copies": F.pmod(F.hash("id"), F.lit(997)).cast("bigint"),
        "fee": F.pmod(F.hash("id", F.lit(1)), F.lit(53)).cast("bigint"),
        "rating": F.pmod(F.hash("id", F.lit(2)), F.lit(7)).cast("bigint"),
    }
    word = lambda name: F.concat(F.lit(f"{name} "), F.pmod(F.hash("id", F.lit(name)), F.lit(90)))
    return df.select("id", *[made.get(h, word(h)).alias(h) for h in HEADERS]).cache()


@pytest.fixture(scope="module")
def table_a(report):
    return report.drop("id")


def test_split(spark, table_a, tmp_path):
    path = str(tmp_path / "out")
    tl.write_split(table_a, "shelf", path, name_pattern="list_{value}")
    assert [r.table_name for r in tl.list_tables(spark, path).collect()][:2] == ["list_shelf00", "list_shelf01"]
    sizes = tl.read_split(spark, path).groupBy("split_part").count().collect()
    assert len(sizes) == 50 and {r["count"] for r in sizes} == {400}
    one = tl.read_split(spark, path, output="list_shelf07")
    assert one.count() == 400 and one.columns == [*HEADERS, "split_part"]
    assert sum(r.n for r in tl.split_summary(table_a, "shelf").collect()) == 20000


def test_merge(spark, table_a):
    parts = [table_a.where(F.col("rating") % 3 == k) for k in range(3)]
    assert tl.merge_by_position(parts).count() == 20000
    empty = spark.createDataFrame([], "").select()
    with_empty = tl.merge_by_position([parts[0], empty, parts[1]])
    assert with_empty.columns == HEADERS and with_empty.count() == parts[0].count() + parts[1].count()


@pytest.mark.parametrize("keep", ["first", "last"])
def test_dedup(report, keep):
    kept = tl.dedup(report, ["shelf", "clerk"], keep, order_by=["id"])
    assert kept.count() == 300
    edge = kept.agg(F.min("id"), F.max("id")).head()
    assert tuple(edge) == ((1, 300) if keep == "first" else (19701, 20000))


def test_filter(table_a):
    over = [{"column": "copies", "operator": "gt", "value": 500}]
    assert tl.filter_rows(table_a, over).count() == table_a.where("`copies` > 500").count()


def test_filter_none_writes_nothing(table_a, tmp_path):
    found = tl.filter_rows(table_a, [{"column": "copies", "operator": "gt", "value": 10**9}])
    target = tmp_path / "none"
    assert tl.write_if(found, lambda df: df.write.parquet(str(target))) is False
    assert not target.exists()


def test_pivot(table_a):
    table = tl.crosstab(table_a, "shelf", "clerk", "rating")
    rows = table.collect()
    assert len(rows) == 51 and len(table.columns) == 14
    assert rows[-1]["合计"] == 20000 and rows[0][table.columns[0]] == "shelf00"
    # 50 and 12 share a factor of 2, so half of all combinations never occur.
    assert sum(v == 0 for r in rows[:-1] for v in r[1:-1]) == 300


def test_header_only_and_bad_field(table_a):
    bare = table_a.where("false")
    with pytest.raises(tl.InsufficientData):
        tl.crosstab(bare, "shelf", "clerk", "rating")
    with pytest.raises(tl.InsufficientData):
        tl.report(bare, {"empty": True, "duplicates": True})
    with pytest.raises(tl.MissingColumn, match="no such column"):
        tl.crosstab(table_a, "shelf", "clerk", "no such column", "sum")


def test_columns(table_a):
    kept = HEADERS[:5]
    out = tl.column_ops(table_a, keep=kept, order=kept, renames={"copies": "copies2"})
    assert out.columns == ["shelf", "clerk", "title", "copies2", "fee"] and out.count() == 20000


def test_columns_calc(table_a):
    kept = ["shelf", "clerk", "copies", "fee"]
    out = tl.column_ops(table_a, kept, kept, calc=[
        {"name": "total", "expression": "{copies} * {fee}"}, {"name": "mixed", "expression": "{copies} + remark"}])
    assert out.where("`total` = `copies` * `fee` AND `mixed` IS NULL").count() == 20000


def test_validate(table_a):
    quick = tl.report(table_a, {"empty": True})
    assert quick.where("passed").count() == 15 and tl.issues(quick).isEmpty()
    full = tl.report(table_a, {"empty": True, "empty_threshold": 1, "outliers": True, "type_check": True,
                               "duplicates": True}).collect()
    assert {r.check for r in full} == {"empty", "outliers", "type_check", "duplicates"}
    assert all(r.passed for r in full)


def test_issues_are_written_per_check(spark, table_a, tmp_path):
    assert tl.write_issues(tl.report(table_a, {"empty": True}), str(tmp_path / "none")) is False
    assert not (tmp_path / "none").exists()
    holes = table_a.withColumn("remark", F.when(F.col("copies") > 500, F.lit(" ")).otherwise(F.col("remark")))
    report = tl.report(holes.select("remark", "copies"), {"empty": True, "empty_threshold": 40, "type_check": True})
    assert tl.write_issues(report, str(tmp_path / "some")) is True
    assert sorted(p.name for p in (tmp_path / "some").glob("check=*")) == ["check=empty", "check=type_check"]
    line = spark.read.json(str(tmp_path / "some" / "check=empty")).head()
    n = table_a.where("copies > 500").count()
    assert (line.column, line.value, line.detail) == ("remark", round(100 * n / 20000, 1), f"{n}/20000")


def _write(path, text, encoding="utf-8-sig"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_convert(spark, tmp_path):
    cell = lambda name, i: f"{name} {(7 * i + len(name)) % (10 + 3 * len(name))}"
    lines = [",".join(HEADERS)] + [",".join(cell(name, i) for name in HEADERS) for i in range(20000)]
    good = _write(tmp_path / "good.csv", "\r\n".join(lines) + "\r\n")
    broken = tmp_path / "broken.csv"
    broken.write_bytes("甲,乙\n".encode("gbk") + b"\xff\xfe\x00\x81bad-bytes\n" * 2000)
    empty = _write(tmp_path / "empty.csv", "", "utf-8")
    paths = [str(broken), good, empty, str(tmp_path / "missing.csv")]
    done = tl.convert_many(spark, paths, "csv", "parquet", str(tmp_path / "out")).collect()
    assert [(r.ok, r.rows) for r in done] == [(False, None), (True, 20000), (False, None), (False, None)]
    assert "not valid UTF-8" in done[0].error and [r.input for r in done] == paths
    table = spark.read.parquet(str(tmp_path / "out" / "good.parquet"))
    assert table.columns == HEADERS and {t for _, t in table.dtypes} == {"string"}
    assert not (tmp_path / "out" / "broken.parquet").exists()


def test_csv_cells(spark, tmp_path):
    path = _write(tmp_path / "a.csv", 'a,,a,b\r\n1,"x\r\ny", pad ,"say ""hi"""\r\n2\r\n3,4,5,6,7\r\n')
    df = tl.read_csv(spark, path)
    assert df.columns == ["a", "Col1", "a_2", "b"]
    # Line ends inside a cell are read as \n.
    assert [tuple(r) for r in df.collect()] == [
        ("1", "x\ny", " pad ", 'say "hi"'), ("2", None, None, None), ("3", "4", "5", "6")]
    frame = spark.createDataFrame([(1.0, 'q"u,o\nte', True, " s "), (2.5, None, False, "")],
                                  "x double, y string, z boolean, w string")
    tl.write_csv(frame.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == 'x,y,z,w\n1,"q""u,o\nte",True, s \n2.5,,False,\n'


def test_csv_headers(spark, tmp_path):
    names = lambda text: tl.read_csv(spark, _write(tmp_path / "h.csv", text)).columns
    assert names("a0,b,a2\n1,2,3\n") == ["a0", "b", "a2"]
    assert names("x,X,x_2\n1,2,3\n") == ["x", "X_2", "x_2_2"]
    bare = tl.read_csv(spark, _write(tmp_path / "h.csv", "1,2\n3,4\n"), header=False)
    assert bare.columns == ["Col0", "Col1"] and bare.count() == 2


def test_dedup_without_duplicates_writes_nothing(spark, tmp_path):
    rows = [(f"ID{i:04d}", f"name{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "`code` string, `name` string")
    assert tl.dedup_counts(df, ["code"]).head().removed == 0
    target = tmp_path / "dedup"
    written = tl.write_if(tl.dedup(df, ["code"]), lambda d: d.write.parquet(str(target)),
                          found=tl.duplicate_groups(df, ["code"]))
    assert written is False and not target.exists()


@pytest.fixture(scope="module")
def edge(spark):
    """Table E: two lead rows, header on row 3, 400 data rows, two tail rows."""
    plants = ["fern", "moss", "reed", "sage", "iris", "lily", "aloe"]
    rows = [("Greenhouse", "north wing", None, None, None), (None, None, None, None, "spring"), ("plant", "bed", "pot", "height", "water")]
    rows += [(plants[k % 7], f"bed{k % 5}", f"p{k:03d}", str(3 + k * k % 71), str(k * 13 % 37)) for k in range(400)]
    rows += [(None, "all beds", None, None, "7040"), ("checked", None, "yes", None, None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string").coalesce(1)
    return tl.with_row_index(df)


@pytest.mark.parametrize("column,mode,outputs", [("a", "files", 7), ("a", "sheets", 7), ("b", "sheets", 5)])
def test_split_with_lead_and_tail(spark, edge, tmp_path, column, mode, outputs):
    sections = tl.split_sections(edge, header_row=3, tail=(404, 405))
    banner = tl.attach_banner(sections, column)
    by_key = {}
    for r in banner.orderBy("split_key", "place", "row_no").collect():
        by_key.setdefault(r.split_key, []).append(r)
    assert len(by_key) == outputs
    for key, rows in by_key.items():
        assert [r.row_no for r in rows[:3]] == [1, 2, 3] and [r.row_no for r in rows[-2:]] == [404, 405]
        data = [r.row_no for r in rows[3:-2]]
        assert data == sorted(data) and all(r[column] == key for r in rows[3:-2])
    assert sum(len(rows) - 5 for rows in by_key.values()) == 400
    write_banner_split(banner, str(tmp_path / "out"), mode=mode)
    folder = "split_part" if mode == "files" else "split_table"
    for key, rows in by_key.items():
        lines = "".join(p.read_text() for p in sorted((tmp_path / "out" / f"{folder}={key}").glob("part-*")))
        assert lines == "".join(",".join("" if v is None else v for v in r[3:]) + "\n" for r in rows)


def test_split_without_lead(edge):
    sections = tl.split_sections(edge, header_row=3, include_lead=False)
    banner = tl.attach_banner(sections, "b")
    sizes = {r.split_key: r["count"] for r in banner.groupBy("split_key").count().collect()}
    assert sizes == {"(空)": 2, "all beds": 2, **{f"bed{k}": 81 for k in range(5)}}
