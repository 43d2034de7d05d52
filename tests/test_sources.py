"""Scans, row numbers over many files, split outputs, recipes and streams."""

import json

import pytest
from pyspark.sql import functions as F

import tabloom as tl
from tabloom.storage import scratch_dir
from tabloom.operators.split import write_banner_split
from tabloom.operators.split import write_split
from tabloom.plans import recipe
from tabloom.streaming.stateless import run_stateless


@pytest.mark.parametrize("format", ["parquet", "csv", "text", "json", "orc"])
def test_row_numbers_over_many_files(spark, tmp_path, format):
    """Files of uneven size, in blocks far smaller than a file, keep their row order."""
    path = str(tmp_path / "t")
    ids = spark.range(0, 9000, 1, 1).select(F.concat(F.lpad(F.col("id").cast("string"), 6, "0"), F.repeat(F.lit("x"), 30)).alias("v"))
    parts = F.when(F.col("v") < "000100", 0).when(F.col("v") < "007000", 1).otherwise(2)
    for k in range(3):
        ids.where(parts == k).coalesce(1).write.format(format).mode("append").save(f"{path}/{k}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        reader = spark.read.format(format).option("recursiveFileLookup", "true").schema("v string")
        if format == "text":
            reader = reader.schema("value string")
        numbered = tl.with_row_index(reader.load(path).toDF("v") if format != "text" else reader.load(path))
        rows = numbered.orderBy("row_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.row_no for r in rows] == list(range(1, 9001))
    assert [r[0] for r in rows] == sorted(r[0] for r in rows)


def test_row_numbers_without_broadcast(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(0, 500, 1, 4).write.parquet(path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = tl.with_row_index(spark.read.parquet(path))
        assert "BroadcastHashJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
        assert [r.row_no - r.id for r in numbered.collect()] == [1] * 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_row_numbers_of_other_frames(spark, tmp_path):
    """Rows without a place of their own are refused instead of numbered or removed wrongly."""
    path = str(tmp_path / "t")
    spark.range(0, 900, 1, 3).write.parquet(path)
    scan = spark.read.parquet(path)
    twice = scan.select(F.explode(F.array("id", "id")).alias("id"))
    shuffled = spark.range(500).groupBy((F.col("id") % 50).alias("k")).count()
    for df in (scan.where("id % 7 = 3"), twice, shuffled, scan.unionByName(scan), scan.join(scan, "id"), scan.repartition(5)):
        with pytest.raises(tl.TableError):
            tl.with_row_index(df)
    for df in (twice, shuffled.withColumnRenamed("k", "id"), scan.unionByName(scan), scan.join(scan, "id")):
        key = df.select("id", (F.col("id") % 9).alias("k"))
        for refused in (lambda: tl.removed_rows(key, ["k"]), lambda: tl.keep_first(key, ["k"])):
            with pytest.raises(tl.TableError):
                refused()
    # A filter leaves the remaining rows in their places, so first and last are known.
    some = scan.where("id % 7 = 3").select("id", (F.col("id") % 9).alias("k"))
    assert sorted(r.id for r in tl.keep_first(some, ["k"]).collect()) == sorted(
        min(i for i in range(900) if i % 7 == 3 and i % 9 == k) for k in range(9))
    for keep in ("first", "last"):
        kept, removed = tl.dedup(some, ["k"], keep), tl.removed_rows(some, ["k"], keep)
        assert sorted(r.id for r in kept.unionByName(removed).collect()) == [i for i in range(900) if i % 7 == 3]


@pytest.mark.parametrize("format", ["parquet", "json"])
def test_merged_rows_keep_their_order(spark, tmp_path, format):
    """Folders whose files rise in size, so that Spark packs the last one first."""
    paths, start = [], 0
    for folder in ("b", "a"):
        for k, n in enumerate((3, 40, 5000)):
            spark.range(start, start + n, 1, 1).select("id", F.lit(1).alias("k")).write.format(format).save(f"{tmp_path}/{folder}/{k}")
            start += n
        paths.append(f"{tmp_path}/{folder}")
    merged = tl.merge_paths(spark, paths, format, address="at", recursiveFileLookup="true")
    assert tl.keep_first(merged, ["k"], ["at"]).head().id == 0
    assert tl.keep_last(merged, ["k"], ["at"]).head().id == start - 1
    assert sorted(r.id for r in tl.removed_rows(merged, ["k"], order_by=["at"]).collect()) == list(range(1, start))
    numbered = tl.with_row_index(merged, address="at")
    assert [(r.id, r.row_no) for r in numbered.orderBy("row_no").collect()] == [(i, i + 1) for i in range(start)]
    with pytest.raises(tl.TableError):
        tl.keep_first(merged.drop("at"), ["k"])


def test_hot_banner_output_is_in_order(spark, tmp_path):
    numbered = tl.with_row_index(spark.range(0, 60000, 1, 4).select(F.lit("hot").alias("k"), F.concat("id", F.lit("-" * 20)).alias("v")))
    sections = tl.split_sections(numbered, header_row=3, tail=(59999, 60000))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_banner_split(tl.attach_banner(sections, "k"), str(tmp_path / "o"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = sorted((tmp_path / "o" / "split_part=hot").glob("part-*"))
    lines = "".join(f.read_text() for f in files).splitlines()
    assert len(files) > 1 and [int(line.split(",")[1].split("-")[0]) for line in lines] == list(range(60000))


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(tl.TableError):
        scratch_dir(Session)


def test_split_into_many_outputs(spark, tmp_path):
    path = str(tmp_path / "o")
    tl.write_split(spark.range(1_500).select(F.col("id").cast("string").alias("k"), "id"), "k", path)
    assert sum(1 for _ in (tmp_path / "o").glob("split_part=*")) == 1_500


def test_merge_of_many_files(spark, tmp_path):
    for k in range(5):
        spark.range(k * 10, k * 10 + 10, 1, 1).selectExpr("id", f"'s{k}' AS s").write.csv(str(tmp_path / f"{k}.csv"), header=True)
    paths = [str(tmp_path / f"{k}.csv") for k in (0, 1, 2, 3, 4, 0)]
    one = tl.merge_paths(spark, paths, "csv", same_layout=True)
    assert one._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    each = tl.merge_paths(spark, paths, "csv", source_no="no")
    assert one.columns == ["id", "s"] and one.count() == each.count() == 50
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, each.drop("no").collect()))


def test_scan_with_banner(spark, tmp_path):
    (tmp_path / "b.csv").write_bytes("﻿title\n\nid,,id\n1,\"a,b\",x\n2\n3,\"say \"\"hi\"\"\",z,extra\n".encode())
    lead, data = tl.scan_with_banner(spark, str(tmp_path / "b.csv"), header_row=3)
    assert [tuple(r) for r in lead.orderBy("row_no").collect()] == [(1, "title"), (2, "")]
    assert data.columns == ["row_no", "id", "Col1", "id_2"]
    assert [tuple(r) for r in data.orderBy("row_no").collect()] == [
        (4, "1", "a,b", "x"), (5, "2", None, None), (6, "3", 'say "hi"', "z")]
    with pytest.raises(tl.InsufficientData):
        tl.scan_with_banner(spark, str(tmp_path / "b.csv"), header_row=9)


def test_list_tables(spark, tmp_path):
    df = spark.range(3)
    df.write.parquet(str(tmp_path / "d" / "folder"))
    df.write.csv(str(tmp_path / "d" / "other.csv"))
    df.withColumn("k", F.lit("a b:c%")).write.partitionBy("k").parquet(str(tmp_path / "e"))
    names = lambda p: [r.table_name for r in tl.list_tables(spark, str(tmp_path / p)).collect()]
    assert names("d") == ["folder", "other"] and names("e") == ["a b:c%"]


def test_catalog_tables(spark, tmp_path):
    spark.sql(f"CREATE DATABASE shelf LOCATION '{tmp_path}/shelf'")
    try:
        spark.range(3).write.saveAsTable("shelf.b")
        spark.range(2).write.saveAsTable("shelf.a")
        assert [r.table_name for r in tl.list_catalog_tables(spark, "shelf").collect()] == ["a", "b"]
        assert tl.scan(spark, "shelf.b", "table").count() == 3
    finally:
        spark.sql("DROP DATABASE shelf CASCADE")


def test_hot_output_is_spread_over_tasks(spark, tmp_path):
    """One key holds most rows: its output must not be written by a single task."""
    df = spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 10 < 8, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 7).cast("string"))).alias("k"),
        "id", F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "300k")
    try:
        write_split(df, "k", str(tmp_path / "o"), order_by=["id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = sorted((tmp_path / "o" / "split_part=hot").glob("part-*"))
    assert len(files) > 3
    assert tl.read_split(spark, str(tmp_path / "o")).count() == 60000
    for f in files:
        ids = [r.id for r in spark.read.parquet(str(f)).collect()]
        assert ids == sorted(ids)


def test_split_names(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("a/b", 2), ("a:b", 3), (None, 4), ("  ", 5), ("(空)", 6)], "k string, n int")
    path = str(tmp_path / "o")
    tl.write_split(df, "k", path, order_by=["n"])
    got = {}
    for r in tl.read_split(spark, path).collect():
        got.setdefault(r.split_part, set()).add(r.n)
    assert got == {"007": {1}, "a_b": {2, 3}, "(空)": {4, 6}, "_": {5}}
    assert [tuple(r) for r in tl.split_collisions(df, "k").collect()] == [("a_b", 2, 2)]
    tl.write_split(df, "k", path + "3", format="csv", order_by=["n"], keep_header=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "o3" / "split_part=a_b").glob("part-*")))
    assert text == "k,n\na/b,2\na:b,3\n"


STEPS = [{"op": "filter", "conditions": [{"column": "id", "operator": "gte", "value": "10"}]},
         {"op": "columns", "keep": ["id"], "calc": [{"name": "half", "expression": "{id} / 2"}]}]


def test_recipe(spark, tmp_path):
    df = spark.range(100)
    assert recipe.from_json(recipe.to_json(STEPS)) == STEPS
    out = str(tmp_path / "o")
    summary = tl.run_with_summary(df, STEPS, lambda d: d.write.parquet(out)).collect()
    assert [tuple(r) for r in summary] == [(0, "input", 100), (1, "filter", 90), (2, "columns", 90)]
    assert spark.read.parquet(out).agg(F.sum("half")).head()[0] == sum(range(10, 100)) / 2
    with pytest.raises(tl.TableError):
        tl.run_recipe(df, [{"op": "sort"}])
    with pytest.raises(tl.TableError):
        recipe.from_json(json.dumps({"op": "filter"}))


def test_stateless_steps_on_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(0, 100, 1, 3).write.parquet(source)
    stream = spark.readStream.schema("id bigint").option("maxFilesPerTrigger", "1").parquet(source)
    with pytest.raises(tl.TableError):
        run_stateless(stream, [{"op": "dedup"}])
    query = run_stateless(stream, STEPS).writeStream.format("parquet").trigger(availableNow=True)
    query.option("checkpointLocation", str(tmp_path / "state")).start(str(tmp_path / "out")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.id, r.half) for r in rows) == [(i, i / 2) for i in range(10, 100)]


def test_range_reads_its_files_only(spark, tmp_path):
    path = str(tmp_path / "t")
    for k in range(6):  # later files are larger, so that tasks don't get them in name order
        spark.range(k * 100, k * 100 + 100, 1, 1).select("id", F.repeat(F.lit("x"), k * 50).alias("pad")).write.parquet(f"{path}/k{k}")
    df = spark.read.option("recursiveFileLookup", "true").parquet(path)
    for start, end in ((1, 600), (150, 160), (100, 101), (600, 600), (500, 601), (0, 3), (9, 8)):
        expected = list(range(start, end + 1)) if 1 <= start <= end <= 600 else []
        got = tl.source_range(df, start, end).orderBy("row_no").collect()
        assert [(r.id, r.row_no) for r in got] == [(n - 1, n) for n in expected]
    with pytest.raises(tl.TableError):
        tl.source_range(df.where("id > 3"), 1, 2)
    assert tl.source_range(spark.range(5), 2, 3).count() == 2
    within = tl.source_range(df, 150, 160)
    for k in (0, 2, 5):
        for part in (tmp_path / "t" / f"k{k}").glob("part-*"):
            part.write_bytes(b"not to be read")
    assert within.count() == 11


def test_csv_is_read_in_blocks(spark, tmp_path):
    rows = [f'{k},"a ""b"" {k}"' for k in range(4000)]
    (tmp_path / "flat.csv").write_text("\n".join(["id,v", *rows]) + "\n")
    (tmp_path / "deep.csv").write_text("\n".join(["id,v", *rows, '4000,"x\ny"']) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        flat, deep = (tl.read_csv(spark, str(tmp_path / f"{n}.csv")) for n in ("flat", "deep"))
        assert flat.rdd.getNumPartitions() > 3 and deep.rdd.getNumPartitions() > 3
        assert sorted((int(r.id), r.v) for r in flat.collect()) == [(k, f'a "b" {k}') for k in range(4000)]
        assert deep.count() == 4001 and deep.where("id = '4000'").head().v == "x\ny"
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_banner_with_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "q.csv").write_text('title\n\nid,v\n1,"a\nb"\n2,plain\n3,"c, ""d""\ne"\n')
    lead, data = tl.scan_with_banner(spark, str(tmp_path / "q.csv"), header_row=3)
    assert [tuple(r) for r in lead.orderBy("row_no").collect()] == [(1, "title"), (2, "")]
    assert [tuple(r) for r in data.orderBy("row_no").collect()] == [
        (4, "1", "a\nb"), (5, "2", "plain"), (6, "3", 'c, "d"\ne')]
