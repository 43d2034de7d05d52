"""File order by numbers and requests, staged sinks, duplicates by fingerprints, quartiles in a bracket."""

import random

import pytest
from pyspark.sql import Observation, functions as F

import tabloom as tl
from tabloom.operators import rows, validate

NAMES = ["part-99998-x.parquet", "part-99999-x.parquet", "part-100000-x.parquet", "part-100001-y.parquet"]


def _folder(spark, path, names, start=0):
    for k, name in enumerate(names):
        out = path / f"tmp{k}"
        spark.range(start + 3 * k, start + 3 * k + 3, 1, 1).write.parquet(str(out))
        next(out.glob("part-*.parquet")).rename(path / name)
        for rest in out.iterdir():
            rest.unlink()
        out.rmdir()


def test_numbers_in_file_names(spark, tmp_path):
    _folder(spark, tmp_path, NAMES)
    df = spark.read.parquet(str(tmp_path))
    numbered = tl.with_row_index(df).orderBy("row_no").collect()
    assert [r.id for r in numbered] == list(range(12))
    assert [r.id for r in tl.source_range(df, 6, 8).orderBy("row_no").collect()] == [5, 6, 7]
    assert [r.id for r in tl.keep_first(df.withColumn("k", F.lit(1)), ["k"]).collect()] == [0]
    assert [r.id for r in tl.keep_last(df.withColumn("k", F.lit(1)), ["k"]).collect()] == [11]


def test_key_of_a_name():
    names = ["a", "a1", "a01", "a2b", "a10", "a10b3", "b", "b-7-x", "b-007-x", "b-99999", "b-100000", "0", "00", "c.d.9", "c.d.10"]
    key = rows._natural
    assert sorted(["b-100000", "b-99999", "b-7-x"], key=lambda n: key(f"d/{n}")) == ["b-7-x", "b-99999", "b-100000"]
    assert len({key(f"d/{n}") for n in names}) == len(names)


def test_key_in_spark(spark):
    names = [f"file:/d/{n}" for n in ["a", "a1", "a01", "a2b", "a10", "b-99999.c000.snappy", "b-100000", "0", "00", "c.d.9", "é1"]]
    found = spark.createDataFrame([(n,) for n in names], "p string").select("p", rows.natural_key(F.col("p"))).collect()
    assert all(r[1] == rows._natural(r[0]) for r in found)


def test_order_of_the_request(spark, tmp_path):
    for name, start in (("b-c", 0), ("b", 100), ("a x", 200)):
        (tmp_path / name).mkdir()
        _folder(spark, tmp_path / name, NAMES[1:3], start)
    paths = [str(tmp_path / n) for n in ("b", "a x", "b-c")]
    merged = tl.merge_paths(spark, paths, same_layout=True)
    found = [r.id for r in tl.with_row_index(merged).orderBy("row_no").collect()]
    assert found == [*range(100, 106), *range(200, 206), *range(6)]
    assert tl.keep_first(merged.withColumn("k", F.lit(1)), ["k"]).head().id == 100
    files = [str(tmp_path / "b" / NAMES[2]), str(tmp_path / "b" / NAMES[1])]
    turned = tl.merge_paths(spark, files, same_layout=True)
    assert [r.id for r in tl.with_row_index(turned).orderBy("row_no").collect()] == [103, 104, 105, 100, 101, 102]


def test_staged_sink(spark, tmp_path):
    out = tmp_path / "out"
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    df = spark.range(0, 50, 1, 2).mapInArrow(count, "id long")
    assert tl.write_staged(df, str(out / "a")) == 50 and runs.value == 50
    assert spark.read.parquet(str(out / "a")).count() == 50
    with pytest.raises(tl.TableError):
        tl.write_staged(df, str(out / "a"))
    assert tl.write_staged(spark.range(5).where("id > 9"), str(out / "b")) is None
    with pytest.raises(Exception):
        tl.write_staged(spark.range(5).select(F.raise_error(F.lit("no")).alias("x")), str(out / "c"))
    seen = Observation()
    kept = tl.keep_first(spark.range(5).observe(seen, F.count(F.lit(1)).alias("rows")), ["id"], order_by=["id"])
    assert tl.write_staged(kept, str(out / "d"), wanted=lambda n: n["rows"] < n["all"], watched={"all": seen}) is None
    assert tl.write_staged(spark.range(3).selectExpr("id", "cast(id as string) k"), str(out / "e"), format="csv", header=True) == 3
    assert sorted(p.name for p in out.iterdir()) == ["a", "e"]


def _duplicates(table):
    return len(table), len(table) - len(set(table))


def test_duplicates_with_colliding_fingerprints(spark, monkeypatch):
    rng = random.Random(2)
    table = [(rng.choice([None, 0.0, 1.5]), rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for _ in range(200)]
    df = spark.createDataFrame(table, "x double, y string, z int").repartition(3)
    alone = spark.range(100)
    assert tuple(tl.duplicate_rows(df).head()) == _duplicates(table) and tuple(tl.duplicate_rows(alone).head()) == (100, 0)
    for weak in (lambda keys: F.lit(7), lambda keys: F.crc32(F.coalesce(F.col(keys[0]).cast("string"), F.lit("")).cast("binary")) % 2):
        monkeypatch.setattr(validate, "_fingerprint", weak)
        assert tuple(tl.duplicate_rows(df).head()) == _duplicates(table) and tuple(tl.duplicate_rows(alone).head()) == (100, 0)


def test_empty_cells_count_in_fingerprints(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), (None, None)], "x string, y string")
    prints = df.select(validate._fingerprint(["x", "y"]).alias("p")).distinct().count()
    assert prints == 3 and tuple(tl.duplicate_rows(df).head()) == (4, 1)


@pytest.mark.parametrize("n", [4, 5, 7, 11, 64, 999, 1000])
def test_quartiles_of_small_tables(spark, n):
    rng = random.Random(n)
    values = [rng.choice([rng.gauss(0, 1), float(rng.randrange(5))]) for _ in range(n)]
    found = tl.quartiles(spark.createDataFrame([(v,) for v in values], "v double").repartition(3)).head()
    assert (found.n, found.q1, found.q3) == (n, sorted(values)[n // 4], sorted(values)[3 * n // 4])


def test_quartiles_of_many_distinct_values(spark):
    """2^22 neighbouring values, skewed ones and ties, in many tasks: more than a sketch can hold."""
    n = 1 << 22
    df = spark.range(0, n, 1, 16).select(
        (F.lit(1.0) + F.pmod(F.col("id") * 2654435761, F.lit(n)) * 2.0**-52).alias("dense"),
        F.pow(F.lit(10.0), (F.pmod(F.col("id") * 40503, F.lit(n)) / n * 600 - 300)).alias("wide"),
        F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.pmod(F.col("id") * 40503, F.lit(n)).cast("double")).alias("ties"))
    found = {r.column: (r.q1, r.q3) for r in tl.quartiles(df).collect()}
    for name in df.columns:
        ranked = df.select(name).sort(name).rdd.map(lambda r: r[0]).zipWithIndex().filter(lambda p: p[1] in (n // 4, 3 * n // 4)).collect()
        assert found[name] == tuple(v for v, _ in sorted(ranked, key=lambda p: p[1])), name


def test_banner_of_several_pieces(spark):
    """A tail of 2,500 rows, which lie in four pieces, ends each key's output whole and once."""
    import tabloom as tl

    rows = [(f"k{n % 3}", n) for n in range(1, 4001)]
    numbered = spark.createDataFrame(rows, "key string, row_no long").repartition(4)
    sections = tl.split_sections(numbered, header_row=3, tail=(1501, 4000))
    found = tl.attach_banner(sections, "key").orderBy("split_key", "place", "row_no").collect()
    for k in ("k0", "k1", "k2"):
        own = [n for key, n in rows if key == k and 3 < n <= 1500]
        assert [r["row_no"] for r in found if r["split_key"] == k] == [1, 2, 3, *own, *range(1501, 4001)]
