"""Every registered query against its SQL counterpart, on the smallest tables."""

import pytest

import oracle
import registry

SF = "/root/testdata/sf0.001"
# Nothing matches these by definition.
EMPTY = {"F15_bad_target", "F13_no_conditions", "X2_range_beyond"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    assert oracle.difference(df, con, registry.ORACLES[name]) is None
    assert (con.execute(f"SELECT count(*) FROM ({registry.ORACLES[name]})").fetchall()[0][0] == 0) == (name in EMPTY)


def test_differences_are_found(spark, con):
    df = spark.read.parquet(f"{SF}/nation.parquet")
    assert oracle.difference(df, con, "SELECT * FROM nation") is None
    for wrong in ("SELECT * FROM nation WHERE n_nationkey > 0", "SELECT * REPLACE ('x' AS n_name) FROM nation",
                  "SELECT n_nationkey, n_name FROM nation", "SELECT * REPLACE (n_nationkey::double AS n_nationkey) FROM nation"):
        assert oracle.difference(df, con, wrong) is not None


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
