"""Compare a query with its SQL counterpart run by DuckDB in this process."""

import datetime as dt
import decimal
import math

import duckdb

from registry.sources import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, dt.date)):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return repr(value)


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(lines, key=repr)


def spark_table(df):
    return _table(df.columns, [tuple(r) for r in df.collect()])


def sql_table(con, sql):
    cursor = con.execute(sql)
    return _table([d[0] for d in cursor.description], cursor.fetchall())


_FAMILIES = {
    "int": ("tinyint", "smallint", "int", "integer", "bigint"), "real": ("float", "double"),
    "text": ("string", "varchar"), "flag": ("boolean",), "time": ("timestamp", "timestamp_ntz"),
}


def _family(name):
    name = name.lower()
    return next((family for family, names in _FAMILIES.items() if name in names), name)


def type_difference(df, con, sql):
    got = {name: _family(kind) for name, kind in df.dtypes}
    want = {r[0]: _family(r[1]) for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    return None if got == want else f"types {set(got.items()) ^ set(want.items())}"


def difference(df, con, sql):
    """None when equal, else a short description."""
    (names, got), (wanted_names, want) = spark_table(df), sql_table(con, sql)
    if names != wanted_names:
        return f"columns {names} != {wanted_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{a} != {b}"
    return type_difference(df, con, sql)
