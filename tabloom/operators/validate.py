"""Data-quality checks: empty rates, outliers, mixed types, duplicate rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from tabloom.errors import InsufficientData
from tabloom.functions.cells import (
    as_text, dtype, group_value, is_blank, is_numeric, is_text, num, ref, round_exact,
)


def _may_hold_numbers(t: T.DataType) -> bool:
    return is_numeric(t) or is_text(t) or isinstance(t, T.BooleanType)


def _profile(df: DataFrame) -> tuple[list[Column], list[Column], list[Column]]:
    """For every column: the cell to count, the aggregates, and the line made of them."""
    cells, aggregates, lines = [], [F.count(F.lit(1)).alias("total")], []
    for i, name in enumerate(df.columns):
        t, c, none = dtype(df, name), F.col(f"c{i}"), F.lit(0).cast("bigint")
        if is_text(t):
            # 0 blank, 1 number, 2 text: worked out once per cell, then counted.
            kind = F.when(is_blank(df, name), 0).when(num(df, name).isNotNull(), 1).otherwise(2)
            cells.append(kind.alias(f"c{i}"))
            aggregates += [F.count_if(c == 1).alias(f"n{i}"), F.count_if(c == 2).alias(f"t{i}")]
            numbers, texts = F.col(f"n{i}"), F.col(f"t{i}")
        else:
            cells.append(ref(name).alias(f"c{i}"))
            aggregates.append(F.count(c).alias(f"f{i}"))
            filled = F.col(f"f{i}")
            numbers, texts = (filled, none) if _may_hold_numbers(t) else (none, filled)
        lines.append(F.struct(
            F.lit(name).alias("column"), F.col("total"), (F.col("total") - numbers - texts).alias("empty"),
            numbers.alias("numbers"), texts.alias("texts"),
        ))
    return cells, aggregates, lines


def profile(df: DataFrame) -> DataFrame:
    """``(column, total, empty, numbers, texts)`` for every column, in one pass."""
    cells, aggregates, lines = _profile(df)
    return df.select(*cells).agg(*aggregates).select(F.explode(F.array(*lines)).alias("line")).select("line.*")


def _percent(part: Column, total: Column) -> Column:
    return round_exact(F.try_divide(part.cast("double"), total.cast("double")) * 100.0, 1)


def _kinds() -> Column:
    return F.concat_ws(
        ",",
        F.when(F.col("empty") > 0, "empty"),
        F.when(F.col("numbers") > 0, "number"),
        F.when(F.col("texts") > 0, "string"),
    )


def _kind_count() -> Column:
    return sum((F.col(c) > 0).cast("int") for c in ("empty", "numbers", "texts"))


def empty_rates(df: DataFrame, threshold: float = 50) -> DataFrame:
    """``(column, total, empty, empty_pct, flagged)``; flagged at the threshold or above."""
    pct = _percent(F.col("empty"), F.col("total"))
    return profile(df).select(
        "column", "total", "empty", pct.alias("empty_pct"), (pct >= float(threshold)).alias("flagged")
    )


def type_kinds(df: DataFrame) -> DataFrame:
    """``(column, kinds, mixed)``: empty cells are a kind of their own."""
    return profile(df).select("column", _kinds().alias("kinds"), (_kind_count() > 1).alias("mixed"))


def _number_columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    names = list(df.columns) if columns is None else list(columns)
    return [c for c in names if _may_hold_numbers(dtype(df, c))]


def _numbers(df: DataFrame, names: list[str]) -> DataFrame:
    """``v0``, ``v1``, ...: the number in each of the columns."""
    return df.select(*[num(df, c).alias(f"v{i}") for i, c in enumerate(names)])


def _bucket(v: Column, bits: int) -> Column:
    """The value rounded to ``bits`` binary digits: never falls as ``v`` rises.

    Adding and taking away a large multiple rounds off the lower digits (Veltkamp's
    split). Values whose multiple would overflow share one bucket at each end.
    """
    inner = F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(1e290)), F.lit(-1e290)))  # both pass over a missing value
    wide = inner * float(2 ** (53 - bits) + 1)
    return wide - (wide - inner)


def _long(numbers: DataFrame) -> DataFrame:
    """``(at, v)``: every number with the place of its column, without an array per row."""
    columns = [F.col(c).alias(str(i)) for i, c in enumerate(numbers.columns)]
    long = numbers.select(*columns).unpivot([], [f"`{i}`" for i in range(len(columns))], "at", "v")
    return long.where(F.col("v").isNotNull()).select(F.col("at").cast("int").alias("at"), "v")


def _running(sizes: DataFrame, *order: str) -> DataFrame:
    """Lines with their column's ``n``, the wanted positions ``k1`` and ``k3``, and the rows ``before`` and ``upto`` them."""
    column = Window.partitionBy("at")
    return sizes.select(
        "*", F.sum("c").over(column).alias("n"), F.sum("c").over(column.orderBy(*order)).alias("upto"),
    ).select("*", (F.col("upto") - F.col("c")).alias("before"), F.expr("n div 4").alias("k1"), F.expr("(3 * n) div 4").alias("k3"))


def _holds(k: str) -> Column:
    return (F.col("before") <= F.col(k)) & (F.col(k) < F.col("upto"))


def _brackets(numbers: DataFrame) -> Column:
    """Per column the least and largest value of the buckets that hold its quartiles, as one scalar array.

    Buckets are values equal to 10 binary digits: one line per bucket is all that is shuffled.
    """
    counted = _long(numbers).select("at", "v", _bucket(F.col("v"), 10).alias("b")).groupBy("at", "b").agg(
        F.count(F.lit(1)).alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
    ends = [F.max(F.when(_holds(k), F.col(x))).alias(f"{x}{k[1]}") for k in ("k1", "k3") for x in ("low", "high")]
    found = _running(counted, "b").groupBy("at").agg(*ends)
    by_column = F.map_from_entries(F.collect_list(F.struct("at", F.struct("low1", "high1", "low3", "high3"))))
    places = F.array(*[F.lit(i) for i in range(len(numbers.columns))]).cast("array<int>")
    return found.agg(F.transform(places, lambda i: F.try_element_at(by_column, i))).scalar()


def _histogram(numbers: DataFrame) -> DataFrame:
    """``(at, part, x, c)``: counts of the values inside a column's brackets, in one scan.

    ``part`` and ``x`` sort like the values: parts 1 and 3 are the brackets, with one line per
    value; parts 0, 2 and 4 are one line each for what lies below, between and above.
    """
    v, t = F.col("v"), lambda name: F.col("t").getField(name)
    part = (
        F.when(v < t("low1"), 0).when(v <= t("high1"), 1).when(v < t("low3"), 2).when(v <= t("high3"), 3).otherwise(4)
    )
    placed = _long(numbers).select("at", "v", F.get(_brackets(numbers), F.col("at")).alias("t")).select("at", "v", part.alias("part"))
    value = F.when(F.col("part").isin(1, 3), v)
    return placed.select("at", "part", value.alias("x")).groupBy("at", "part", "x").agg(F.count(F.lit(1)).alias("c"))


def _exact_quartiles(numbers: DataFrame) -> DataFrame:
    """``(at, n, q1, q3)`` at positions ``n div 4`` and ``3n div 4`` of the sorted values.

    A first scan counts coarse buckets, which bracket both positions; a second scan counts what
    lies outside and makes a histogram of the values inside. A histogram of many distinct values is no
    task of its own either: the bucket of values equal to 31 binary digits that holds a
    position is found first, then the value in it, so a task sees four million lines of a column at most.
    """
    lines = _histogram(numbers).select("*", _bucket(F.col("x"), 31).alias("b"))
    sizes = lines.groupBy("at", "part", "b").agg(F.sum("c").alias("c"))
    target = _running(sizes, "part", "b").where((F.col("n") >= 4) & (_holds("k1") | _holds("k3"))).select(
        *[F.col(c).alias(f"t_{c}") for c in ("at", "part", "b", "n", "k1", "k3", "before")])
    # At most two targets per column are broadcast. Equality that takes empty cells too lets no
    # filter down into the histogram, which is so made once for both uses.
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in ("at", "part", "b")]
    inside = lines.join(F.broadcast(target), same[0] & same[1] & same[2])
    upto = F.sum("c").over(Window.partitionBy("at", "part", "b").orderBy("x"))
    ranked = inside.select(
        "at", "x", F.col("t_n").alias("n"), F.col("t_k1").alias("k1"), F.col("t_k3").alias("k3"),
        (F.col("t_before") + upto).alias("upto"), (F.col("t_before") + upto - F.col("c")).alias("before"))
    pick = lambda k: F.max(F.when(_holds(k), F.col("x")))
    found = ranked.groupBy("at", "n").agg(pick("k1").alias("q1"), pick("k3").alias("q3"))
    missed = F.raise_error(F.lit("a quartile lies outside its bracket")).cast("boolean")
    return found.where(F.when(F.col("q1").isNull() | F.col("q3").isNull(), missed).otherwise(True))


def _approximate_quartiles(numbers: DataFrame, accuracy: int) -> DataFrame:
    both = lambda v: F.percentile_approx(v, F.array(F.lit(0.25), F.lit(0.75)), F.lit(accuracy))
    each = [F.struct(F.lit(i).alias("at"), F.count(c).alias("n"), both(F.col(c)).alias("p")) for i, c in enumerate(numbers.columns)]
    return (
        numbers.agg(F.array(*each).alias("s")).select(F.inline("s")).where("n >= 4")
        .select("at", "n", F.col("p")[0].alias("q1"), F.col("p")[1].alias("q3"))
    )


def _quartiles(df: DataFrame, names: list[str], exact: bool, accuracy: int) -> DataFrame:
    if not names:
        return df.sparkSession.createDataFrame([], "at int, n bigint, q1 double, q3 double")
    numbers = _numbers(df, names)
    if not exact:
        return _approximate_quartiles(numbers, accuracy)
    return _exact_quartiles(numbers)


def _bounds(found: DataFrame, multiplier: float) -> DataFrame:
    spread = F.col("q3") - F.col("q1")
    return found.where(spread != 0).select(
        "at", "n", "q1", "q3", (F.col("q1") - float(multiplier) * spread).alias("lower"),
        (F.col("q3") + float(multiplier) * spread).alias("upper"),
    )


def _named(found: DataFrame, names: list[str], *fields: str | Column) -> DataFrame:
    labels = F.array(*[F.lit(c) for c in names]) if names else F.array().cast("array<string>")
    return found.select(F.element_at(labels, F.col("at") + 1).alias("column"), *fields)


def quartiles(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True, accuracy: int = 10_000
) -> DataFrame:
    """``(column, n, q1, q3)`` for columns with at least four numbers.

    The table is read twice; ``exact=False`` reads it once and takes approximate percentiles.
    """
    names = _number_columns(df, columns)
    return _named(_quartiles(df, names, exact, accuracy), names, "n", "q1", "q3")


def outlier_bounds(
    df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5, exact: bool = True,
    accuracy: int = 10_000,
) -> DataFrame:
    """``(column, n, q1, q3, lower, upper)``; columns with no spread are left out."""
    names = _number_columns(df, columns)
    bounds = _bounds(_quartiles(df, names, exact, accuracy), multiplier)
    return _named(bounds, names, "n", "q1", "q3", "lower", "upper")


def outliers(
    df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5, exact: bool = True,
    accuracy: int = 10_000,
) -> DataFrame:
    """``(column, outliers, lower, upper)``: numbers strictly outside the bounds, which are
    shown rounded to two digits. Columns without bounds are left out."""
    names = _number_columns(df, columns)
    return _outliers(df, names, _limits(df, names, multiplier, exact, accuracy))


def _outliers(df: DataFrame, names: list[str], limits: Column) -> DataFrame:
    if not names:
        return df.sparkSession.createDataFrame([], "column string, outliers bigint, lower double, upper double")
    cells = _numbers(df, names).withColumn("_limits", limits)
    limit = lambda i: F.col("_limits")[i]
    outside = [
        F.count_if((F.col(f"v{i}") < limit(i)["lower"]) | (F.col(f"v{i}") > limit(i)["upper"])).alias(f"n{i}")
        for i in range(len(names))
    ]
    counted = cells.agg(F.first("_limits").alias("_limits"), *outside)
    lines = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("outliers"), limit(i).alias("limit"))
                      for i, c in enumerate(names)])
    return counted.select(F.explode(lines).alias("line")).where("line.limit is not null").select(
        "line.column", "line.outliers", round_exact(F.col("line.limit.lower")).alias("lower"),
        round_exact(F.col("line.limit.upper")).alias("upper"))


def _limits(df: DataFrame, names: list[str], multiplier: float, exact: bool, accuracy: int) -> Column:
    """The bounds of all columns, in their order, as one scalar array; NULL without bounds."""
    bounds = _bounds(_quartiles(df, names, exact, accuracy), multiplier)
    by_column = F.map_from_entries(F.collect_list(F.struct("at", F.struct("lower", "upper"))))
    places = F.array(*[F.lit(i) for i in range(len(names))]).cast("array<int>")
    return bounds.agg(F.transform(places, lambda i: F.try_element_at(by_column, i))).scalar()


def outlier_rows(
    df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = 1.5, exact: bool = True,
    accuracy: int = 10_000, name: str = "outlier_columns",
) -> DataFrame:
    """Rows with an outlier, and the names of the columns where it is.

    The bounds, one line per column of the table, reach the rows as one scalar array.
    """
    names = _number_columns(df, columns)
    limits = _limits(df, names, multiplier, exact, accuracy)
    cells = F.array(*[F.struct(F.lit(c).alias("c"), num(df, c).alias("v")) for c in names])

    def outside(cell: Column, limit: Column) -> Column:
        return F.when((cell["v"] < limit["lower"]) | (cell["v"] > limit["upper"]), cell["c"])

    if not names:
        return df.withColumn(name, F.lit("")).where(F.lit(False))
    marked = df.withColumn("_limits", limits)
    hits = F.concat_ws(",", F.zip_with(cells, F.col("_limits"), outside))
    return marked.withColumn(name, hits).drop("_limits").where(ref(name) != "")


def _row_keys(df: DataFrame, empty_as: str | None = None) -> list[Column]:
    def key(name: str) -> Column:
        c = group_value(df, name)
        return F.coalesce(c, F.lit(empty_as)) if empty_as is not None and is_text(dtype(df, name)) else c

    return [key(c).alias(f"k{i}") for i, c in enumerate(df.columns)]


def _fingerprint(keys: Sequence[str]) -> Column:
    """Two 64-bit hashes of a row; where its cells are empty counts, as a hash passes over them."""
    cells = [c for k in keys for c in (F.col(k), F.col(k).isNull())]
    return F.struct(F.xxhash64(*cells), F.xxhash64(F.lit(1), *cells))


def duplicate_rows(df: DataFrame, empty_as: str | None = None) -> DataFrame:
    """One row ``(total, duplicates)``: rows beyond the first of each equal set.

    ``empty_as`` makes an empty cell equal to this text in text columns. Only fingerprints (16
    bytes a row) are shuffled and counted. Rows whose fingerprint occurs once are no
    duplicates; if there are others, the rows are read again, and those of such fingerprints
    are compared whole, so two rows with one fingerprint by chance are still two.
    """
    keys, names = _row_keys(df, empty_as), [f"k{i}" for i in range(len(df.columns))]
    marked = df.select(*keys).select("*", _fingerprint(names).alias("print"))
    prints = marked.groupBy("print").agg(F.count(F.lit(1)).alias("c"))
    counted = prints.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("total"), F.count_if(F.col("c") == 1).alias("single"))
    # No row passes, and none is moved, if all fingerprints occur once.
    rows = marked.where(counted.select(F.col("total") > F.col("single")).scalar())
    several = rows.join(prints.where("c > 1"), "print", "left_semi").groupBy(*names).agg(F.lit(1).alias("one"))
    found = several.agg(F.count(F.lit(1))).scalar()
    return counted.select("total", (F.col("total") - F.col("single") - found).alias("duplicates"))


def report(df: DataFrame, checks: Mapping[str, object], check_rows: bool = True) -> DataFrame:
    """``(check, column, metric, value, detail, passed)``, one line per check and column.

    ``checks`` holds ``empty``, ``empty_threshold`` (50), ``outliers``,
    ``outlier_multiplier`` (1.5), ``type_check`` and ``duplicates``. The table is read once for
    the empty and type checks, twice for the quartiles, once to count outliers and once for the
    fingerprints of rows.
    """
    if check_rows and (not df.columns or df.isEmpty()):
        raise InsufficientData("the table has no rows")

    def line(check: str, column: Column, metric: str, value: Column, detail: Column, passed: Column) -> Column:
        return F.struct(
            F.lit(check).alias("check"), column.alias("column"), F.lit(metric).alias("metric"),
            value.cast("double").alias("value"), detail.cast("string").alias("detail"), passed.alias("passed"),
        )

    parts, per_column = [], []
    if checks.get("empty"):
        pct = _percent(F.col("empty"), F.col("total"))
        per_column.append(line("empty", F.col("column"), "empty_pct", pct,
                               F.concat_ws("/", F.col("empty"), F.col("total")),
                               pct < float(checks.get("empty_threshold", 50))))
    if checks.get("type_check"):
        per_column.append(line("type_check", F.col("column"), "kinds", _kind_count(), _kinds(), _kind_count() <= 1))
    if per_column:
        told = profile(df)
        parts.append(told.select(F.explode(F.array(*per_column)).alias("line")).select("line.*"))
    if checks.get("outliers"):
        names = _number_columns(df, None)
        found = _outliers(df, names, _limits(df, names, checks.get("outlier_multiplier", 1.5), True, 0))
        shown = F.concat(F.lit("["), as_text(F.col("lower"), T.DoubleType()), F.lit(", "),
                         as_text(F.col("upper"), T.DoubleType()), F.lit("]"))
        parts.append(found.select(line("outliers", F.col("column"), "outliers", F.col("outliers"), shown,
                                       F.col("outliers") == 0).alias("line")).select("line.*"))
    if checks.get("duplicates"):
        none = F.lit(None).cast("string")
        parts.append(duplicate_rows(df).select(
            line("duplicates", none, "duplicate_rows", F.col("duplicates"), none, F.col("duplicates") == 0)
            .alias("line")).select("line.*"))
    if not parts:
        raise ValueError("no check selected")
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def issues(report_lines: DataFrame) -> DataFrame:
    """The lines of a report that did not pass."""
    return report_lines.where(~F.col("passed"))


def write_issues(report_lines: DataFrame, path: str) -> bool:
    """Write what did not pass, one folder per check; nothing is written if all passed.

    A report has a few lines per column of the table; it is worked out once and kept while
    they are looked at and written.
    """
    found = issues(report_lines).persist()
    try:
        if found.isEmpty():
            return False
        found.coalesce(1).write.partitionBy("check").json(path)
        return True
    finally:
        found.unpersist()
