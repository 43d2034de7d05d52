"""Operators on small literal tables, against plain Python on the same rows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

import tabloom as tl
from tabloom.functions.cells import round_exact
from tabloom.functions.predicates import OPERATORS, predicate

ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "  ", None), (4, "　", "b"), (5, "0", "b"), (6, " 12 ", "(空)"),
    (7, "1e3", "a/b"), (8, "1d", "a:b"), (9, "abc", None), (10, "-5.5", "b"), (11, "ABC", "a"), (12, "None", "b"),
]


@pytest.fixture(scope="module")
def messy(spark):
    return spark.createDataFrame(ROWS, "id bigint, v string, k string").cache()


def _as_float(cell):
    try:
        return float(cell or 0)
    except (TypeError, ValueError):
        return None


def _expected(op, cell, target, target2=None):
    shown = "" if cell is None else str(cell)
    if op in ("eq", "neq"):
        return (shown == target) == (op == "eq")
    if op in ("contains", "not_contains"):
        found = target.lower() in (str(cell) if cell else "").lower()
        return found == (op == "contains")
    if op in ("is_empty", "not_empty"):
        return (shown.strip() == "") == (op == "is_empty")
    number = _as_float(cell)
    if number is None or math.isnan(number):
        return False
    if op == "between":
        return float(target) <= number <= float(target2)
    return {"gt": number > float(target), "lt": number < float(target),
            "gte": number >= float(target), "lte": number <= float(target)}[op]


TARGETS = ["0", "12", "-1", "1000", "0.5"]
WORDS = ["", "a", "ABC", "0", "None", "n", " "]


def _matches(df, conditions):
    """Per condition the ids that match, all conditions in one job."""
    tests = [F.coalesce(predicate(df, [c]), F.lit(False)).alias(f"m{i}") for i, c in enumerate(conditions)]
    rows = df.select("id", *tests).collect()
    return [{r.id for r in rows if r[f"m{i}"]} for i in range(len(conditions))]


def test_text_conditions(messy):
    conditions = [
        {"column": "v", "operator": op, "value": target, "value2": "20"} for op in OPERATORS
        for target in (WORDS if op in ("eq", "neq", "contains", "not_contains") else TARGETS)]
    for cond, got in zip(conditions, _matches(messy, conditions)):
        assert got == {i for i, v, _ in ROWS if _expected(cond["operator"], v, cond["value"], "20")}, cond
    for cond in conditions[::9]:
        got = {r.id for r in tl.filter_rows(messy, [cond]).collect()}
        rest = {r.id for r in tl.unmatched_rows(messy, [cond]).collect()}
        assert got | rest == {r[0] for r in ROWS} and not got & rest


TYPED = [(1, None, None, None), (2, 0, 0.0, False), (3, 5, 5.0, True), (4, -3, -2.5, None),
         (5, 12, float("nan"), True), (6, 1000, 1e20, False), (7, 7, 0.1, None)]


def test_typed_conditions(spark):
    df = spark.createDataFrame(TYPED, "id int, i int, d double, b boolean")
    words = ["5", "0", "0.5", "-2.5", "0.1", "5.0", "", "True", "nan", "100000000000000000000", "1e+20"]
    numbers = TARGETS + ["-2.5", "4.5", "99999999999"]
    conditions = [
        {"column": column, "operator": op, "value": target, "value2": "20"}
        for op, column in itertools.product(OPERATORS, ("i", "d", "b"))
        for target in (words if op in ("eq", "neq", "contains", "not_contains") else numbers)]
    for cond, got in zip(conditions, _matches(df, conditions)):
        at = {"i": 1, "d": 2, "b": 3}[cond["column"]]
        # A whole double is shown the way a sheet holds it, without a fraction.
        cells = {r[0]: int(r[at]) if isinstance(r[at], float) and r[at] == r[at] and r[at] == int(r[at]) and
                 abs(r[at]) < 1e16 else r[at] for r in TYPED}
        want = {i for i, cell in cells.items() if _expected(cond["operator"], cell, cond["value"], "20")}
        assert got == want, cond


def test_dates_are_not_numbers(spark):
    df = spark.sql("SELECT * FROM VALUES (1, date'2020-01-02'), (2, cast(null AS date)) AS t(id, d)")
    ids = lambda **c: {r.id for r in tl.filter_rows(df, [{"column": "d", **c}]).collect()}
    assert ids(operator="gt", value="5") == set()
    assert ids(operator="lt", value="5") == {2}
    assert ids(operator="eq", value="2020-01-02") == {1}
    assert ids(operator="eq", value="2020-1-2") == set()
    assert ids(operator="neq", value="2020-01-02") == {2}


def test_logic_and_errors(messy):
    a = {"column": "v", "operator": "eq", "value": "0"}
    b = {"column": "k", "operator": "eq", "value": "a"}
    assert {r.id for r in tl.filter_rows(messy, [a, b], "OR").collect()} == {1, 2, 5, 11}
    assert tl.filter_rows(messy, [a, b]).collect() == []
    assert tl.filter_rows(messy, []).count() == 12 and tl.filter_rows(messy, [], "OR").count() == 0
    with pytest.raises(tl.MissingColumn):
        tl.filter_rows(messy, [{"column": "x", "operator": "eq", "value": ""}])
    with pytest.raises(tl.TableError):
        tl.filter_rows(messy, [{"column": "v", "operator": "like", "value": ""}])
    with pytest.raises(tl.TableError):
        tl.normalise_conditions([{"column": "v", "operator": "gt", "value": " "}])
    for op in ("gt", "lt", "gte", "lte", "between"):
        assert tl.filter_rows(messy, [{"column": "v", "operator": op, "value": "x", "value2": "1"}]).count() == 0
    counts = tl.filter_counts(messy, [{"column": "v", "operator": "lt", "value": "1"}]).head()
    assert (counts.total, counts.matched) == (12, 4)


FORMULAS = [
    "{a} + {b} * 2 - -{c}", "{a} / {b}", "{a} // {b}", "{a} % {b}", "{a} % -{b}", "({a} - {b}) // {c}", "abs({a}) ** 2",
    "2 ** {c}", "{a} > {b}", "{a} < {b} <= {c}", "{a} if {b} else {c}", "{a} and {b}", "{a} or {b}", "not {a}",
    "max({a}, {b}, {c}) - min({a}, {b})", "round({a} / 3)", "round({a} / 7, 3)", "int({a} / 2)", "float({b})",
    "pow(abs({a}), 0.5)", "{a} / ({b} - {b})", "1e308 * 10 * {a}", "({a} + 0.1) // 0.1", "0 ** ({a} - {b})",
    "{a} == {b}", "{a} != {b} and ({a} // {b}) % 3",
]


def test_formulas_match_python(spark):
    rng = random.Random(7)
    rows = [(i, rng.randint(-20, 20), round(rng.uniform(-9, 9), 2), rng.choice([0, 1, 2, 3, None])) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, a int, b double, c int")
    calc = [{"name": f"f{i}", "expression": text} for i, text in enumerate(FORMULAS)]
    for r in tl.column_ops(df, keep=["id"], calc=calc).collect():
        _, a, b, c = rows[r.id]
        for i, text in enumerate(FORMULAS):
            source = text.replace("{a}", f"({a or 0})").replace("{b}", f"({b or 0})").replace("{c}", f"({c or 0})")
            try:
                value = float(eval(source, {}, {}))  # fixed formulas above, on numbers only
                want = round(value, 2) if value != int(value) else int(value)
            except (ArithmeticError, ValueError, TypeError):
                want = None
            assert r[f"f{i}"] == want, (source, r[f"f{i}"], want)


def test_formula_failures(spark, messy):
    calc = lambda text: [{"name": "x", "expression": text}]
    for bad in ("{v} + remark", "{v} *", "__import__('os')", "[1][0]", "'a'", "{nope} + 1", "abs({id}, 2)", "round({id}, {id})",
                "{id}.real", "lambda: 1", "(1,)[0]", "1 if", "max({id})"):
        assert {r.x for r in tl.column_ops(messy, ["id"], calc=calc(bad)).collect()} == {None}, bad
        with pytest.raises(tl.FormulaError):
            tl.column_ops(messy, ["id"], calc=calc(bad), strict=True)
    got = {r.id: r.x for r in tl.column_ops(messy, ["id"], calc=calc("{v} * 2")).collect()}
    assert got == {1: 0, 2: 0, 3: None, 4: None, 5: 0, 6: 24, 7: 2000, 8: None, 9: None, 10: -11, 11: None, 12: None}


def test_columns(spark):
    df = spark.createDataFrame([(1, "x", 2.5)], "a int, `b.c` string, d double")
    out = tl.column_ops(df, keep=["a", "b.c", "zz"], order=["zz", "b.c", "d", "a"], renames={"a": "d"},
                        calc=[{"name": "e", "expression": "{d} * 2"}, {"name": "f", "expression": "{e} + 1"}])
    assert out.columns == ["zz", "b.c", "d", "e", "f"]
    assert tuple(out.head()) == ("", "x", 1, 5.0, None)
    assert tl.column_ops(df).columns == df.columns


KEYED = [(i, random.Random(i).choice(["x", "y", None]), random.Random(i * 7).choice([1, 2, None])) for i in range(60)]


@pytest.mark.parametrize("keep", ["first", "last"])
@pytest.mark.parametrize("columns", [["k"], ["k", "n"], ["n", "missing"]])
def test_dedup(spark, keep, columns):
    df = spark.createDataFrame(KEYED, "id int, k string, n int").repartition(5)
    names = [c for c in columns if c != "missing"]
    chosen, first = {}, {}
    for row in KEYED:
        key = tuple(row[{"k": 1, "n": 2}[c]] for c in names)
        first.setdefault(key, row[0])
        if keep == "last" or key not in chosen:
            chosen[key] = row
    kept = tl.dedup(df, columns, keep, order_by=["id"])
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(chosen.values(), key=str)
    removed = tl.removed_rows(df, columns, keep, order_by=["id"])
    both = sorted(tuple(r) for r in kept.unionByName(removed).collect())
    assert both == sorted(KEYED)
    counts = tl.dedup_counts(df, columns).head()
    assert tuple(counts) == (60, len(chosen), 60 - len(chosen))
    if keep == "last":
        placed = tl.keep_last(df, columns, ["id"], position="at").orderBy("at.id").collect()
        assert [r.id for r in placed] == [chosen[k][0] for k in sorted(chosen, key=first.get)]
    groups = tl.duplicate_groups(df, columns)
    assert groups.columns == names + ["n_2" if "n" in names else "n"]
    sizes = {tuple(r)[:-1]: r[-1] for r in groups.collect()}
    assert sum(sizes.values()) - len(sizes) == counts.removed


def test_dedup_key_rules(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a")], "n int, s string")
    assert sorted(map(tuple, tl.keep_first(df).collect())) == [(1, "a"), (2, "a")]
    with pytest.raises(tl.TableError):
        tl.keep_first(df, ["zz"])


def test_merge(spark):
    one = spark.createDataFrame([(1, "a")], "id int, name string")
    two = spark.createDataFrame([("b", 2.5, True), ("c", None, False)], "x string, y double, z boolean")
    empty = spark.createDataFrame([], "").select()
    merged = tl.merge_by_position([empty, one, two, one], source_no="no")
    assert merged.columns == ["id", "name", "Col2", "no"]
    assert sorted(map(tuple, merged.collect()), key=str) == sorted(
        [("1", "a", None, 2), ("b", "2.5", True, 3), ("c", None, False, 3), ("1", "a", None, 4)], key=str)
    named = tl.merge_by_name([one, two.withColumnRenamed("x", "name")])
    assert named.columns == ["id", "name", "y", "z"] and named.count() == 3
    with pytest.raises(tl.InsufficientData):
        tl.merge_by_position([empty, empty])
    assert tuple(tl.merge_summary([one, empty, two]).head()) == (3, 3)
    wide = tl.merge_by_position([one] * 37)
    assert wide.count() == 37


def test_distribution(messy):
    counts = {r.value: r.n for r in tl.value_counts(messy, "k").collect()}
    assert counts == {"a": 3, "(空)": 3, "b": 4, "a/b": 1, "a:b": 1}
    shares = tl.share_table(messy, "k").collect()
    assert [(r.value, r.share) for r in shares] == [
        ("b", "33.3%"), ("(空)", "25.0%"), ("a", "25.0%"), ("a/b", "8.3%"), ("a:b", "8.3%")]
    assert {r.value: len(r.bar) for r in tl.bars(messy, "k").collect()} == {
        v: int(n / 4 * 12) for v, n in counts.items()}
    assert tuple(tl.distribution_totals(messy, "k").head()) == (5, 12)
    assert {r.value for r in tl.search_values(tl.value_counts(messy, "k"), "a").collect()} == {"a", "a/b", "a:b"}
    order = [r.value for r in tl.group_order(messy, "k", row_no="id").collect()]
    assert order == ["a", "(空)", "b", "a/b", "a:b"]


@pytest.mark.parametrize("how", ["count", "sum", "avg", "min", "max"])
def test_pivot(messy, how):
    cells = {}
    for i, v, k in ROWS:
        cells.setdefault((k or "(空)", "odd" if i % 2 else "even"), []).append(v)
    expected = {}
    for key, values in cells.items():
        numbers = [float(v) for v in values if v is not None and _is_number(v)]
        expected[key] = {
            "count": len(values), "sum": round(sum(numbers), 2),
            "avg": round(sum(numbers) / len(numbers), 2) if numbers else 0,
            "min": min(numbers, default=0), "max": max(numbers, default=0)}[how]
    df = messy.withColumn("side", F.when(F.col("id") % 2 == 1, "odd").otherwise("even"))
    rows = sorted({k for k, _ in expected})
    table = tl.crosstab(df, "k", "side", "v", how)
    assert table.columns == ["k \\ side", "even", "odd", "合计"]
    want = [(r, *[expected.get((r, c), 0) for c in ("even", "odd")]) for r in rows]
    want = [(*line, line[1] + line[2]) for line in want]
    want.append(("合计", *[sum(line[i] for line in want) for i in (1, 2, 3)]))
    assert [tuple(r) for r in table.collect()] == want
    long = {(r.kind, r.row_key, r.col_key): r.cell for r in tl.pivot_long(df, "k", "side", "v", how).collect()}
    assert {(r, c): v for (kind, r, c), v in long.items() if kind == "cell"} == expected
    assert [long["row_total", r, "合计"] for r in rows] == [line[3] for line in want[:-1]]
    assert long["col_total", "合计", "odd"] == want[-1][2] and long["grand_total", "合计", "合计"] == want[-1][3]


def _is_number(text):
    try:
        return not math.isnan(float(text))
    except ValueError:
        return False


def test_pivot_errors(spark, messy):
    empty = messy.where("false")
    with pytest.raises(tl.InsufficientData):
        tl.crosstab(empty, "k", "id", "nope")
    with pytest.raises(tl.InsufficientData):
        tl.crosstab(empty, "k", "id", "v")
    with pytest.raises(tl.InsufficientData):
        tl.pivot_long(empty, "k", "id", "v", check_rows=True)
    with pytest.raises(tl.MissingColumn):
        tl.crosstab(messy, "k", "id", "nope")
    with pytest.raises(tl.TableError):
        tl.pivot_cells(messy, "k", "id", "v", "median")
    spark.conf.set("spark.sql.pivotMaxValues", "3")
    try:
        with pytest.raises(tl.TableError):
            tl.crosstab(messy, "k", "id", "v")
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")


def _quartile_cases():
    rng = random.Random(3)
    for n in (3, 4, 5, 6, 7, 8, 9, 100, 1001):
        yield [rng.randint(-5, 5) * 1.0 for _ in range(n)]
        yield [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(n)]
        yield [1e15 + rng.randint(0, 1000) for _ in range(n)]
        yield [rng.choice([7.0, 7.0, 7.0, rng.random()]) for _ in range(n)]
        yield [1.0 + i * 2.0**-52 for i in range(n)]
    yield [math.inf, -math.inf, 1.0, 2.0, 3.0, 1e308, -1e308, 5e-324, 0.0, -0.0]


def test_quartiles_are_exact(spark):
    cases = list(_quartile_cases())
    height = max(map(len, cases))
    rows = [tuple(c[i] if i < len(c) else None for c in cases) for i in range(height)]
    random.Random(1).shuffle(rows)
    names = [f"c{i}" for i in range(len(cases))]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(4)
    got = {r.column: (r.n, r.q1, r.q3) for r in tl.quartiles(df).collect()}
    for name, case in zip(names, cases):
        n, v = len(case), sorted(case)
        assert got.get(name) == ((n, v[n // 4], v[3 * n // 4]) if n >= 4 else None), name


def test_validate(spark, messy):
    profile = {r.column: r for r in tl.profile(messy).collect()}
    assert (profile["v"].empty, profile["v"].numbers, profile["v"].texts) == (4, 4, 4)
    assert (profile["k"].empty, profile["id"].numbers) == (2, 12)
    rates = {r.column: (r.empty_pct, r.flagged) for r in tl.empty_rates(messy, 33.3).collect()}
    assert rates == {"id": (0.0, False), "v": (33.3, True), "k": (16.7, False)}
    kinds = {r.column: (r.kinds, r.mixed) for r in tl.type_kinds(messy).collect()}
    assert kinds == {"id": ("number", False), "v": ("empty,number,string", True), "k": ("empty,string", True)}
    twice = messy.select("v").union(messy.select("v"))
    assert tuple(tl.duplicate_rows(twice).head()) == (24, 12)
    assert tuple(tl.duplicate_rows(messy.select("v").where("id IN (1, 12)"), empty_as="None").head()) == (2, 1)
    with pytest.raises(tl.InsufficientData):
        tl.report(messy.where("false"), {"empty": True})


def test_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 100.0, -50.0]
    df = spark.createDataFrame([(v, 5.0, str(v) if v < 50 else "n/a", None) for v in values],
                               "a double, flat double, s string, none double")
    v = sorted(values)
    q1, q3 = v[9 // 4], v[27 // 4]
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    got = {r.column: (r.outliers, r.lower, r.upper) for r in tl.outliers(df).collect()}
    assert got["a"] == (sum(x < low or x > high for x in values), round(low, 2), round(high, 2))
    assert set(got) == {"a", "s"} and got["s"][0] == 1
    hits = {r.a: r.outlier_columns for r in tl.outlier_rows(df).collect()}
    assert hits == {100.0: "a", -50.0: "a,s"}
    rough = {r.column: r.outliers for r in tl.outliers(df, exact=False).collect()}
    assert set(rough) == {"a", "s"}
    assert tl.outliers(df.select(F.lit("x").alias("t"))).collect() == []
    assert tl.outlier_rows(df.select(F.lit("x").alias("t"))).collect() == []


def test_row_ranges(spark):
    df = spark.createDataFrame([("a", None, "c", "d"), (None, None, None, "d"), ("e", "f", "g", "h")],
                               "w string, x string, y string, z string").coalesce(1)
    numbered = tl.with_row_index(df)
    assert [r.row_no for r in numbered.orderBy("row_no").collect()] == [1, 2, 3]
    preview = lambda a, b: tl.row_range_preview(numbered, a, b).head().preview
    assert preview(1, 3) == "Row1: a, c; Row2; Row3: e, f, g"
    assert preview(1, 4) == "" and preview(0, 1) == "" and preview(2, 1) == ""
    assert tl.row_range(numbered, 2, 3).count() == 2 and tl.row_range(numbered, 2, 4).count() == 0


def test_sections(spark):
    rows = [(f"t{i}",) for i in range(1, 11)]
    numbered = tl.with_row_index(spark.createDataFrame(rows, "c string").coalesce(1))
    sections = lambda **k: {r.row_no: r.section for r in tl.split_sections(numbered, **k).collect()}
    assert sections(header_row=3, tail=(9, 10)) == {
        1: "lead", 2: "lead", 3: "header", **{i: "data" for i in range(4, 9)}, 9: "tail", 10: "tail"}
    assert set(sections(header_row=3, tail=(9, 11)).values()) == {"lead", "header", "data"}
    assert 9 not in sections(header_row=3, tail=(9, 11))
    assert sections(header_row=3, include_lead=False)[3] == "header" and 1 not in sections(header_row=3, include_lead=False)
    # A tail range reaching into the lead rows starts after the header.
    assert sections(header_row=3, tail=(1, 5)) == {
        1: "lead", 2: "lead", 3: "header", 4: "tail", 5: "tail", **{i: "data" for i in range(6, 11)}}


def test_round_with_any_digits(spark):
    values = [0.1234567885, 2.5, 3.5, -2.5, 1e-9, 123456.789, 1.005, 250.0, 350.0, -250.0, 149.99, 1e15, 0.0, 98765.4321, 5e-10, 2**52 + 0.5]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (-3, -2, -1, 0, 1, 2, 5, 7, 8, 9, 12, 15):
        found = [r[0] for r in df.select(round_exact(F.col("x"), digits)).collect()]
        assert found == [round(v, digits) + 0.0 for v in values], digits
