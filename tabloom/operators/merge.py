"""Append tables, by position or by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tabloom.errors import InsufficientData, TableError
from tabloom.functions.cells import as_text, ref
from tabloom.functions.names import normalise_headers
from tabloom.operators.rows import address_struct
from tabloom.sources.tables import scan, table_paths

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_REAL = (T.FloatType, T.DoubleType)
# Digits that the largest value of a whole type has.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}


def _common_type(types: list[T.DataType]) -> T.DataType:
    """Type of a merged column: equal types stay, whole numbers and doubles widen, else text."""
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(isinstance(t, _WHOLE) for t in types):
        return max(types, key=lambda t: _WHOLE.index(type(t)))
    if all(isinstance(t, (T.DecimalType, *_WHOLE)) for t in types):
        as_decimals = [t if isinstance(t, T.DecimalType) else T.DecimalType(_DIGITS[type(t)], 0) for t in types]
        scale = max(t.scale for t in as_decimals)
        digits = max(t.precision - t.scale for t in as_decimals) + scale
        return T.DecimalType(digits, scale) if digits <= 38 else T.StringType()
    # 64-bit whole numbers do not all fit a double, so they widen to text with the rest.
    if all(isinstance(t, _WHOLE[:3] + _REAL) for t in types):
        return T.DoubleType()
    return T.StringType()


def _as(c: Column, source: T.DataType, target: T.DataType) -> Column:
    if source == target:
        return c
    return as_text(c, source) if isinstance(target, T.StringType) else c.cast(target)


def _balanced(frames: list[DataFrame], union: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """Union as a balanced tree, so that the plan's depth grows with log(inputs)."""
    while len(frames) > 1:
        pairs = [frames[i : i + 2] for i in range(0, len(frames), 2)]
        frames = [union(*pair) if len(pair) == 2 else pair[0] for pair in pairs]
    return frames[0]


def _non_empty(frames: Sequence[DataFrame]) -> list[tuple[int, DataFrame]]:
    kept = [(i, df) for i, df in enumerate(frames, start=1) if df.columns]
    if not kept:
        raise InsufficientData("no input has any data")
    return kept


def _extras(df: DataFrame, number: int, source_no: str | None, address: str | None) -> list[Column]:
    """The input's number and the row's place, worked out on the input before the union."""
    numbers = [] if source_no is None else [F.lit(number).alias(source_no)]
    return numbers + ([] if address is None else [address_struct(df, number).alias(address)])


def merge_by_position(frames: Sequence[DataFrame], source_no: str | None = None, address: str | None = None) -> DataFrame:
    """Append under the first non-empty input's header; later headers are dropped unread.

    Narrower inputs end in empty cells, wider ones bring extra ``Col{i}`` columns. Inputs
    without columns are skipped. Nothing is deduplicated. ``source_no`` adds the input's
    number. ``address`` adds a column that is unique per row and sorts like inputs and their
    rows lie: give it as ``order_by`` to remove duplicates, or to ``with_row_index``. A union
    has no order without it.
    """
    numbered = _non_empty(frames)
    width = max(len(df.columns) for _, df in numbered)
    names = normalise_headers(
        numbered[0][1].columns + [None] * (width - len(numbered[0][1].columns))
    )
    types = [
        _common_type([df.schema[i].dataType for _, df in numbered if i < len(df.columns)])
        for i in range(width)
    ]

    def shaped(df: DataFrame, number: int) -> DataFrame:
        cells = []
        for i, (name, target) in enumerate(zip(names, types)):
            if i < len(df.columns):
                cell = _as(ref(df.columns[i]), df.schema[i].dataType, target)
            else:
                cell = F.lit(None).cast(target)
            cells.append(cell.alias(name))
        return df.select(*cells, *_extras(df, number, source_no, address))

    return _balanced([shaped(df, i) for i, df in numbered], DataFrame.union)


def merge_by_name(frames: Sequence[DataFrame], source_no: str | None = None, address: str | None = None) -> DataFrame:
    """Append matching columns by name; a column missing from an input is empty there."""
    numbered = _non_empty(frames)
    types: dict[str, list[T.DataType]] = {}
    for _, df in numbered:
        for field in df.schema:
            types.setdefault(field.name, []).append(field.dataType)
    common = {name: _common_type(found) for name, found in types.items()}

    def shaped(df: DataFrame, number: int) -> DataFrame:
        cells = [_as(ref(f.name), f.dataType, common[f.name]).alias(f.name) for f in df.schema]
        return df.select(*cells, *_extras(df, number, source_no, address))

    return _balanced(
        [shaped(df, i) for i, df in numbered],
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
    )


def merge_frames(
    frames: Sequence[DataFrame], by: str = "position", source_no: str | None = None, address: str | None = None,
) -> DataFrame:
    if by not in ("position", "name"):
        raise ValueError(f"unknown alignment '{by}'")
    return (merge_by_position if by == "position" else merge_by_name)(frames, source_no, address)


def merge_paths(
    spark: SparkSession, paths: Sequence[str], format: str = "parquet", by: str = "position",
    source_no: str | None = None, same_layout: bool = False, address: str | None = None, **options,
) -> DataFrame:
    """Append files or folders of any readable format; a path listed twice counts once.

    With ``same_layout`` the caller vouches that all inputs have the same columns: they
    become one scan instead of a union of one scan per input, which is what thousands of
    inputs need.
    """
    paths = list(dict.fromkeys(paths))
    if same_layout and source_no is None and address is None:
        return scan(spark, paths, format, **options)
    return merge_frames([scan(spark, p, format, **options) for p in paths], by, source_no, address)


def merge_tables(
    spark: SparkSession, dataset: str, names: Sequence[str], format: str = "parquet",
    by: str = "position", source_no: str | None = None, address: str | None = None, **options,
) -> DataFrame:
    """Append selected tables of a dataset, under the names that listing it gives.

    The dataset is a folder of ``{name}.{format}`` or ``{name}`` files or folders, or the
    output of a split; with ``format="table"``, a catalog database.
    """
    names = list(dict.fromkeys(names))
    if format == "table":
        paths = ["`" + dataset.replace("`", "``") + "`.`" + n.replace("`", "``") + "`" for n in names]
    else:
        places = table_paths(spark, dataset)
        if missing := [n for n in names if n not in places]:
            raise TableError(f"no table named {', '.join(missing)}")
        paths = [places[n] for n in names]
    return merge_frames([scan(spark, p, format, **options) for p in paths], by, source_no, address)


def merge_summary(frames: Sequence[DataFrame]) -> DataFrame:
    """One row ``(inputs, rows)``: inputs given and rows merged."""
    counts = [df.select(F.lit(1).alias("one")) for _, df in _non_empty(frames)]
    merged = _balanced(counts, DataFrame.union)
    return merged.agg(F.lit(len(frames)).cast("bigint").alias("inputs"), F.count("one").alias("rows"))
