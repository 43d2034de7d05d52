"""Cell conversions shared by every operator.

A spreadsheet cell has a type of its own; a Spark column has one type for all rows. The
functions here give each typed column the text and the number that the same cell would
have had, as native expressions that stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabloom.errors import MissingColumn

# The label of the bucket that holds empty cells, and of totals.
EMPTY_LABEL = "(空)"
TOTAL_LABEL = "合计"

# White space that stripping a text removes. Reading a number allows the
# same characters around it but for the four separators U+001C to U+001F.
SEPARATORS = "\x1c\x1d\x1e\x1f"
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

_DIGITS = r"[0-9](?:_?[0-9])*"
# A decimal number. Java's parser would also accept a type suffix ("1d", "5f"), which is
# not a number in a cell.
NUMBER_PATTERN = rf"^[+-]?(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\z"


def ref(name: str) -> Column:
    """Reference a column by its exact name (dots, spaces and backticks included)."""
    return F.col("`" + name.replace("`", "``") + "`")


def dtype(df: DataFrame, name: str) -> T.DataType:
    if name not in df.columns:
        raise MissingColumn(name)
    return df.schema[name].dataType


def is_text(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.CharType, T.VarcharType))


def is_numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def as_number(c: Column, t: T.DataType) -> Column:
    """The cell as DOUBLE, or NULL when it is not a number."""
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if is_numeric(t) or isinstance(t, T.BooleanType):
        return c.cast("double")
    if is_text(t):
        bare = F.btrim(c, F.lit(WHITE_SPACE))
        # Most texts are told from numbers by their first character ("+" to "9").
        likely = F.ascii(c).between(43, 57) | _starts_with_space(c)
        return F.when(
            likely & bare.rlike(NUMBER_PATTERN), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")
        )
    return F.lit(None).cast("double")


def num(df: DataFrame, name: str) -> Column:
    return as_number(ref(name), dtype(df, name))


def num0(df: DataFrame, name: str) -> Column:
    """Like :func:`num`, but an empty cell counts as 0."""
    c, t = ref(name), dtype(df, name)
    empty = c.isNull() | (c == "") if is_text(t) else c.isNull()
    return F.when(empty, F.lit(0.0)).otherwise(as_number(c, t))


def _double_text(x: Column) -> Column:
    """Common values first; each branch uses Java's text once, so the code stays small."""
    java, size = x.cast("string"), F.abs(x)
    plain = F.regexp_replace(x.try_cast("decimal(38,21)").cast("string"), r"\.?0+$", "")
    # 1.0E-5 is 1e-05, 2.5E22 is 2.5e+22.
    power = java
    for old, new in (("E", "e+"), ("e+-", "e-"), (".0e", "e")):
        power = F.replace(power, F.lit(old), F.lit(new))
    power = F.regexp_replace(power, "e([+-])([0-9])$", "e$10$2")
    return (
        F.when((F.rint(x) == x) & (size < 1e16), x.try_cast("bigint").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), java)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(size < float("inf"), power)
        .otherwise(F.lower(F.replace(java, F.lit("Infinity"), F.lit("inf"))))
    )


def as_text(c: Column, t: T.DataType) -> Column:
    """The cell as displayed text; NULL stays NULL.

    Whole numbers have no fraction, other doubles are written with the fewest digits
    that read back to the same value, booleans are ``True`` / ``False``.
    """
    if is_text(t):
        return c
    if isinstance(t, T.BooleanType):
        return F.initcap(c.cast("string"))
    if isinstance(t, T.DoubleType):
        return _double_text(c)
    if isinstance(t, T.FloatType):
        return _double_text(c.cast("string").cast("double"))
    if isinstance(t, T.DecimalType) and t.scale > 0:
        return F.regexp_replace(c.cast("string"), r"\.?0+$", "")
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        stamp = c.cast("string")
        return F.when(F.contains(stamp, F.lit(".")), F.rpad(stamp, 26, "0")).otherwise(stamp)
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(t, T.BinaryType):
        return F.base64(c)
    return c.cast("string")


def to_text(df: DataFrame, name: str) -> Column:
    return as_text(ref(name), dtype(df, name))


def text0(df: DataFrame, name: str) -> Column:
    """Text of the cell where an empty cell, a numeric zero and False read as ``""``."""
    c, t = ref(name), dtype(df, name)
    blank = c.isNull()
    if is_numeric(t):
        blank = blank | (c == 0)
    elif isinstance(t, T.BooleanType):
        blank = blank | ~c
    return F.when(blank, F.lit("")).otherwise(as_text(c, t))


def _starts_with_space(c: Column) -> Column:
    """A cheap test that is true for every text starting with white space, and for ""."""
    first = F.ascii(c)
    return (first <= 32) | first.isin(0x85, 0xA0, 0x1680, 0x3000) | first.between(0x2000, 0x205F)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE + SEPARATORS))


def is_blank(df: DataFrame, name: str) -> Column:
    """NULL, or text made of white space only. Never NULL itself."""
    c = ref(name)
    if is_text(dtype(df, name)):
        return c.isNull() | (_starts_with_space(c) & (strip(c) == ""))
    return c.isNull()


def group_text(df: DataFrame, name: str, label: str = EMPTY_LABEL) -> Column:
    """Grouping key of split, distribution and pivot: cell text, empty cells labelled."""
    return F.coalesce(to_text(df, name), F.lit(label))


def group_key(df: DataFrame, name: str, label: str = EMPTY_LABEL) -> tuple[Column, Callable[[Column], Column]]:
    """What to group by for :func:`group_text`, and the function that makes the text of it.

    Values of numbers, dates and booleans are grouped as they are, since different values
    have different texts, and only the groups are turned into text, not the rows.
    """
    t = dtype(df, name)
    if is_numeric(t) or isinstance(t, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        return ref(name), lambda c: F.coalesce(as_text(c, t), F.lit(label))
    return group_text(df, name, label), lambda c: c


def group_value(df: DataFrame, name: str) -> Column:
    """Typed key for duplicate detection; maps cannot be grouped, so they go as JSON."""
    return F.to_json(ref(name)) if isinstance(dtype(df, name), T.MapType) else ref(name)


def floor_double(x: Column) -> Column:
    """Floor that stays DOUBLE; values of 2^52 and above are whole already."""
    return F.when(F.abs(x) < float(2**52), F.floor(x).cast("double")).otherwise(x)


def round_exact(x: Column, digits: int = 2) -> Column:
    """Round a DOUBLE by its exact binary value, exact ties to the even digit.

    Spark's ``round`` and ``bround`` round the shortest decimal text of the value, so
    0.165 (stored slightly above) or 1.005 (stored slightly below) can go the wrong way.
    The product with 10^digits is split in two (error-free multiplication), so a product
    that lands on .5 is decided by its rounding error. Powers of ten are exact up to 22;
    beyond, the text of the value decides. The expression repeats ``x`` many times: give it
    a column, not a long expression.
    """
    if digits < 0:
        return _round_to_multiple(x, float(10**-digits))
    if digits > 22:
        return F.bround(x, digits)
    scale = float(10**digits)
    product = x * scale
    down = F.floor(product)
    wide = x * 134217729.0
    high = wide - (wide - x)
    scale_high = scale * 134217729.0 - (scale * 134217729.0 - scale)
    scale_low = scale - scale_high
    error = ((high * scale_high - product) + high * scale_low + (x - high) * scale_high) + (x - high) * scale_low
    looks_tied = product - down.cast("double") == 0.5
    decided = down.cast("double") + F.when(error > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    whole = F.when(looks_tied & (error != 0), decided).otherwise(F.rint(product))
    # From 2^53 on, the spacing of doubles near x is wider than the last digit. Adding
    # zero turns -0.0 into 0.0.
    return F.when(F.abs(product) >= float(2**53), x).otherwise(whole / scale + 0.0)


def _round_to_multiple(x: Column, unit: float) -> Column:
    """Round to a multiple of a power of ten; the remainder of doubles is exact."""
    rest = F.try_mod(x, F.lit(unit))
    base = x - rest
    next_ = base + F.signum(rest) * unit
    odd = F.abs(F.try_mod(base / unit, F.lit(2.0))) == 1.0
    beyond = F.abs(rest) > unit / 2
    tied = F.abs(rest) == unit / 2
    return F.when(beyond | (tied & odd), next_).otherwise(base) + 0.0
