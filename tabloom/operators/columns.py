"""Keep, reorder, rename and compute columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tabloom.functions.cells import ref
from tabloom.functions.formula import with_formulas


def column_ops(
    df: DataFrame,
    keep: Sequence[str] | None = None,
    order: Sequence[str] | None = None,
    renames: Mapping[str, str] | None = None,
    calc: Iterable[Mapping[str, str]] = (),
    strict: bool = False,
) -> DataFrame:
    """Select columns, then append computed ones.

    Output columns follow ``order`` restricted to ``keep`` (either may be left out). A
    selected column that does not exist is blank text. Renames touch output names only.
    Each ``calc`` is ``{"name": ..., "expression": ...}`` and sees source columns under
    their source names, also dropped ones, never other computed columns.
    """
    if order and keep is not None:
        chosen = [c for c in order if c in set(keep)]
    else:
        chosen = list(order or (df.columns if keep is None else keep))
    renames = renames or {}
    present = set(df.columns)
    out = [(ref(c) if c in present else F.lit("")).alias(renames.get(c, c)) for c in chosen]
    df, computed = with_formulas(df, calc, strict)
    return df.select(*out, *computed)
