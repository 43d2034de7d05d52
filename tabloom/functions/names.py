"""Header names and names of split outputs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from tabloom.functions.cells import strip

# Characters that may not occur in a file name or in a table name, and
# the longest names allowed.
FILE_FORBIDDEN = '<>:"/\\|?*'
FILE_LENGTH = 100
TABLE_FORBIDDEN = "[]:*?/\\"
TABLE_LENGTH = 31


def normalise_headers(cells: Iterable[object]) -> list[str]:
    """Names for a header row: empty cells become ``Col{i}``, repeats get ``_2``, ``_3``.

    Spark resolves columns without regard to case, so repeats are found that way too.
    """
    cells = list(cells)
    wanted = [f"Col{i}" if cell is None else str(cell) for i, cell in enumerate(cells)]
    taken: set[str] = set()
    names = []
    for name in wanted:
        unique, k = name, 1
        while unique.lower() in taken:
            k += 1
            unique = f"{name}_{k}"
        taken.add(unique.lower())
        names.append(unique)
    return names


def _safe(text: Column, forbidden: str, length: int) -> Column:
    replaced = F.translate(text, forbidden, "_" * len(forbidden))
    return F.substring(strip(replaced), 1, length)


def safe_file_name(text: Column) -> Column:
    return _safe(text, FILE_FORBIDDEN, FILE_LENGTH)


def safe_table_name(text: Column) -> Column:
    return _safe(text, TABLE_FORBIDDEN, TABLE_LENGTH)
