"""Row-by-row operators on a streaming frame.

Filter, column operations, merges and the naming of split outputs contain no aggregation and
no action, so the same recipe steps serve batch and streaming frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame

from tabloom.errors import TableError
from tabloom.operators.merge import merge_frames
from tabloom.plans.recipe import run_recipe

STATELESS = ("filter", "columns", "split")


def run_stateless(stream: DataFrame, steps: Sequence[Mapping]) -> DataFrame:
    """Apply recipe steps to a streaming frame; steps that need the whole table are refused."""
    refused = [s.get("op") for s in steps if s.get("op") not in STATELESS]
    if refused:
        raise TableError(f"these steps need the whole table: {', '.join(map(str, refused))}")
    return run_recipe(stream, steps)


def merge_streams(streams: Sequence[DataFrame], by: str = "position", source_no: str | None = None) -> DataFrame:
    """Append streams by position or by name, with the columns and types of a batch merge.

    Rows arrive in no order, so there is no ``address``. A batch frame among streams would be
    read again with every restart and is refused.
    """
    if not all(s.isStreaming for s in streams):
        raise TableError("a merge of streams takes streams only")
    return merge_frames(streams, by, source_no)
