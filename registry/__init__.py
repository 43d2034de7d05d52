"""Queries over the test tables, each with equivalent SQL where SQL can express it."""

from registry import (
    checks, distributions, duplicates, filters, merging, pivots, projections, recipes, rows, sources,
)

_MODULES = (sources, rows, filters, projections, merging, duplicates, distributions, pivots, checks, recipes)

QUERIES: dict = {}
ORACLES: dict = {}
for _module in _MODULES:
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
