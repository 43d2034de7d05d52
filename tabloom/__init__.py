"""Everyday table operations on Spark: split, merge, dedup, convert, filter, columns,
pivot and validate. Every operator takes a DataFrame and returns one."""

from tabloom.errors import FormulaError, InsufficientData, MissingColumn, TableError
from tabloom.functions.predicates import normalise_conditions
from tabloom.operators.columns import column_ops
from tabloom.operators.dedup import dedup, dedup_counts, duplicate_groups, keep_first, keep_last, removed_rows
from tabloom.operators.distribution import (
    bars, distribution_totals, group_order, search_values, share_table, value_counts, with_group,
)
from tabloom.operators.filtering import filter_counts, filter_rows, unmatched_rows
from tabloom.operators.merge import (
    merge_by_name, merge_by_position, merge_frames, merge_paths, merge_summary, merge_tables,
)
from tabloom.operators.pivot import crosstab, pivot_cells, pivot_long
from tabloom.operators.rows import (
    attach_banner, row_range, row_range_preview, source_range, split_sections, with_row_index,
)
from tabloom.operators.split import (
    read_split, split_collisions, split_summary, with_output, write_banner_split, write_split,
)
from tabloom.operators.states import GroupStates
from tabloom.operators.validate import (
    duplicate_rows, empty_rates, issues, outlier_bounds, outlier_rows, outliers, profile, quartiles, report,
    type_kinds, write_issues,
)
from tabloom.plans.graph import Graph
from tabloom.plans.recipe import apply_op, run_recipe, run_with_summary
from tabloom.session import session
from tabloom.sources.tables import (
    convert_many, list_catalog_tables, list_tables, read_csv, renamed, scan, scan_with_banner, write_csv, write_if,
    write_staged,
)
from tabloom.storage import scratch_dir
