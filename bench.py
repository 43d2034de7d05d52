"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

import tabloom as tl  # noqa: E402
from registry.recipes import STEPS  # noqa: E402
from tabloom.storage import scratch_dir  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
CHECKS = {"empty": True, "empty_threshold": 1, "outliers": True, "type_check": True, "duplicates": True}


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def scenarios(spark):
    """The eight features of the reference's benchmark, on lineitem."""
    t = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    over = [{"column": "l_quantity", "operator": "gt", "value": "30"}]
    kept = ["l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"]
    calc = [{"name": "revenue", "expression": "{l_extendedprice} * (1 - {l_discount})"}]
    csv = scratch_dir(spark)
    tl.write_csv(t("lineitem"), csv)

    return {
        "split_files_50_outputs": lambda: tl.write_split(t("lineitem"), "l_quantity", scratch_dir(spark)),
        "split_summary": lambda: noop(tl.split_summary(t("lineitem"), "l_quantity")),
        "merge_3": lambda: noop(tl.merge_by_position([t("lineitem")] * 3)),
        "dedup_first": lambda: noop(tl.keep_first(t("lineitem"), ["l_returnflag", "l_linestatus"])),
        "dedup_first_many_keys": lambda: noop(tl.keep_first(t("lineitem"), ["l_orderkey", "l_partkey"])),
        "dedup_last": lambda: noop(tl.keep_last(t("lineitem"), ["l_returnflag", "l_linestatus"])),
        "dedup_removed": lambda: noop(tl.removed_rows(t("lineitem"), ["l_orderkey", "l_partkey"])),
        "filter": lambda: noop(tl.filter_rows(t("lineitem"), over)),
        "columns": lambda: noop(tl.column_ops(t("lineitem"), kept, kept, {"l_quantity": "quantity"})),
        "columns_calc": lambda: noop(tl.column_ops(t("lineitem"), kept, calc=calc)),
        "pivot_count": lambda: noop(tl.crosstab(t("lineitem"), "l_quantity", "l_linenumber", "l_tax")),
        "pivot_long_sum": lambda: noop(tl.pivot_long(t("lineitem"), "l_suppkey", "l_returnflag", "l_quantity", "sum")),
        "validate_empty": lambda: noop(tl.report(t("lineitem"), {"empty": True})),
        "validate_full": lambda: noop(tl.report(t("lineitem"), CHECKS)),
        "quartiles": lambda: noop(tl.quartiles(t("lineitem"))),
        "row_index": lambda: noop(tl.with_row_index(t("lineitem"))),
        "convert_to_csv": lambda: tl.write_csv(t("lineitem"), scratch_dir(spark)),
        "convert_from_csv": lambda: tl.read_csv(spark, csv).write.parquet(scratch_dir(spark)),
        "recipe": lambda: noop(tl.run_recipe(t("lineitem"), STEPS)),
    }


def main():
    spark = tl.session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    rows = spark.read.parquet(f"{SF_DIR}/lineitem.parquet").count()
    times = {}
    for name, run in scenarios(spark).items():
        taken = []
        for _ in range(3):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        times[name] = round(min(taken), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": SF_DIR.rsplit("sf", 1)[-1], "rows": rows,
        "rows_per_sec": {name: round(rows / t) for name, t in times.items()},
    }))


if __name__ == "__main__":
    main()
