"""Headline queries, timed; prints one JSON line.

``queries`` has medians, whose sum is the value; ``families`` has the median (p50)
and the 95th percentile (p95) of each workload family over more repeats: point and
range reads, aggregates, fetches over one and two hops, milestone chain, split.

BENCH_SF_DIR names the tables, BENCH_CPUS the threads, BENCH_REPEATS how often
each query runs after a first run that is not counted; the median counts.
"""

from __future__ import annotations

import json
import os
import re
import time
from statistics import median

from pyspark.sql import SparkSession

from tidemark import suite, suite_writes

FAMILIES = {
    "point_read": "read_point", "range_read": "read_range", "aggregate": "agg_ungrouped", "grouped": "agg_grouped", "fetch_1_n": "fetch_limited_roots",
    "fetch_1_n_n": "fetch_multi_hop", "document_filter": "layout_filter", "patch_update": "layout_write_predicate", "predecessor": "layout_temporal_as_of",
    "chain": "tt_update", "split": "bt_update_until",
}
HEADLINE = (
    "pred_eq", "pred_between", "order_limit_topk", "nav_exists_where", "nav_multi_hop", "nav_or_position", "nav_poly_tpcs",
    "tt_latest", "tt_as_of", "tt_history", "bt_past_past", "bt_range", "fam_tph_root", "fam_tpcs_root", "vo_any_element_and",
    "vo_exists_same_element", "fetch_to_many", "fetch_multi_hop", "fetch_history_edges", "agg_each_function", "agg_having",
    "write_update", "tt_update", "bt_update_until", "bt_successive_corrections", "write_cascade",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    repeats, more = int(os.environ.get("BENCH_REPEATS", "3")), int(os.environ.get("BENCH_FAMILY_REPEATS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, times, families = suite.queries() | suite_writes.queries(), {}, {}

    def timed(name: str, runs: int) -> list[float]:
        took = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            made[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        return sorted(took[1:])

    for name in HEADLINE:
        times[name] = round(median(timed(name, repeats)), 4)
    for family, name in FAMILIES.items():
        took = timed(name, more)
        families[family] = {"query": name, "p50": round(median(took), 4), "p95": round(took[min(len(took) - 1, int(0.95 * len(took)))], 4)}
    sf = re.search(r"sf([0-9.]+)", folder)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "families": families, "sf": float(sf[1]) if sf else None}))
    spark.stop()


if __name__ == "__main__":
    main()
