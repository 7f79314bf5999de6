"""Time the headline queries: one JSON line with seconds per query.

BENCH_SF_DIR   tables to read (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  comma-separated names instead of the headline list, or "all"
"""

from __future__ import annotations

import json
import os
import re
import time

HEADLINE = (
    "growth_ranking", "count_by_area_year_type", "complete_grid", "permit_counts", "panel_with_permits", "crime_yearly",
    "crime_points", "shops_cumulative", "price_index_by_group_max", "inner_joins", "enrich_distinct_keys",
    "rows_with_listed_code", "earliest_record", "dedupe_first", "quantile_by_group", "quantile_by_narrowing",
    "describe_by_group", "box_stats", "histogram_by_year", "kernel_density", "regression_line", "neighbor_average",
    "nearest_top_member", "area_features", "training_frame", "rank_large_groups", "running_total_large_groups",
    "split_train_test", "gamma_tail_probability", "score_over_draws", "label_areas", "ranking_of_year",
    "crime_map_slice", "first_paragraphs", "ols_two", "gamma_draws",
)


def main() -> None:
    from areapanel.catalog import CATALOG
    from areapanel.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(CATALOG) if wanted == "all" else [n for n in wanted.split(",") if n] or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="areapanel-bench")
    CATALOG["rows_per_year"].run(spark, sf).collect()  # start the workers before the clock
    seconds = {}
    for name in names:
        start = time.perf_counter()
        CATALOG[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf)
    print(json.dumps({
        "metric": "headline query time, sum", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
