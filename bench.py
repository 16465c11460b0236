"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from tablegauge.queries import load_all
from tablegauge.session import local_session

HEADLINE = [
    "profile_numeric", "profile_distinct", "profile_duplicates", "profile_categorical_topk", "quality_report",
    "quality_iqr_outliers", "clean_impute_median", "clean_dedup", "corr_pairs", "group_summary", "histogram", "welch",
    "anova", "chi_square", "binned_mutual_information", "spearman", "kendall_tau_lineitem", "mann_whitney",
    "kruskal_wallis", "wilcoxon_signed_rank", "friedman", "rolling", "rolling_single_series", "dup_columns",
    "redundant_pairs", "random_holdout", "time_holdout", "regression_metrics", "roc_auc", "linear_regression",
    "permutation_importance", "rank_battery", "ridge_cv_gram", "linear_sweep_cv", "clean_operation_log", "content_diff", "lineage_closure", "monthly_trend", "slicer_filter",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    queries = load_all().QUERIES
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(repeats):
            started = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - started)
        times[name] = round(statistics.median(runs), 3)
    print(json.dumps({
        "metric": "total_median_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
