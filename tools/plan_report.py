"""Physical-plan review of registered queries -> markdown table (PLANS.md).

For each query: shuffles (hash / range / single-partition exchanges), join
strategies, window and top-k-per-group operators, and whether scans carry
pushed filters. Static plans (AQE off) so the counts are the planner's
decisions before run-time re-planning; AQE then coalesces partitions and may
turn sort-merge joins with small measured sides into broadcast joins.

    python tools/plan_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "hash exch": r"Exchange hashpartitioning",
    "range exch": r"Exchange rangepartitioning",
    "single exch": r"Exchange SinglePartition",
    "bcast": r"BroadcastExchange",
    "SMJ": r"SortMergeJoin",
    "BHJ": r"BroadcastHashJoin",
    "BNLJ/cartesian": r"BroadcastNestedLoopJoin|CartesianProduct",
    "window": r"\bWindow \[",
    "top-k/group": r"WindowGroupLimit",
    "scans": r"FileScan parquet",
    "pushed filters": r"PushedFilters: \[[^\]]+\]",
}

SKIP = {"sink_roundtrip", "csv_scan_view", "final_fit", "grid_search", "cv_search", "guarded_choice",
        "leaderboard", "coef_table", "tree_importance", "permutation_importance", "score_topk", "model_end_to_end",
        "fit_linear", "fit_ridge", "fit_lasso", "fit_elasticnet", "fit_tree", "fit_forest", "fit_gbt", "fit_tree_friedman", "fit_gbt_huber", "fit_gbt_leafwise", "stump_penalised",
        "one_hot", "pca_groups", "column_transformer", "feature_names", "column_catalog", "select_features"}


def main() -> None:
    from panelspark import registry
    from panelspark.session import local_session

    root = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8, shuffle_partitions=16)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    registry.load_all()
    print("# Physical plans of the registered queries\n")
    print(f"Static plans (AQE off) at `{root}`, generated by `tools/plan_report.py`. ML queries "
          "(model fits, searches) are sequences of Spark ML jobs and are not listed.\n")
    print("| query | " + " | ".join(PATTERNS) + " |")
    print("|---|" + "---|" * len(PATTERNS))
    for name in sorted(registry.QUERIES):
        if name in SKIP:
            continue
        plan = registry.QUERIES[name](spark, root)._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(p, plan))) for p in PATTERNS.values()]
        print(f"| {name} | " + " | ".join(counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
