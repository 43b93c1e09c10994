"""Time the headline queries: one JSON line.

Each query runs once to warm up and then three times into the `noop` sink; the median counts.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabloom.plans import QUERIES  # noqa: E402
from tabloom.session import local_session  # noqa: E402

HEADLINE = [
    "profile_dataset", "correlation_matrix", "duplicate_rows", "quality_score", "top_values", "detect_problem_type",
    "dedupe_headers", "leaderboard", "robust_scale", "combined_preprocess", "stratified_split", "kfold_assign",
    "resample_mean", "fill_interpolate", "rolling_features", "winsorize", "classification_metrics", "roc_auc",
    "rate_limit_hits", "plan_expiry_fold", "knn_join", "arima_fit", "shap_linear", "batch_predict",
]
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:]
    took = {}
    for name in only or HEADLINE:
        def run(name=name):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        run()
        took[name] = round(statistics.median(run() for _ in range(RUNS)), 3)
        print(f"{name} {took[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline query time, sum of medians", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
