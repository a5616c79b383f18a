"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cohortry.cohorts import line_cohort  # noqa: E402
from cohortry.operators.boosting import positive_weight  # noqa: E402
from cohortry.operators.splitting import hash_sample  # noqa: E402
from cohortry.plans import training  # noqa: E402
from cohortry.plans.catalog import CATALOG, DEFAULT, LINE_SPEC  # noqa: E402
from cohortry.session import scratch, session, stage  # noqa: E402

HEADLINE = [
    "prevalence_by_group", "crosstab_margins", "chi_square", "pairwise_chi_square", "table_summary", "missing_profile",
    "cardinality_profile", "top3_values", "class_balance", "moments", "corr_matrix", "dagostino", "histogram", "kde", "qq_fit",
    "t_test_missing", "mcar_test", "iqr_outliers", "validate_report", "validate_rows", "stratified_split", "stratified_folds",
    "robust_scale", "one_hot", "knn_impute", "knn_impute_large", "feature_matrix", "clinical_metrics", "roc_curve", "roc_auc",
    "avg_precision", "fairness_audit", "risk_bands", "score_records", "score_stream", "profile_report", "missingness_report",
    "boosted_score", "shap_global",
]
#: Rows of the published training time.
SEARCH_ROWS = 5110


def search(spark, folder: str) -> None:
    """The full search, 50 draws on 5 folds with train scores, on as many rows as the published training time is for."""
    some = stage(hash_sample(line_cohort(spark, folder), "rid", SEARCH_ROWS), "rows")
    base = DEFAULT.with_(pos_weight=positive_weight(some, "outcome"))
    training.search_summary(training.random_search(some, LINE_SPEC, base, training.draw_params(50), folds=5)).collect()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
                                                  "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    CATALOG["prevalence_by_group"](spark, folder).count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        with scratch(spark):
            CATALOG[name](spark, folder).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    with scratch(spark):
        search(spark, folder)
    apart = {f"search_50_draws_5_folds_{SEARCH_ROWS}_rows": round(time.perf_counter() - start, 3)}
    spark.stop()
    print(json.dumps({"metric": "total wall time of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "training": apart, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
