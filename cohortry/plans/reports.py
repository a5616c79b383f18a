"""The two whole-table reports as named tables, and their findings as one tidy table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.operators import contingency, missingness, normality, profile
from cohortry.session import stage


def _finding(df: DataFrame, name: str, subject: Column, metric: str, value: Column, threshold: float | None, verdict: Column) -> DataFrame:
    return df.select(F.lit(name).alias("finding"), subject.cast("string").alias("subject"), F.lit(metric).alias("metric"),
                     value.cast("double").alias("value"), F.lit(threshold).cast("double").alias("threshold"),
                     verdict.cast("string").alias("verdict"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def missingness_tables(df: DataFrame, target: str, group: str, outcome: str, base: str, numeric: Sequence[str],
                       categorical: Sequence[str]) -> dict[str, DataFrame]:
    """Prevalence, independence, pairwise tests, pattern test, and what goes with a missing ``target``."""
    return {
        "prevalence": contingency.prevalence(df, group, outcome),
        "chi_square": contingency.chi_square(contingency.cell_counts(df, [group], outcome)),
        "pairwise": contingency.pairwise_chi_square(df, group, outcome, base),
        "pattern_test": missingness.pattern_test(df, [*numeric, target]),
        "share": missingness.missing_share(df, target),
        "point_biserial": missingness.point_biserial(df, target, numeric),
        "mean_difference": missingness.mean_difference(df, target, numeric),
        "association": missingness.missing_by_category(df, target, categorical),
    }


def missingness_findings(t: dict[str, DataFrame], target: str, group: str, base: str, alpha: float = 0.05) -> DataFrame:
    """The rules of the report: treat ``base`` as a level or not, which imputation is safe."""
    yes_no = F.when(F.col("significant"), "significant").otherwise("not significant")
    level = F.when(F.col("significant"), F.lit(f"keep {base} as a level of its own")).otherwise(
        F.lit(f"keep {base} as a level or impute it"))
    linked = t["point_biserial"].agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("significant"), F.col("feature")))), ", ").alias("linked"))
    pattern = t["pattern_test"].withColumn("k", F.lit(1)).join(linked.withColumn("k", F.lit(1)), "k")
    advice = (F.when(F.col("is_mcar"), "standard imputation is safe: missing completely at random")
              .when(~F.col("is_mcar") & (F.col("linked") != ""),
                    F.concat(F.lit("missing at random; goes with "), F.col("linked"),
                             F.lit(": model-based or multiple imputation, keep a missing flag")))
              .when(~F.col("is_mcar"), "not completely at random, no linked variable: multiple imputation")
              .otherwise("mechanism not determined: robust imputation"))
    return _union([
        _finding(t["chi_square"], f"{group} and outcome", F.col("variable"), "chi-square p", F.col("p_value"), alpha, level),
        _finding(t["pairwise"], f"{base} against other levels", F.col("other_level"), "chi-square p", F.col("p_value"), alpha, yes_no),
        _finding(pattern, f"missing {target}", F.lit(target), "pattern test p", F.col("p_value"), alpha, advice),
        _finding(t["share"], f"missing {target}", F.lit(target), "missing percent", F.col("missing_pct"), None, F.lit(None)),
        _finding(t["point_biserial"], f"missing {target} and numeric", F.col("feature"), "correlation p", F.col("p_value"), alpha, yes_no),
        _finding(t["mean_difference"], f"missing {target} and numeric", F.col("feature"), "t-test p", F.col("p_value"), alpha, yes_no),
        _finding(t["association"], f"missing {target} and category", F.col("variable"), "chi-square p", F.col("p_value"), alpha, yes_no),
    ])


def profile_tables(df: DataFrame, label: str, key: str) -> dict[str, DataFrame]:
    """All profiles of a table. The key takes part in the correlations only, and orders the text codes.

    The rows are read three times: once to count the values of all columns, from which all but the correlations comes, and twice for
    sums of products. Stage the table first when it is the result of joins.
    """
    columns = [c for c in df.columns if c != key]
    inputs = [c for c in columns if c != label]
    counted = profile.Counted(df, columns, key)
    cards = stage(counted.cardinality(inputs), "cardinality")
    kinds = {r["feature"]: r["family"] for r in cards.select("feature", "family").collect()}
    continuous = [c for c in inputs if kinds[c] == "Continuous"]
    numeric_key = [key] if profile.is_numeric(df, key) else []
    matrix = profile.correlations(counted.coded(df, columns), [*numeric_key, *columns])
    small = [c for c in continuous if counted.size(c, "known") < normality.SHAPIRO_LIMIT]
    return {
        "missing": counted.missing(columns),
        "cardinality": cards,
        "top_values": counted.top_values(inputs),
        "target": counted.class_balance(label),
        "correlation": matrix,
        "target_correlation": profile.target_correlations(matrix, label),
        "high_pairs": profile.high_pairs(matrix),
        "distribution": normality.distribution_advice(counted.moments(continuous), normality.w_test(df, small)) if continuous else None,
    }


def profile_findings(t: dict[str, DataFrame]) -> DataFrame:
    """The preparation choices that the profiles justify."""
    parts = [
        _finding(t["missing"], "missing values", F.col("feature"), "missing percent", F.col("missing_pct"), 5.0, F.col("advice")),
        _finding(t["cardinality"], "encoding", F.col("feature"), "distinct values", F.col("unique_values"), None, F.col("encoding")),
        _finding(t["target"], "class balance", F.lit("label"), "negatives per positive", F.col("imbalance_ratio"), 10.0,
                 F.concat(F.col("severity"), F.lit(": "), F.col("recommendation"))),
        _finding(t["target_correlation"], "target correlation", F.col("feature"), "r", F.col("r"), None,
                 F.concat(F.col("strength"), F.lit(" "), F.col("direction"))),
        _finding(t["high_pairs"], "collinear pair", F.concat(F.col("feature_1"), F.lit(", "), F.col("feature_2")), "r", F.col("r"), 0.8,
                 F.lit("monitor during importance analysis")),
    ]
    if t["distribution"] is not None:
        parts.append(_finding(t["distribution"], "scaling", F.col("feature"), "normality p", F.col("p_value"), 0.05, F.col("recommendation")))
    return _union(parts)
