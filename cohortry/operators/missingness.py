"""Why values are missing: pattern test, correlation, mean-difference and association tests."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions import expressions as X
from cohortry.functions.special import chi_square_p, student_p
from cohortry.operators.contingency import cell_counts, chi_square
from cohortry.operators.profile import is_numeric, unfold
from cohortry.session import discard, stage

#: Tasks for each core in a step of a fit.
FIT_TASKS = 4


def pattern_columns(df: DataFrame, others: int = 5) -> list[str]:
    """The numeric columns with missing values, then the first few without."""
    numeric = [c for c in df.columns if is_numeric(df, c)]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric]).first()
    return [c for c in numeric if counts[c] > 0] + [c for c in numeric if counts[c] == 0][:others]


def pattern_test(df: DataFrame, columns: Sequence[str] | None = None, alpha: float = 0.05, ridge: float = 1e-6) -> DataFrame:
    """T4, T5: missing completely at random? Weighted distance of each pattern's means from the overall means.

    One pass for the overall means and covariances (a row of k * k numbers), one grouped pass for the pattern
    means; each pattern then solves its own small system in the task that holds it.
    """
    columns = list(columns or pattern_columns(df))
    k = len(columns)
    overall = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}_{j}")
          for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]).first()

    def number(v):
        return np.nan if v is None else float(v)

    mean = np.array([number(overall[f"m{i}"]) for i in range(k)])
    cov = np.array([[number(overall[f"c{min(i, j)}_{max(i, j)}"]) for j in range(k)] for i in range(k)])

    def distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                seen = [i for i in range(k) if row.pattern[i] == "0"]
                value, used = 0.0, 0
                if 0 < len(seen) < k and row.n >= 2:
                    gap = np.array([row[2 + i] for i in seen], dtype=float) - mean[seen]
                    try:
                        value = float(row.n * gap @ np.linalg.inv(cov[np.ix_(seen, seen)] + ridge * np.eye(len(seen))) @ gap)
                        used = len(seen)
                    except np.linalg.LinAlgError:
                        pass
                rows.append((row.pattern, row.n, value, used))
            yield pd.DataFrame(rows, columns=["pattern", "n", "distance", "used"])

    patterns = df.groupBy(X.missing_pattern(columns).alias("pattern")).agg(
        F.count("*").alias("n"), *[F.avg(c).cast("double").alias(f"m{i}") for i, c in enumerate(columns)])
    solved = patterns.mapInPandas(distances, "pattern string, n long, distance double, used long")
    total = solved.agg(F.count("*").alias("n_patterns"), F.bool_or(F.contains("pattern", F.lit("1"))).alias("any_missing"),
                       F.sum("distance").alias("d"), F.sum("used").alias("u"))
    nothing, single = ~F.col("any_missing"), F.col("n_patterns") <= 1
    out = total.select(
        F.when(nothing, 0.0).when(single, None).otherwise(F.col("d")).alias("chi2"),
        F.when(nothing | single, 0).otherwise(F.col("u")).alias("dof"), "n_patterns", "any_missing")
    p = F.when(~F.col("any_missing"), 1.0).when(F.col("dof") > 0, chi_square_p("chi2", "dof"))
    return out.withColumn("p_value", p).withColumn("is_mcar", F.col("p_value") > alpha).drop("any_missing")


def point_biserial(df: DataFrame, target: str, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Correlation of the missing flag of ``target`` with each numeric column."""
    flag = X.missing_flag(target).cast("double")
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.corr(flag, F.col(c).cast("double")).alias(f"r{i}"), F.count(c).alias(f"n{i}")]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
            for i, c in enumerate(columns)]
    r, dof = F.col("r"), F.col("n") - 2
    return (unfold(df.agg(*aggs), rows).filter(F.col("n") > 0)
            .withColumn("t", r * F.sqrt(F.try_divide(dof, 1 - r * r)))
            .withColumn("p_value", student_p("t", dof.cast("double")))
            .withColumn("significant", F.col("p_value") < alpha))


def mean_difference(df: DataFrame, target: str, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Pooled-variance t-test of each column between rows with and without ``target``; one pass."""
    aggs = []
    for i, c in enumerate(columns):
        for s, where in (("a", F.col(target).isNull()), ("b", F.col(target).isNotNull())):
            x = F.when(where, F.col(c).cast("double"))
            aggs += [F.count(x).alias(f"n{s}{i}"), F.avg(x).alias(f"m{s}{i}"), F.var_samp(x).alias(f"v{s}{i}")]
    rows = [F.struct(F.lit(c).alias("feature"), *[F.col(f"{x}{s}{i}").alias(f"{x}{s}") for s in "ab" for x in "nmv"])
            for i, c in enumerate(columns)]
    t = unfold(df.agg(*aggs), rows).filter((F.col("na") > 1) & (F.col("nb") > 1))
    na, nb = F.col("na"), F.col("nb")
    dof = na + nb - 2
    pooled = ((na - 1) * F.col("va") + (nb - 1) * F.col("vb")) / dof
    stat = F.try_divide(F.col("ma") - F.col("mb"), F.sqrt(pooled * (1 / na + 1 / nb)))
    return (t.select("feature", na.alias("n_missing"), nb.alias("n_present"), F.col("ma").alias("mean_when_missing"),
                     F.col("mb").alias("mean_when_present"), stat.alias("t"), dof.alias("dof"))
            .withColumn("p_value", student_p("t", F.col("dof").cast("double")))
            .withColumn("significant", F.col("p_value") < alpha))


def missing_by_category(df: DataFrame, target: str, columns: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Independence of the missing flag from each category; all variables from one grouped count."""
    flagged = df.withColumn("_missing", X.missing_flag(target))
    return chi_square(cell_counts(flagged, columns, "_missing"), alpha)


def missing_share(df: DataFrame, target: str) -> DataFrame:
    """A19."""
    return df.agg(F.count_if(F.col(target).isNull()).alias("missing_count"), F.count("*").alias("total")).select(
        "missing_count", F.try_divide(F.col("missing_count") * 100.0, F.col("total")).alias("missing_pct"))


def missing_odds(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Logistic regression of the missing flag: coefficients, odds ratios, and how many rows had all inputs or lacked one.

    Rows that lack an input cannot enter the model; they are counted, not dropped in silence. Equal rows are one with their number as
    weight, written once; the steps of the fit then are jobs of a few tasks a core, so what the driver keeps of them doesn't grow with the table.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    known = df.select(X.missing_flag(target).cast("double").alias("label"), *[F.col(c).cast("double").alias(c) for c in columns])
    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull() & ~F.isnan(c)
    counted = stage(known.groupBy("label", *columns).agg(F.count("*").cast("double").alias("_n")), "rows")
    sizes = counted.agg(F.coalesce(F.sum(F.when(whole, F.col("_n"))), F.lit(0)).alias("used"),
                        F.coalesce(F.sum(F.when(~whole, F.col("_n"))), F.lit(0)).alias("lacking")).first()
    few = counted.filter(whole).coalesce(FIT_TASKS * max(1, df.sparkSession.sparkContext.defaultParallelism))
    ready = VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error").transform(few)
    model = LogisticRegression(maxIter=50, regParam=0.0, weightCol="_n").fit(ready.select("label", "features", "_n"))
    discard(df.sparkSession, counted)
    rows = [(c, float(w)) for c, w in zip(["intercept", *columns], [model.intercept, *model.coefficients])]
    out = df.sparkSession.createDataFrame(rows, "feature string, coefficient double")
    return (out.withColumn("odds_ratio", F.exp("coefficient"))
            .withColumns({"n_used": F.lit(sizes["used"]).cast("long"), "n_lacking": F.lit(sizes["lacking"]).cast("long")}))


def mean_fill_contrast(df: DataFrame, target: str, other: str) -> DataFrame:
    """Mean, deviation and correlation of ``target`` before and after filling with its mean."""
    mean = df.agg(F.avg(target).alias("m")).first()["m"]
    filled = F.coalesce(F.col(target).cast("double"), F.lit(mean).cast("double"))
    raw, y = F.col(target).cast("double"), F.col(other).cast("double")
    found = df.agg(*[agg.alias(f"{name}_{s}") for s, x in (("before", raw), ("after", filled))
                     for name, agg in (("mean", F.avg(x)), ("std", F.stddev_samp(x)), ("corr", F.corr(x, y)))])
    return unfold(found, [F.struct(F.lit(s).alias("stage"), *[F.col(f"{n}_{s}").alias(n) for n in ("mean", "std", "corr")])
                          for s in ("before", "after")])
