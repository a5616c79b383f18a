"""Shape of numeric columns: normality tests, histogram, density, normal scores, fences."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions import expressions as X
from cohortry.functions import texts
from cohortry.functions.special import normal_upper_p, polynomial, student_p, with_normal_quantile
from cohortry.operators.ordering import ranked, running
from cohortry.operators.profile import correlations, moments, unfold
from cohortry.operators.quantiles import quantile_rows, tall, value_counts

SHAPIRO_LIMIT = 5000
#: Ranks at either end whose normal scores are summed one by one.
EDGE = 64

# Weights and p-value polynomials of the W test (Royston 1995, AS R94), lowest power first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_GAMMA = [-2.273, 0.459]
SMALL_MEAN = [0.5440, -0.39978, 0.025054, -0.0006714]
SMALL_LOG_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_LOG_SD = [-0.4803, -0.082676, 0.0030302]


def k_squared_test(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, n, statistic, p_value)`` from one aggregation pass."""
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.skewness(c).alias(f"g{i}"), F.kurtosis(c).alias(f"k{i}")]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"g{i}").alias("g1"), F.col(f"k{i}").alias("g2"))
            for i, c in enumerate(columns)]
    tested = X.with_k_squared(unfold(df.agg(*aggs), rows))
    return tested.select("feature", "n", "statistic", F.exp(-F.col("statistic") / 2).alias("p_value"))


def _sizes(df: DataFrame, columns: Sequence[str]) -> dict[str, dict]:
    found = df.agg(*[agg.alias(f"{n}_{i}") for i, c in enumerate(columns) for n, agg in (("n", F.count(c)), ("mean", F.avg(c)))]).first() if columns else {}
    return {c: {n: found[f"{n}_{i}"] for n in ("n", "mean")} for i, c in enumerate(columns)}


def score_sums(df: DataFrame, columns: Sequence[str], sizes: dict[str, dict], shift: float, over: float) -> DataFrame:
    """Sums of the normal scores ``m(i)`` at ``(i - shift) / (n + over)`` over ranks of equal values.

    ``(feature, n, value, copies, rank, m, mm)``: rows of one rank, its score and square, for the ``EDGE`` ranks at either end, and without a rank
    the sums over all others of a value. Those are integrals with the corrections of Euler and Maclaurin, closed forms in the first and
    the last rank, which beyond the ends are as exact as the score itself. So a value is one row whatever the number of its copies.
    """
    counts = value_counts(df, columns).withColumnRenamed("n", "copies")
    n = _lookup({c: sizes[c]["n"] for c in columns}, "long")
    runs = running(counts, ["value"], {"last": "copies"}, by=["feature"]).withColumns({"first": F.col("last") - F.col("copies") + 1, "n": n})
    size = F.col("n") + over
    first, last, upper = F.col("first"), F.col("last"), F.greatest(F.col("n") - EDGE + 1, F.lit(EDGE + 1).cast("long"))
    none = F.array().cast("array<bigint>")
    ranks = F.concat(F.when(first <= EDGE, F.sequence(first, F.least(last, F.lit(EDGE).cast("long")))).otherwise(none),
                     F.when(last >= upper, F.sequence(F.greatest(first, upper), last)).otherwise(none))
    ends = runs.select("feature", "n", "value", F.lit(1).cast("long").alias("copies"), F.explode(ranks).alias("rank"))
    ends = with_normal_quantile(ends, (F.col("rank") - shift) / size, "m").withColumn("mm", F.col("m") * F.col("m"))
    inner = runs.withColumns({"low": F.greatest(first, F.lit(EDGE + 1).cast("long")), "high": F.least(last, upper - 1)}).filter("low <= high")
    for name, at in (("z0", "low"), ("z1", "high")):
        inner = with_normal_quantile(inner, (F.col(at) - shift) / size, name)

    def at_end(z: Column, rank: str) -> dict[str, Column]:
        height = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
        step = 1 / (size * height)
        return {"area": -size * height, "d1": step, "d3": (1 + 2 * z * z) * step * step * step, "area2": (F.col(rank) - shift) - size * z * height,
                "e1": 2 * z * step, "e3": (8 * z + 4 * z * z * z) * step * step * step}

    z0, z1 = F.col("z0"), F.col("z1")
    low, high = at_end(z0, "low"), at_end(z1, "high")

    def total(area: str, begin: Column, end: Column, one: str, three: str) -> Column:
        return high[area] - low[area] + (begin + end) / 2 + (high[one] - low[one]) / 12 - (high[three] - low[three]) / 720

    inner = inner.select("feature", "n", "value", (F.col("high") - F.col("low") + 1).alias("copies"), F.lit(None).cast("long").alias("rank"),
                         total("area", z0, z1, "d1", "d3").alias("m"), total("area2", z0 * z0, z1 * z1, "e1", "e3").alias("mm"))
    return ends.unionByName(inner)


def w_test(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shapiro-Wilk for every column with three values or more: ``(feature, n, statistic, p_value)``.

    The ranks come from ranges of the order and equal values are one row, so any size is within reach; the weights are an approximation
    that was published for up to 5,000 values.
    """
    sizes = _sizes(df, columns)
    fit = [c for c in columns if sizes[c]["n"] >= 3]
    if not fit:
        return df.sparkSession.createDataFrame([], "feature string, n long, statistic double, p_value double")
    rank, value, m = F.col("rank"), F.col("value"), F.col("m")
    gap = value - _lookup({c: sizes[c]["mean"] for c in fit})
    places = {"1": rank == 1, "2": rank == 2, "y": rank == F.col("n") - 1, "z": rank == F.col("n")}
    sums = score_sums(df, fit, sizes, 0.375, 0.25).groupBy("feature", "n").agg(
        F.sum("mm").alias("mm"), F.sum(gap * m).alias("xm"), F.sum(F.col("copies") * gap * gap).alias("ss"),
        *[F.max(F.when(at, gap)).alias(f"x{p}") for p, at in places.items()], *[F.max(F.when(at, m)).alias(f"m{p}") for p, at in places.items()])
    n = F.col("n").cast("double")
    u, root = 1 / F.sqrt(n), F.sqrt("mm")
    wide = F.col("n") > 5  # the second and the last but one have a weight of their own
    sums = sums.withColumn("a1", F.when(F.col("n") == 3, F.lit(math.sqrt(0.5))).otherwise(F.col("mz") / root + polynomial(u, LAST_WEIGHT)))
    sums = sums.withColumn("a2", F.when(wide, F.col("my") / root + polynomial(u, NEXT_WEIGHT)))
    a1, a2, x1, x2, xy, xz, m1, m2, my, mz = (F.col(c) for c in ("a1", "a2", "x1", "x2", "xy", "xz", "m1", "m2", "my", "mz"))
    phi = F.when(wide, (F.col("mm") - 2 * mz * mz - 2 * my * my) / (1 - 2 * a1 * a1 - 2 * a2 * a2)).otherwise(
        F.try_divide(F.col("mm") - 2 * mz * mz, 1 - 2 * a1 * a1))
    inner = F.col("xm") - m1 * x1 - mz * xz - F.when(wide, m2 * x2 + my * xy).otherwise(0.0)
    s = F.coalesce(F.try_divide(inner, F.sqrt(phi)), F.lit(0.0)) + a1 * (xz - x1) + F.when(wide, a2 * (xy - x2)).otherwise(0.0)
    w = sums.withColumn("s", s).withColumn("statistic", F.least(F.try_divide(F.col("s") * F.col("s"), F.col("ss")), F.lit(1.0)))
    size, log_n = F.col("n").cast("double"), F.log(F.col("n").cast("double"))
    left = F.log(1 - F.col("statistic"))
    small = (-F.log(polynomial(size, SMALL_GAMMA) - left) - polynomial(size, SMALL_MEAN)) / F.exp(polynomial(size, SMALL_LOG_SD))
    large = (left - polynomial(log_n, LARGE_MEAN)) / F.exp(polynomial(log_n, LARGE_LOG_SD))
    three = F.greatest(F.lit(6 / math.pi) * (F.asin(F.sqrt("statistic")) - math.asin(math.sqrt(0.75))), F.lit(0.0))
    z = F.when(F.col("n") >= 12, large).otherwise(small)
    return (w.withColumn("z", z).withColumn("p", normal_upper_p(F.coalesce("z", F.lit(float("nan")))))
            .select("feature", "n", "statistic", F.when(F.col("n") == 3, three).otherwise(F.col("p")).alias("p_value")))


def distribution_table(df: DataFrame, columns: Sequence[str], alpha: float = 0.05, limit: int = SHAPIRO_LIMIT) -> DataFrame:
    """Moments, the test recommended for the size, verdict and scaler advice."""
    shape = moments(df, columns)
    sizes = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return distribution_advice(shape, w_test(df, [c for c in columns if sizes[c] < limit]), alpha, limit)


def distribution_advice(shape: DataFrame, small: DataFrame, alpha: float = 0.05, limit: int = SHAPIRO_LIMIT) -> DataFrame:
    """T10-T12 for moments of columns and the W test of those below ``limit`` values."""
    small = small.select("feature", F.col("p_value").alias("w_p"))
    table = X.with_k_squared(shape.join(small, "feature", "left"), "k2")
    big = F.col("n") >= limit
    normal = F.col("p_value") > alpha
    words = texts.SCALER_ADVICE
    advice = F.when(normal, words[0]).when(F.abs("skewness") > 1, words[1]).otherwise(words[2])
    return (table.withColumn("normality_test", F.when(big, texts.LARGE_TEST).otherwise(texts.SMALL_TEST))
            .withColumn("p_value", F.when(big, F.exp(-F.col("k2") / 2)).otherwise(F.col("w_p")))
            .withColumn("is_normal", normal).withColumn("recommendation", advice)
            .select("feature", "n", "mean", "median", "std", "skewness", "kurtosis", "normality_test", "p_value",
                    "is_normal", "recommendation"))


def _ranges(df: DataFrame, columns: Sequence[str]):
    found = df.agg(*[agg.alias(f"{n}_{i}") for i, c in enumerate(columns) for n, agg in
                     (("lo", F.min(c)), ("hi", F.max(c)), ("n", F.count(c)), ("sd", F.stddev_samp(c)))]).first()
    return {c: {n: found[f"{n}_{i}"] for n in ("lo", "hi", "n", "sd")} for i, c in enumerate(columns)}


def _lookup(values: dict[str, float], dtype: str = "double"):
    return F.element_at(F.create_map(*[x for c, v in values.items() for x in (F.lit(c), F.lit(v).cast(dtype))]), F.col("feature"))


def histogram(df: DataFrame, columns: Sequence[str], bins: int = 50) -> DataFrame:
    """``(feature, bin, lower, n, density)``, every bin of every column that has values."""
    stats = _ranges(df, columns)
    known = [c for c in columns if stats[c]["n"]]
    low = _lookup({c: stats[c]["lo"] for c in known})
    # a column with one value gets a range of width one around it
    spans = {c: (float(stats[c]["hi"]) - float(stats[c]["lo"])) or 1.0 for c in known}
    lows = {c: float(stats[c]["lo"]) - (0.5 if stats[c]["hi"] == stats[c]["lo"] else 0.0) for c in known}
    low, width = _lookup(lows), _lookup({c: s / bins for c, s in spans.items()})
    number = F.least(F.floor((F.col("value") - low) / width), F.lit(bins - 1))
    counted = tall(df, known).select("feature", number.cast("int").alias("bin")).groupBy("feature", "bin").agg(F.count("*").alias("n"))
    names = df.sparkSession.createDataFrame([(c,) for c in known], "feature string")
    grid = names.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    counted = grid.join(counted, ["feature", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    total = _lookup({c: stats[c]["n"] for c in known})
    return counted.select("feature", "bin", (low + F.col("bin") * width).alias("lower"), "n",
                          (F.col("n") / total / width).alias("density"))


def density(df: DataFrame, columns: Sequence[str], points: int = 100) -> DataFrame:
    """Gaussian kernel density on an even grid, Scott's bandwidth: ``(feature, point, x, density)``.

    Values are counted first; each distinct value then adds to the fixed grid in a partial aggregate.
    """
    stats = {c: s for c, s in _ranges(df, columns).items() if s["n"] and s["sd"]}
    low = _lookup({c: s["lo"] for c, s in stats.items()})
    step = _lookup({c: (float(s["hi"]) - float(s["lo"])) / (points - 1) for c, s in stats.items()})
    h = _lookup({c: s["sd"] * s["n"] ** -0.2 for c, s in stats.items()})
    total = _lookup({c: s["n"] for c, s in stats.items()})
    spread = (value_counts(df, list(stats)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
              .withColumn("u", (low + F.col("point") * step - F.col("value")) / h))
    summed = spread.groupBy("feature", "point").agg(F.sum(F.col("n") * F.exp(-F.col("u") * F.col("u") / 2)).alias("k"))
    return summed.select("feature", "point", (low + F.col("point") * step).alias("x"),
                         (F.col("k") / (total * h * math.sqrt(2 * math.pi))).alias("density"))


def normal_scores(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Every value with its rank and theoretical normal score (Filliben's medians)."""
    sizes = {c: s["n"] for c, s in _ranges(df, columns).items() if s["n"]}
    places = ranked(tall(df, list(sizes), keep=[key]), ["value", key], by=["feature"])
    n, i = _lookup(sizes), F.col("rank")
    edge = F.pow(F.lit(0.5), 1 / n)
    median = F.when(i == n, edge).when(i == 1, 1 - edge).otherwise((i - 0.3175) / (n + 0.365))
    return with_normal_quantile(places, median, "theoretical").select("feature", key, "rank", "value", "theoretical")


def normal_fit(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Least-squares line through the normal scores of ``normal_scores``, from sums over equal values."""
    sizes = {c: s for c, s in _sizes(df, columns).items() if s["n"]}
    n = F.col("n").cast("double")
    edge = F.pow(F.lit(0.5), 1 / n)
    sums = score_sums(df, list(sizes), sizes, 0.3175, 0.365)
    # the first and the last rank have scores of their own
    sums = with_normal_quantile(sums, F.when(F.col("rank") == F.col("n"), edge).when(F.col("rank") == 1, 1 - edge).otherwise(F.lit(0.5)), "own")
    outer = F.coalesce(F.col("rank").isin(1) | (F.col("rank") == F.col("n")), F.lit(False))
    m, mm = F.when(outer, F.col("own")).otherwise(F.col("m")), F.when(outer, F.col("own") * F.col("own")).otherwise(F.col("mm"))
    mean = _lookup({c: s["mean"] for c, s in sizes.items()})
    gap = F.col("value") - mean
    total = sums.groupBy("feature", "n").agg(F.sum(m).alias("x"), F.sum(mm).alias("xx"), F.sum(gap * m).alias("xy"),
                                             F.sum(F.col("copies") * gap).alias("y"), F.sum(F.col("copies") * gap * gap).alias("yy"))
    x, y, xx, xy, yy = (F.col(c) for c in ("x", "y", "xx", "xy", "yy"))
    sxx, sxy, syy = xx - x * x / n, xy - x * y / n, yy - y * y / n
    slope = F.try_divide(sxy, sxx)
    return total.select("feature", "n", slope.alias("slope"), (mean + y / n - slope * x / n).alias("intercept"),
                        F.try_divide(sxy, F.sqrt(sxx * syy)).alias("r"))


def correlation_interval(df: DataFrame, columns: Sequence[str], target: str, z: float = 1.959963984540054,
                         weak: float = 0.05, alpha: float = 0.05) -> DataFrame:
    """Pearson r with p, 95 % interval, and the removal rule (weak and not significant)."""
    aggs = []
    for i, c in enumerate(columns):
        x, y = F.col(c).cast("double"), F.col(target).cast("double")
        aggs += [F.corr(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"r{i}").alias("r"))
            for i, c in enumerate(columns)]
    r, n = F.col("r"), F.col("n")
    fisher, half = F.atanh(r), F.lit(z) / F.sqrt(n - 3)
    return (unfold(df.agg(*aggs), rows).withColumn("lower", F.tanh(fisher - half)).withColumn("upper", F.tanh(fisher + half))
            .withColumn("t", r * F.sqrt(F.try_divide(n - 2, 1 - r * r)))
            .withColumn("p_value", student_p("t", (n - 2).cast("double")))
            .withColumn("remove", (F.abs("r") < weak) & (F.col("p_value") > alpha)))


def iqr_outliers(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Upper fence Q3 + 1.5 IQR, values above it and their share."""
    q = quantile_rows(df, columns, [0.25, 0.75])
    fence = {c: v[0.75] + factor * (v[0.75] - v[0.25]) for c, v in q.items() if v[0.25] is not None}
    counted = df.agg(*[a.alias(f"{n}{i}") for i, (c, f) in enumerate(fence.items())
                       for n, a in (("o", F.count_if(F.col(c) > f)), ("n", F.count(c)))])
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(q[c][0.25]).alias("q1"), F.lit(q[c][0.75]).alias("q3"),
                     F.lit(f).alias("fence"), F.col(f"o{i}").alias("n_outliers"),
                     (F.col(f"o{i}") * 100.0 / F.col(f"n{i}")).alias("outlier_pct")) for i, (c, f) in enumerate(fence.items())]
    return unfold(counted, rows)


def variance_inflation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Diagonal of the inverse correlation matrix (k * k numbers on the driver)."""
    k = len(columns)
    matrix = np.eye(k)
    for row in correlations(df, columns).collect():
        if row["i"] != row["j"]:
            matrix[row["i"], row["j"]] = row["r"]
    factors = np.diag(np.linalg.inv(matrix))
    return df.sparkSession.createDataFrame([(c, float(v)) for c, v in zip(columns, factors)], "feature string, vif double")
