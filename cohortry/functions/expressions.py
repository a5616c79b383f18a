"""Column expressions: labels, bands, bias-adjusted moments and the K2 normality statistic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions import texts

def missing_flag(column: str) -> Column:
    """P5: 1 where the value is missing."""
    return F.col(column).isNull().cast("int")


def missing_pattern(columns: list[str]) -> Column:
    """One 0/1 digit per column."""
    return F.concat(*[missing_flag(c).cast("string") for c in columns])


def predicted_class(score: Column, threshold: float = 0.5) -> Column:
    """The threshold belongs to the positive class."""
    return (score >= F.lit(threshold)).cast("int")


def risk_level(p: Column, low: float = 0.2, moderate: float = 0.5, high: float = 0.8) -> Column:
    """P7."""
    names = texts.RISK_LEVELS
    return F.when(p < low, names[0]).when(p < moderate, names[1]).when(p < high, names[2]).otherwise(names[3])


def alert(p: Column, threshold: float = 0.8, text: str = texts.ALERT_TEXT) -> Column:
    """P8."""
    return F.when(p >= threshold, F.lit(text))


def confidence(p: Column) -> Column:
    """From the distance to one half."""
    distance = F.abs(p - 0.5)
    names = texts.CONFIDENCE
    return F.when(distance > 0.4, names[0]).when(distance > 0.2, names[1]).otherwise(names[2])


def percent_text(p: Column) -> Column:
    """P10: percent with one decimal, rounded from the exact binary value (Java's own formatting rounds the decimal text).

    With n the odd number of twentieths between the two candidates, x lies above their middle when 20x > n;
    16x, 4x and n - 16x are exact near it.
    """
    x = p * 100
    tenths = F.floor(x * 10)
    rest = 2 * tenths + 1 - x * 16
    up = (x * 4 > rest) | ((x * 4 == rest) & (tenths % 2 == 1))
    rounded = tenths + up.cast("long")
    return F.concat(F.floor(rounded / 10).cast("string"), F.lit("."), (rounded % 10).cast("string"), F.lit("%"))


def plain_name(name: Column, prefix: str = "^(numerical|categorical|model)__") -> Column:
    """Feature or parameter name without its branch prefix."""
    return F.regexp_replace(name, prefix, "")


def strength(r: Column) -> Column:
    """P14."""
    names = texts.STRENGTH
    return F.when(F.abs(r) > 0.5, names[0]).when(F.abs(r) > 0.3, names[1]).otherwise(names[2])


def direction(r: Column) -> Column:
    return F.when(r > 0, "positive").otherwise("negative")


def adjusted_skewness(n: Column, g1: Column) -> Column:
    return F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def adjusted_kurtosis(n: Column, g2: Column) -> Column:
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def with_k_squared(df: DataFrame, name: str = "statistic") -> DataFrame:
    """D'Agostino-Pearson K2 from columns ``n``, ``g1``, ``g2`` (population skewness, excess kurtosis)."""
    n, g1, g2 = F.col("_n"), F.col("g1"), F.col("g2")
    df = df.withColumn("_n", F.col("n").cast("double"))
    df = df.withColumns({
        "_b": 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)),
        "_x": (g2 + 3 - 3 * (n - 1) / (n + 1)) / F.sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))),
        "_s": (6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))))})
    df = df.withColumns({"_w": F.sqrt(2 * (F.col("_b") - 1)) - 1,
                         "_a": 6 + 8 / F.col("_s") * (2 / F.col("_s") + F.sqrt(1 + 4 / (F.col("_s") * F.col("_s"))))})
    w, a, x = F.col("_w"), F.col("_a"), F.col("_x")
    df = df.withColumns({"_y": g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2))) / F.sqrt(2 / (w - 1)),
                         "_d": 1 + x * F.sqrt(2 / (a - 4))})
    y, d = F.col("_y"), F.col("_d")
    cube = F.signum(d) * F.pow((1 - 2 / a) / F.abs(d), F.lit(1 / 3))
    df = df.withColumns({"_zs": F.log(y + F.sqrt(y * y + 1)) / F.sqrt(0.5 * F.log(w)),
                         "_zk": (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))})
    return (df.withColumn(name, F.col("_zs") * F.col("_zs") + F.col("_zk") * F.col("_zk"))
            .drop("_n", "_b", "_x", "_s", "_w", "_a", "_y", "_d", "_zs", "_zk"))
