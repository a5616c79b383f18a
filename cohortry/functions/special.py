"""Tail probabilities and the normal quantile.

The normal quantile is a chain of Column expressions. The tail probabilities are Arrow functions meant for result
tables of a few rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Rational approximation of the normal quantile (Wichura 1988, AS 241, PPND16).
CENTRE_NUM = [3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4,
              4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3]
CENTRE_DEN = [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
              2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]
MIDDLE_NUM = [1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0,
              1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4]
MIDDLE_DEN = [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
              1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]
TAIL_NUM = [6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1,
            2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7]
TAIL_DEN = [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
            7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]


def polynomial(x: Column, coefficients: list[float]) -> Column:
    out = F.lit(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = out * x + F.lit(c)
    return out


def with_normal_quantile(df: DataFrame, p: Column, name: str) -> DataFrame:
    """Add the normal quantile of ``p``; shared parts are columns of their own, which keeps the generated code small."""
    df = df.withColumn("_p", p).withColumns({"_q": F.col("_p") - 0.5, "_r": F.sqrt(-F.log(F.least("_p", 1 - F.col("_p"))))})
    df = df.withColumns({"_near": F.lit(0.180625) - F.col("_q") * F.col("_q"), "_mid": F.col("_r") - 1.6, "_far": F.col("_r") - 5})
    q, near, mid, far = (F.col(c) for c in ("_q", "_near", "_mid", "_far"))
    centre = q * polynomial(near, CENTRE_NUM) / polynomial(near, CENTRE_DEN)
    middle = polynomial(mid, MIDDLE_NUM) / polynomial(mid, MIDDLE_DEN)
    tail = polynomial(far, TAIL_NUM) / polynomial(far, TAIL_DEN)
    size = F.when(F.abs(q) <= 0.425, centre).otherwise(F.signum(q) * F.when(F.col("_r") <= 5, middle).otherwise(tail))
    return df.withColumn(name, size).drop("_p", "_q", "_r", "_near", "_mid", "_far")


def chi_square_tail(x: float, dof: int) -> float:
    """P(X >= x) for a whole number of degrees of freedom, as a finite sum."""
    if x is None or dof is None or dof < 1 or math.isnan(x):
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2.0
    if dof % 2 == 0:
        total, log_term = 0.0, -half
        start = 0
    else:
        total = math.erfc(math.sqrt(half))
        log_term = -half + 0.5 * math.log(half) - math.lgamma(1.5)
        start = 0.5
    for i in range(dof // 2):
        total += math.exp(log_term)
        log_term += math.log(half) - math.log(i + 1 + start)
    return min(1.0, total)


def beta_tail(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0.0 or x >= 1.0:
        return 0.0 if x <= 0.0 else 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_tail(1.0 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                     -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * value


def student_tail(t: float, dof: float) -> float:
    """Two-sided P(|T| >= |t|)."""
    if t is None or dof is None or math.isnan(t) or not dof > 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return beta_tail(dof / (dof + t * t), dof / 2.0, 0.5)


@F.pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi_square_tail(a, int(b)) if b == b and b is not None else np.nan for a, b in zip(x, dof)])


@F.pandas_udf(DoubleType())
def student_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([student_tail(a, b) for a, b in zip(t, dof)])


@F.pandas_udf(DoubleType())
def normal_upper_p(z: pd.Series) -> pd.Series:
    return pd.Series([0.5 * math.erfc(v / math.sqrt(2.0)) if v == v else np.nan for v in z])
