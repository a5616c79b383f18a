"""Exact quantiles with linear interpolation in two narrow passes.

The first pass brackets every wanted rank with an approximate quantile sketch of fixed size; the second counts
what lies below each bracket and keeps the value counts inside it. Nothing but those few counts is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.operators.ordering import running

ACCURACY = 10_000


def tall(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """One row per (row, column) with a known value: ``keep..., feature, value``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast(dtype).alias("value")) for c in columns])
    return df.select(*keep, F.inline(pairs)).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str], dtype: str = "double") -> DataFrame:
    return tall(df, columns, dtype=dtype).groupBy("feature", "value").agg(F.count("*").alias("n"))


def quantile_rows(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], accuracy: int = ACCURACY,
) -> dict[str, dict[float, float]]:
    """``{column: {p: quantile}}``, exact; NULLs are left out and an all-NULL column gives None."""
    slack = 2.0 / accuracy
    edges = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    sketch = df.agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)],
                    *[F.approx_percentile(F.col(c).cast("double"), edges, accuracy).alias(f"q_{i}")
                      for i, c in enumerate(columns)]).first()
    result: dict[str, dict[float, float]] = {c: {p: None for p in probs} for c in columns}
    sizes = {c: sketch[f"n_{i}"] for i, c in enumerate(columns)}
    pairs = []
    for i, c in enumerate(columns):
        if not sizes[c]:
            continue
        value = F.col(c).cast("double")
        # odd bands are brackets and keep their values, even bands lie between them and are only counted
        band, number = F.when(value.isNull(), F.lit(-1)), 0
        for low, high in _merged(sketch[f"q_{i}"]):
            band = band.when(value < low, number).when(value <= high, number + 1)
            number += 2
        band = band.otherwise(number)
        kept = F.when(band % 2 == 1, value)
        pairs.append(F.struct(F.lit(c).alias("feature"), band.alias("band"), kept.alias("value")))
    if not pairs:
        return result

    inside = (df.select(F.inline(F.array(*pairs))).filter(F.col("band") >= 0)
              .groupBy("feature", "band", "value").agg(F.count("*").alias("n")))
    positions = {(c, p): p * (sizes[c] - 1) for c in columns if sizes[c] for p in probs}
    cumulative = running(inside, ["band", "value"], {"upto": "n"}, by=["feature"])
    chosen = F.lit(False)
    for (c, _), position in positions.items():
        for rank in {math.floor(position), math.ceil(position)}:
            chosen = chosen | ((F.col("feature") == c) & (F.col("upto") - F.col("n") <= rank) & (F.col("upto") > rank))
    covered = [(r["feature"], r["value"], r["n"], r["upto"]) for r in cumulative.filter(chosen).collect()]

    for (c, p), position in positions.items():
        ends = []
        for rank in (math.floor(position), math.ceil(position)):
            hit = [v for feature, v, n, upto in covered if feature == c and upto - n <= rank < upto and v is not None]
            ends.append(hit[0] if hit else None)
        if None in ends:
            # the sketch missed the rank: count every distinct value of this column instead
            result[c][p] = _from_all_values(df, c, position)
        else:
            result[c][p] = ends[0] + (ends[1] - ends[0]) * (position - math.floor(position))
    return result


def _merged(edges: Sequence[float]) -> list[tuple[float, float]]:
    """Brackets (low, high, low, high, ...) in order, overlapping ones joined."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(zip(edges[::2], edges[1::2])):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _from_all_values(df: DataFrame, column: str, position: float) -> float:
    counts = running(value_counts(df, [column]), ["value"], {"upto": "n"})
    low, high = math.floor(position), math.ceil(position)

    def at(rank):
        return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (F.col("upto") > rank), F.col("value")))

    row = counts.agg(at(low).alias("low"), at(high).alias("high")).first()
    return row["low"] + (row["high"] - row["low"]) * (position - low)
