"""Leakage-safe feature preparation as a fitted state and a plain projection."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.operators.neighbours import DonorIndex, fill_missing
from cohortry.operators.quantiles import quantile_rows, tall
from cohortry.session import stage


@dataclass
class FeatureState:
    """What the training rows taught: medians and spreads, levels, and the donors with their index. Small but for the donors."""

    key: str
    numeric: list[str]
    imputed: str | None
    categorical: list[str]
    neighbours: int
    centre: dict[str, float]
    scale: dict[str, float]
    levels: dict[str, list[str]]
    donors: DonorIndex | None = field(default=None, repr=False)

    @property
    def flag(self) -> str | None:
        return f"{self.imputed}_missing" if self.imputed else None

    @property
    def numeric_names(self) -> list[str]:
        return [f"numerical__{c}" for c in [*self.numeric, *([self.flag] if self.flag else [])]]

    @property
    def names(self) -> list[str]:
        """F8: output columns in order."""
        return self.numeric_names + [name for bundle in self.bundles for name in bundle]

    @property
    def bundles(self) -> list[list[str]]:
        """The columns of each categorical, of which a row has at most one."""
        return [[f"categorical__{c}_{v}" for v in self.levels[c][1:]] for c in self.categorical]

    def save(self, path: str, spark: SparkSession) -> None:
        """The small part as JSON lines, the donors and their index as parquet."""
        small = {k: v for k, v in asdict_without_donors(self).items()}
        spark.createDataFrame([(json.dumps(small),)], "state string").coalesce(1).write.mode("overwrite").text(f"{path}/state")
        if self.donors is not None:
            self.donors.save(f"{path}/donors", spark)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> FeatureState:
        small = json.loads(spark.read.text(f"{path}/state").first()["value"])
        donors = DonorIndex.load(f"{path}/donors", spark) if small["imputed"] else None
        return cls(donors=donors, **small)


def asdict_without_donors(state: FeatureState) -> dict:
    donors, state.donors = state.donors, None
    try:
        small = asdict(state)
    finally:
        state.donors = donors
    del small["donors"]
    return small


def _scaled(state: FeatureState, column: str) -> Column:
    return (F.col(column).cast("double") - F.lit(state.centre[column])) / F.lit(state.scale[column])


def _flagged(df: DataFrame, imputed: str | None) -> DataFrame:
    return df if imputed is None else df.withColumn(f"{imputed}_missing", F.col(imputed).isNull().cast("int"))


def scaler_stats(df: DataFrame, columns: Sequence[str]) -> tuple[dict[str, float], dict[str, float]]:
    """exact medians and interquartile ranges; a zero range counts as one."""
    q = quantile_rows(df, columns, [0.25, 0.5, 0.75])
    centre = {c: v[0.5] for c, v in q.items()}
    return centre, {c: ((v[0.75] - v[0.25]) or 1.0) if v[0.25] is not None else 1.0 for c, v in q.items()}


def category_levels(df: DataFrame, columns: Sequence[str], most: int = 10_000) -> dict[str, list[str]]:
    """sorted levels per column. Each one but the first becomes a column, so more than ``most`` in one column is an error."""
    if not columns:
        return {}
    levels = stage(tall(df, columns, dtype="string").distinct(), "levels")
    wide = [r["feature"] for r in levels.groupBy("feature").count().filter(F.col("count") > most).collect()]
    if wide:
        raise ValueError(f"more than {most} levels in {', '.join(sorted(wide))}: too many to encode as columns")
    found = levels.collect()
    return {c: sorted(r["value"] for r in found if r["feature"] == c) for c in columns}


def fit(train: DataFrame, key: str, numeric: Sequence[str], categorical: Sequence[str], imputed: str | None = None,
        neighbours: int = 10) -> FeatureState:
    """learn the state from the training rows only."""
    flagged = _flagged(train, imputed)
    columns = [*numeric, *([f"{imputed}_missing"] if imputed else [])]
    centre, scale = scaler_stats(flagged, columns)
    state = FeatureState(key, list(numeric), imputed, list(categorical), neighbours, centre, scale,
                         category_levels(train, categorical))
    if imputed:
        coords = [c for c in numeric if c != imputed]
        known = train.filter(F.col(imputed).isNotNull())
        rows = stage(known.select(key, *[_scaled(state, c).alias(f"numerical__{c}") for c in [*coords, imputed]]), "fit")
        state.donors = DonorIndex(rows, [f"numerical__{c}" for c in coords], key, f"numerical__{imputed}", neighbours)
    return state


def one_hot(state: FeatureState, columns: Sequence[str] | None = None) -> list[Column]:
    """first level dropped; a level not seen in training gives zeros everywhere."""
    return [F.when(F.col(from_).cast("string") == v, 1.0).otherwise(0.0).alias(f"categorical__{c}_{v}")
            for c, from_ in zip(state.categorical, state.categorical if columns is None else columns, strict=True) for v in state.levels[c][1:]]


def apply(state: FeatureState, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``key, keep..., features...`` for any rows, from the fitted state alone."""
    flagged = _flagged(df, state.imputed)
    columns = [*state.numeric, *([state.flag] if state.flag else [])]
    levels = [f"_level{i}" for i in range(len(state.categorical))]  # become columns last, when the rows have been written
    table = flagged.select(state.key, *keep, *[_scaled(state, c).alias(f"numerical__{c}") for c in columns],
                           *[F.col(c).cast("string").alias(level) for c, level in zip(state.categorical, levels, strict=True)])
    if state.imputed:
        coords = [f"numerical__{c}" for c in state.numeric if c != state.imputed]
        table = fill_missing(table, f"numerical__{state.imputed}", coords, state.key, state.donors, state.neighbours,
                             gap2=1.0 / state.scale[state.flag] ** 2)
    return table.select(state.key, *keep, *[f"numerical__{c}" for c in columns], *one_hot(state, levels))
