"""Sinks: tables as parquet, CSV or JSON, run records, fitted models."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from cohortry.operators.boosting import BoostedModel
from cohortry.plans.features import FeatureState


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """S6, S8."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def write_record(spark: SparkSession, record: dict, path: str) -> None:
    """One JSON object."""
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def save_bundle(state: FeatureState, model: BoostedModel, path: str, spark: SparkSession) -> None:
    """Preparation state and trees as one fitted unit."""
    state.save(f"{path}/features", spark)
    model.save(f"{path}/model", spark)


def load_bundle(path: str, spark: SparkSession) -> tuple[FeatureState, BoostedModel]:
    return FeatureState.load(f"{path}/features", spark), BoostedModel.load(f"{path}/model", spark)
