"""Reading inputs, keeping intermediate results, and giving every row what its group agreed on without gathering the group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry.session import stage

__all__ = ["read", "stage", "slots_of", "SLOTS", "spread", "fresh"]

#: A group's rows are dealt to so many places at most before they are combined.
SLOTS = 16


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def slots_of(*keys: Column) -> Column:
    """The place, from 0 to ``SLOTS - 1``, of a row in its group."""
    return F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).cast("int")


def spread(groups: DataFrame, mask: str, slot: str) -> DataFrame:
    """One copy of a group's row for each place in which its members are; ``mask`` has a bit for each."""
    places = F.expr(f"filter(sequence(0, {SLOTS - 1}), i -> (shiftright({mask}, i) & 1) = 1)")
    return groups.withColumn(slot, F.explode(places)).drop(mask)
