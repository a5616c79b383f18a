"""Stratified split, folds and seeded sampling by hash order: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_DIGITS = 4


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))


def _bucketed(df: DataFrame, key: str, seed: int, digits: int) -> DataFrame:
    return df.withColumn("_h", hash_order(key, seed)).withColumn("_b", F.substring("_h", 1, digits))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42,
                     digits: int = HASH_DIGITS, name: str = "is_test") -> DataFrame:
    """flag the first ``round(share * n)`` rows of every class in hash order.

    Only counts per hash bucket are shuffled; the exact cut is then found among the rows of one bucket per
    class, and the flag is a comparison with that cut. The table itself stays where it is.
    """
    marked = _bucketed(df.select(key, label), key, seed, digits)
    counts = marked.groupBy(label, "_b").agg(F.count("*").alias("n"))
    upto = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(label)
    cuts = (counts.withColumn("c", F.sum("n").over(upto)).withColumn("want", F.round(F.sum("n").over(whole) * test_share))
            .filter((F.col("c") >= F.col("want")) & (F.col("c") - F.col("n") < F.col("want")))
            .select(F.col(label).alias("_y"), F.col("_b").alias("_cb"), (F.col("want") - (F.col("c") - F.col("n"))).alias("_left")))
    edge = marked.join(cuts, F.col(label).eqNullSafe(F.col("_y")) & (F.col("_b") == F.col("_cb")))
    place = F.row_number().over(Window.partitionBy("_y").orderBy("_h", key))
    last = (edge.withColumn("_p", place).filter(F.col("_p") == F.col("_left"))
            .select("_y", F.col("_h").alias("_ch"), F.col(key).alias("_ck")).collect())
    flag = F.lit(False)
    h = F.col("_h")
    for row in last:
        below = (h < row["_ch"]) | ((h == row["_ch"]) & (F.col(key) <= row["_ck"]))
        flag = F.when(F.col(label).eqNullSafe(F.lit(row["_y"])), below).otherwise(flag)
    return df.withColumn("_h", hash_order(key, seed)).withColumn(name, flag).drop("_h")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42, digits: int = HASH_DIGITS) -> DataFrame:
    """deal the rows of every class to ``k`` folds in hash order.

    The rank is counted inside (class, hash bucket), which are small and even, plus the size of the earlier
    buckets, so a class with almost all rows is still spread over all tasks.
    """
    marked = _bucketed(df, key, seed, digits)
    counts = marked.groupBy(label, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col(label).alias("_y"), F.col("_b").alias("_ob"),
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", key))
    placed = marked.withColumn("_p", inside).join(
        offsets, F.col(label).eqNullSafe(F.col("_y")) & (F.col("_b") == F.col("_ob")))
    return placed.select(*df.columns, F.pmod(F.col("_o") + F.col("_p") - 1, F.lit(k)).cast("int").alias("fold"))


def hash_sample(df: DataFrame, key: str, n: int = 500, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed."""
    return df.withColumn("_h", hash_order(key, seed)).orderBy("_h", key).limit(n).drop("_h")
