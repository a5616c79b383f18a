"""Exact running totals and ranks along an order, without a window that puts the whole table in one task.

Spark deals the rows to ranges of the order, about equally many to each, and the ranges are written with their numbers; a window
runs inside each range and the totals of the earlier ranges are added. The written numbers hold for every later pass, also when
a lost executor makes Spark compute a partition again. The number of ranges follows the number of rows, whatever it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortry.session import stage

ROWS_PER_RANGE = 250_000


def with_ranges(df: DataFrame, keys: Sequence[str], rows: int, rows_per_range: int, name: str = "_range") -> DataFrame:
    """A written copy of ``df`` with the number of each row's range of ``keys``."""
    ranges = max(1, -(-rows // rows_per_range))
    return stage(df.repartitionByRange(ranges, *[F.col(k) for k in keys]).withColumn(name, F.spark_partition_id()), "ranges")


def running(
    df: DataFrame,
    order: Sequence[str],
    sums: dict[str, str],
    by: Sequence[str] = (),
    descending: bool = False,
    following: dict[str, str] | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
    staged: bool = False,
) -> DataFrame:
    """Add inclusive running totals ``sums`` (new name -> numeric column) along ``order`` within ``by``.

    ``following`` (new name -> column) adds the value of the next row in the order. ``order`` within ``by``
    must be unique, so that the result does not depend on how ties fall. The input is staged first, for its count and for the
    sample that Spark cuts the ranges by, unless the caller has done so.
    """
    following = following or {}
    keys = [*by, *order]
    df = df if staged else stage(df, "ordered")
    arrange = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    ranged = with_ranges(df, keys, df.count(), rows_per_range)
    inner = Window.partitionBy(*by, "_range").orderBy(*arrange)
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cols = {name: F.sum(source).over(upto) for name, source in sums.items()}
    cols.update({name: F.lead(source).over(inner) for name, source in following.items()})
    if following:
        cols["_last"] = F.lead(F.lit(1)).over(inner).isNull()
    first = F.max_by if descending else F.min_by
    parts = ranged.groupBy(*by, "_range").agg(
        *[F.sum(source).alias(f"_t_{name}") for name, source in sums.items()],
        *[first(source, F.struct(*order)).alias(f"_f_{name}") for name, source in following.items()],
    )
    step = F.col("_range").desc() if descending else F.col("_range").asc()
    outer = Window.partitionBy(*by).orderBy(step) if by else Window.partitionBy(F.lit(0)).orderBy(step)
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*by, "_range"]],
        *[F.coalesce(F.sum(f"_t_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in sums],
        *[F.lead(f"_f_{name}").over(outer).alias(f"_n_{name}") for name in following],
    )
    match = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*by, "_range"]]
    joined = ranged.withColumns(cols).join(offsets, match)
    fixed = {name: F.col(name) + F.col(f"_o_{name}") for name in sums}
    fixed.update({name: F.when(F.col("_last"), F.col(f"_n_{name}")).otherwise(F.col(name)) for name in following})
    return joined.select(*df.columns, *[expr.alias(name) for name, expr in fixed.items()])


def ranked(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rank", **options) -> DataFrame:
    """Add the 1-based position of every row along ``order`` within ``by``."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}, by, **options).drop("_one")
