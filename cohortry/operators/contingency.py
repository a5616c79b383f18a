"""Prevalence, cross-tabs and tests of independence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortry.functions.special import chi_square_p


def prevalence(df: DataFrame, group: str, outcome: str) -> DataFrame:
    """A2: size, positives, negatives and positive rate in percent per group, highest rate first."""
    counted = df.groupBy(group).agg(F.count(outcome).alias("total"), F.sum(outcome).alias("positives"),
                                    F.count_if(F.col(outcome) == 0).alias("negatives"))
    return (counted.withColumn("rate_pct", F.try_divide(F.col("positives") * 100.0, F.col("total")))
            .orderBy(F.desc("rate_pct"), group))


def crosstab_margins(df: DataFrame, row: str, col: str, margin: str = "Total") -> DataFrame:
    """A3: counts with totals of both sides, as grouping sets."""
    known = df.filter(F.col(row).isNotNull() & F.col(col).isNotNull())
    cube = known.cube(row, col).agg(F.count("*").alias("n"), F.grouping(row).alias("_r"), F.grouping(col).alias("_c"))

    def name(column, flag):
        return F.when(F.col(flag) == 1, margin).otherwise(F.col(column).cast("string"))

    return cube.select(name(row, "_r").alias("row_level"), name(col, "_c").alias("col_level"), "n")


def cell_counts(df: DataFrame, rows: Sequence[str], col: str) -> DataFrame:
    """Non-empty cells of the tables ``rows[i] x col``: ``(variable, row_level, col_level, n)``."""
    pairs = F.array(*[F.struct(F.lit(r).alias("variable"), F.col(r).cast("string").alias("row_level")) for r in rows])
    return (df.select(F.col(col).cast("string").alias("col_level"), F.inline(pairs))
            .filter(F.col("row_level").isNotNull() & F.col("col_level").isNotNull())
            .groupBy("variable", "row_level", "col_level").agg(F.count("*").alias("n")))


def crosstab_dense(cells: DataFrame) -> DataFrame:
    """A4: all combinations of the levels found, empty cells as zero."""
    rows, cols = (cells.select("variable", c).distinct() for c in ("row_level", "col_level"))
    grid = rows.join(cols, "variable")
    return (grid.join(cells, ["variable", "row_level", "col_level"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0).cast("long"))))


def with_margins(cells: DataFrame) -> DataFrame:
    rows = cells.groupBy("variable", "row_level").agg(F.sum("n").alias("row_total"))
    cols = cells.groupBy("variable", "col_level").agg(F.sum("n").alias("col_total"))
    totals = cells.groupBy("variable").agg(F.sum("n").alias("total"), F.countDistinct("row_level").alias("n_rows"),
                                           F.countDistinct("col_level").alias("n_cols"))
    return (cells.join(rows, ["variable", "row_level"]).join(cols, ["variable", "col_level"]).join(totals, "variable")
            .withColumn("expected", F.col("row_total") * F.col("col_total") / F.col("total")))


def expected_frequencies(cells: DataFrame, smallest: float = 5) -> DataFrame:
    """Expected counts of every cell, and whether each is large enough."""
    return (with_margins(crosstab_dense(cells))
            .select("variable", "row_level", "col_level", "n", "expected", (F.col("expected") >= smallest).alias("large_enough")))


def chi_square(cells: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Statistic, dof, p and Cramer's V per variable; Yates correction for two by two tables.

    Works on the non-empty cells only: an empty cell adds its expected count, and in a two by two table every
    cell has the same distance from its expected count.
    """
    gap = F.abs(F.col("n") - F.col("expected"))
    t = with_margins(cells).groupBy("variable").agg(
        F.first("total").alias("n"), F.first("n_rows").alias("n_rows"), F.first("n_cols").alias("n_cols"),
        F.count("*").alias("filled"), F.sum("expected").alias("covered"),
        F.sum(gap * gap / F.col("expected")).alias("plain"), F.max(gap).alias("gap"),
        F.min("row_total").alias("row_min"), F.min("col_total").alias("col_min"))

    def inverse(smaller):
        return 1 / F.col(smaller) + 1 / (F.col("n") - F.col(smaller))

    empty = F.when(F.col("filled") < F.col("n_rows") * F.col("n_cols"), F.col("n") - F.col("covered")).otherwise(0.0)
    shrunk = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    corrected = shrunk * shrunk * F.col("n") * inverse("row_min") * inverse("col_min")
    two_by_two = (F.col("n_rows") == 2) & (F.col("n_cols") == 2)
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    stat = F.when(dof == 0, 0.0).when(two_by_two, corrected).otherwise(F.col("plain") + empty)
    smaller = F.least("n_rows", "n_cols") - 1
    return (t.select("variable", stat.alias("chi2"), dof.alias("dof"), "n",
                     (F.col("row_min") * F.col("col_min") / F.col("n")).alias("min_expected"),
                     F.sqrt(F.try_divide(stat, F.col("n") * smaller)).alias("cramers_v"))
            .withColumn("p_value", F.when(F.col("dof") == 0, 1.0).otherwise(chi_square_p("chi2", "dof")))
            .withColumn("significant", F.col("p_value") < alpha))


def pairwise_chi_square(df: DataFrame, group: str, outcome: str, base: str, alpha: float = 0.05) -> DataFrame:
    """The base level against every other level, from one count per level."""
    levels = (df.filter(F.col(group).isNotNull()).groupBy(F.col(group).cast("string").alias("level"))
              .agg(F.count_if(F.col(outcome) == 1).alias("pos"), F.count_if(F.col(outcome) == 0).alias("neg"))
              .withColumn("variable", F.lit(group)))
    left = levels.filter(F.col("level") == base).select("variable", F.col("pos").alias("a"), F.col("neg").alias("b"))
    right = levels.filter(F.col("level") != base).select("variable", "level", F.col("pos").alias("c"), F.col("neg").alias("d"))
    t = right.join(left, "variable")
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = a + b + c + d
    gap = F.greatest(F.abs(a * d - b * c) / n - 0.5, F.lit(0.0))
    spread = n * (1 / (a + b) + 1 / (c + d)) * (1 / (a + c) + 1 / (b + d))
    return (t.filter((F.col("a") + F.col("c") > 0) & (F.col("b") + F.col("d") > 0)
                     & (F.col("a") + F.col("b") > 0) & (F.col("c") + F.col("d") > 0))
            .select(F.lit(base).alias("base_level"), F.col("level").alias("other_level"),
                    (gap * gap * spread).alias("chi2"), F.lit(1).alias("dof"),
                    (a / (a + b) * 100).alias("base_rate"), (c / (c + d) * 100).alias("other_rate"))
            .withColumn("p_value", chi_square_p("chi2", "dof")).withColumn("significant", F.col("p_value") < alpha))


def mutual_information(cells: DataFrame) -> DataFrame:
    """In bits, per variable."""
    p = F.col("n") / F.col("total")
    return with_margins(cells).groupBy("variable").agg(F.sum(p * F.log2(F.col("n") / F.col("expected"))).alias("mutual_information"))
