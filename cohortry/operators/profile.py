"""Table profiles: summary, missingness, cardinality, class balance, moments, correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortry.functions import expressions as X
from cohortry.functions import texts
from cohortry.operators.ordering import ranked, running
from cohortry.operators.quantiles import quantile_rows, value_counts
from cohortry.session import stage

def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def unfold(df: DataFrame, rows: list[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return df.select(F.inline(F.array(*rows)))


def table_summary(df: DataFrame, label: str, spread: Sequence[str], outlier: tuple[str, float] | None = None) -> DataFrame:
    """``(section, name, value)`` from one aggregation pass, plus exact medians."""
    columns = df.columns
    medians = quantile_rows(df, spread, [0.5])
    aggs = [F.count("*").alias("rows")]
    aggs += [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns]
    aggs += [F.count_if(F.col(label) == v).alias(f"label_{v}") for v in (0, 1)]
    for c in spread:
        aggs += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"mean_{c}")]
    if outlier:
        aggs.append(F.count_if(F.col(outlier[0]) > outlier[1]).alias("outliers"))

    def row(section, name, value):
        return F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), value.cast("double").alias("value"))

    rows = [row("shape", "rows", F.col("rows")), row("shape", "columns", F.lit(len(columns)))]
    rows += [row("missing", c, F.col(f"null_{c}")) for c in columns]
    rows += [row("label", str(v), F.col(f"label_{v}")) for v in (0, 1)]
    for c in spread:
        rows += [row(stat, c, F.col(f"{stat}_{c}")) for stat in ("min", "max", "mean")]
        rows.append(row("median", c, F.lit(medians[c][0.5])))
    if outlier:
        rows.append(row("outliers", outlier[0], F.col("outliers")))
    return unfold(df.agg(*aggs), rows)


def level_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The levels of each text column with their counts."""
    return value_counts(df, columns, dtype="string").withColumnRenamed("value", "level")


def missing_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that have missing values, with share, type and advice; largest share first."""
    types = {c: df.schema[c].dataType.simpleString() for c in columns}
    counted = df.agg(F.count("*").alias("total"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("missing_count"), F.col("total"), F.lit(types[c]).alias("data_type")) for c in columns]
    return missing_advice(unfold(counted, rows))


def missing_advice(table: DataFrame) -> DataFrame:
    """A6 for ``(feature, missing_count, total, data_type)``."""
    pct = F.col("missing_pct")
    words = texts.MISSING_ADVICE
    advice = F.when(pct < 5, words[0]).when(pct < 20, words[1]).otherwise(words[2])
    share = F.try_divide(F.col("missing_count") * 100.0, F.col("total"))
    return (table.filter(F.col("missing_count") > 0).select("feature", "missing_count", share.alias("missing_pct"), "data_type")
            .withColumn("advice", advice).orderBy(F.desc("missing_pct"), "feature"))


def all_value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, value, n)`` for columns of any type, from one scan; values are counted in their own type family."""
    def family(c: str) -> str:
        dtype = df.schema[c].dataType
        return "long" if isinstance(dtype, T.IntegralType) else "double" if isinstance(dtype, T.NumericType) else "string"

    def slot(c: str, name: str) -> Column:
        return (F.col(c) if family(c) == name else F.lit(None)).cast(name).alias(f"_{name}")

    names = ["long", "double", "string"]
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), *[slot(c, name) for name in names]) for c in columns])
    slots = [f"_{name}" for name in names]
    value = F.coalesce(*[F.col(s).cast("string") for s in slots])
    known = F.col("_long").isNotNull() | F.col("_double").isNotNull() | F.col("_string").isNotNull()
    counted = df.select(F.inline(pairs)).filter(known)
    return counted.groupBy("feature", *slots).agg(F.count("*").alias("n")).select("feature", value.alias("value"), "n")


def cardinality(df: DataFrame, columns: Sequence[str], low_ratio: float = 0.01) -> DataFrame:
    """Distinct values, ratio, type labels, encoding advice per column."""
    totals = df.agg(F.count("*").alias("total"))
    names = [F.struct(F.lit(c).alias("feature"), F.lit(is_numeric(df, c)).alias("numeric"),
                      F.col("total").alias("total_samples")) for c in columns]
    distinct = all_value_counts(df, columns).groupBy("feature").agg(F.count("*").alias("n"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return cardinality_advice(unfold(totals, names).join(distinct, "feature", "left").withColumn("unique_values", n), low_ratio)


def cardinality_advice(table: DataFrame, low_ratio: float = 0.01) -> DataFrame:
    """A9, A11 for ``(feature, numeric, total_samples, unique_values)``."""
    u, numeric = F.col("unique_values"), F.col("numeric")
    binary, discrete, continuous = texts.NUMERIC_TYPES
    few, medium, many = texts.TEXT_TYPES
    detail = (F.when(numeric & (u == 2), binary).when(numeric & (u < 10), discrete).when(numeric, continuous)
              .when(u < 10, few).when(u < 50, medium).otherwise(many))
    family = F.when(numeric, F.col("feature_type")).otherwise("Categorical")
    advice = texts.ENCODING_ADVICE
    encoding = F.when(u <= 10, advice["Few levels"]).otherwise(advice["Many levels"])
    for name in texts.NUMERIC_TYPES:
        encoding = F.when(F.col("family") == name, advice[name]).otherwise(encoding)
    ratio = F.try_divide(u, F.col("total_samples"))
    return (table.withColumn("ratio", ratio).withColumn("feature_type", detail).withColumn("family", family)
            .withColumn("encoding", encoding).withColumn("low_cardinality", F.col("ratio") < low_ratio)
            .select("feature", "unique_values", "total_samples", "ratio", "feature_type", "family", "encoding",
                    "low_cardinality").orderBy("ratio", "feature"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 3) -> DataFrame:
    """The most frequent values per column; equal counts in value order."""
    return most_frequent(all_value_counts(df, columns), k)


def most_frequent(counts: DataFrame, k: int = 3) -> DataFrame:
    """A8 for ``(feature, value, n)``."""
    order = Window.partitionBy("feature").orderBy(F.desc("n"), "value")
    return counts.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)


def class_balance(df: DataFrame, label: str, bands: tuple[float, float] = (3, 10)) -> DataFrame:
    """A10, M1: class counts, ratio (the positive-class weight), severity and advice; raises on an absent class."""
    return balance_advice(df.agg(F.count_if(F.col(label) == 0).alias("n_negative"), F.count_if(F.col(label) == 1).alias("n_positive"),
                                 F.count("*").alias("n")), label, bands)


def balance_advice(counted: DataFrame, label: str, bands: tuple[float, float] = (3, 10)) -> DataFrame:
    """A10 for one row ``(n_negative, n_positive, n)``."""
    neg, pos = F.col("n_negative"), F.col("n_positive")
    checked = F.when((neg == 0) | (pos == 0), F.raise_error(F.lit(f"{label} has only one class"))).otherwise(neg / pos)
    ratio = F.col("imbalance_ratio")

    def banded(values):
        return F.when(ratio < bands[0], values[0]).when(ratio < bands[1], values[1]).otherwise(values[2])

    return (counted.withColumn("imbalance_ratio", checked).withColumn("minority_pct", pos * 100.0 / F.col("n"))
            .withColumn("severity", banded(texts.SEVERITY))
            .withColumn("recommendation", banded(texts.BALANCE_ADVICE)).drop("n"))


def moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, median, sample deviation, bias-adjusted skewness and excess kurtosis; g1, g2 population."""
    medians = quantile_rows(df, columns, [0.5])
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
                 F.skewness(c).alias(f"g{i}"), F.kurtosis(c).alias(f"k{i}")]
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"n{i}").alias("n"), F.col(f"m{i}").alias("mean"),
                     F.lit(medians[c][0.5]).cast("double").alias("median"), F.col(f"s{i}").alias("std"),
                     F.col(f"g{i}").alias("g1"), F.col(f"k{i}").alias("g2")) for i, c in enumerate(columns)]
    return with_adjusted(unfold(df.agg(*aggs), rows))


def with_adjusted(table: DataFrame) -> DataFrame:
    """Adds skewness and kurtosis without bias to ``n, g1, g2``."""
    n = F.col("n").cast("double")
    return table.withColumn("skewness", X.adjusted_skewness(n, F.col("g1"))).withColumn("kurtosis", X.adjusted_kurtosis(n, F.col("g2")))


class Counted:
    """The values of all columns with their counts, written once; what the profiles need comes from it.

    ``table``: ``feature, value`` as text, ``number`` of a numeric column, ``n``, and ``first_seen``, the least key of a text. One row for each
    distinct value of each column, counted where the rows are read before anything moves.
    """

    def __init__(self, df: DataFrame, columns: Sequence[str], key: str):
        self.columns, self.spark = list(columns), df.sparkSession
        self.numeric = {c: is_numeric(df, c) for c in columns}
        self.types = {c: df.schema[c].dataType.simpleString() for c in columns}
        whole = {c: isinstance(df.schema[c].dataType, T.IntegralType) for c in columns}
        entries = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("long" if whole[c] else "double" if self.numeric[c] else "string").cast("string").alias("value"),
                            (F.col(c) if self.numeric[c] else F.lit(None)).cast("double").alias("number"),
                            F.when(F.lit(not self.numeric[c]), F.col(key)).alias("seen")) for c in columns]
        rows = df.select(F.inline(F.array(*entries))).filter(F.col("value").isNotNull())
        self.table = stage(rows.groupBy("feature", "value", "number").agg(F.count("*").alias("n"), F.min("seen").alias("first_seen")), "counted")
        found = self.table.groupBy("feature").agg(F.sum("n").alias("known"), F.count("*").alias("distinct"), F.sum(F.col("n") * F.col("number")).alias("sum"))
        self.sizes = {r["feature"]: r.asDict() for r in found.collect()}
        self.total = df.count()

    def size(self, column: str, what: str) -> float:
        return self.sizes.get(column, {}).get(what) or 0

    def _frame(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def missing(self, columns: Sequence[str]) -> DataFrame:
        rows = [(c, self.total - self.size(c, "known"), self.total, self.types[c]) for c in columns]
        return missing_advice(self._frame(rows, "feature string, missing_count long, total long, data_type string"))

    def cardinality(self, columns: Sequence[str]) -> DataFrame:
        rows = [(c, self.numeric[c], self.total, self.size(c, "distinct")) for c in columns]
        return cardinality_advice(self._frame(rows, "feature string, numeric boolean, total_samples long, unique_values long"))

    def top_values(self, columns: Sequence[str], k: int = 3) -> DataFrame:
        return most_frequent(self.table.filter(F.col("feature").isin(*columns)).select("feature", "value", "n"), k)

    def class_balance(self, label: str) -> DataFrame:
        of = self.table.filter(F.col("feature") == label)
        neg, pos = (F.coalesce(F.sum(F.when(F.col("number") == v, F.col("n"))), F.lit(0)) for v in (0, 1))
        return balance_advice(of.agg(neg.alias("n_negative"), pos.alias("n_positive"), F.lit(self.total).cast("long").alias("n")), label)

    def moments(self, columns: Sequence[str]) -> DataFrame:
        """A12, from sums of powers around the mean and the middle of running counts."""
        known = [c for c in columns if self.size(c, "known")]
        schema = "feature string, n long, mean double, median double, std double, g1 double, g2 double"
        if not known:
            return with_adjusted(self._frame([], schema))
        values = self.table.filter(F.col("feature").isin(*known)).select("feature", F.col("number").alias("value"), "n")
        mean = F.element_at(F.create_map(*[x for c in known for x in (F.lit(c), F.lit(self.size(c, "sum") / self.size(c, "known")))]), F.col("feature"))
        size = F.element_at(F.create_map(*[x for c in known for x in (F.lit(c), F.lit(self.size(c, "known")).cast("long"))]), F.col("feature"))
        upto = running(values, ["value"], {"upto": "n"}, by=["feature"]).withColumn("size", size)
        gap = F.col("value") - mean

        def at(rank: Column) -> Column:
            return F.max(F.when((F.col("upto") - F.col("n") <= rank) & (F.col("upto") > rank), F.col("value")))

        low, high = F.floor((F.col("size") - 1) / 2), F.ceil((F.col("size") - 1) / 2)
        sums = upto.groupBy("feature").agg(F.max("size").alias("n"), F.max(mean).alias("mean"), ((at(low) + at(high)) / 2).alias("median"),
                                           *[F.sum(F.col("n") * F.pow(gap, F.lit(p))).alias(f"p{p}") for p in (2, 3, 4)])
        m2, n = F.col("p2") / F.col("n"), F.col("n")
        out = sums.select("feature", "n", "mean", "median", F.when(n > 1, F.sqrt(F.col("p2") / (n - 1))).alias("std"),
                          F.try_divide(F.col("p3") / n, F.pow(m2, F.lit(1.5))).alias("g1"), (F.try_divide(F.col("p4") / n, m2 * m2) - 3).alias("g2"))
        return with_adjusted(out)

    def coded(self, df: DataFrame, columns: Sequence[str]) -> DataFrame:
        """``df`` with text columns as codes by first appearance; NULL is -1."""
        texts_of = [c for c in columns if not self.numeric[c]]
        codes = ranked(self.table.filter(F.col("feature").isin(*texts_of)).select("feature", "value", "first_seen"), ["first_seen"], by=["feature"], name="code")
        return with_codes(df, texts_of, stage(codes.select("feature", F.col("value").alias("level"), (F.col("code") - 1).alias("code")), "codes"))


def label_codes(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """The code of every level by first appearance along ``order``: ``(feature, level, code)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("level")) for c in columns])
    first = (df.select(order, F.inline(pairs)).filter(F.col("level").isNotNull())
             .groupBy("feature", "level").agg(F.min(order).alias("first_seen")))
    return (ranked(first, ["first_seen"], by=["feature"], name="code")
            .select("feature", "level", (F.col("code") - 1).alias("code")))


def factorize(df: DataFrame, columns: Sequence[str], order: str) -> DataFrame:
    """Replace text columns by their codes; NULL becomes -1."""
    return with_codes(df, columns, stage(label_codes(df, columns, order), "codes"))


def with_codes(df: DataFrame, columns: Sequence[str], codes: DataFrame) -> DataFrame:
    for c in columns:
        lookup = codes.filter(F.col("feature") == c).select(F.col("level").alias(f"_l_{c}"), F.col("code").alias(f"_c_{c}"))
        df = (df.join(lookup, F.col(c).cast("string") == F.col(f"_l_{c}"), "left")
              .withColumn(c, F.coalesce(F.col(f"_c_{c}"), F.lit(-1))).drop(f"_l_{c}", f"_c_{c}"))
    return df


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The full Pearson matrix, pairwise complete, as ``(feature_1, feature_2, i, j, r)``.

    One pass for means and counts, one for sums of centred products; only pairs with a nullable column need
    sums over their own common rows. Plain sums stay in generated code where dozens of corr() would not. The
    k * k results are put together on the driver.
    """
    k = len(columns)
    first = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
                   *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    partial = [first[f"n{i}"] < first["n"] for i in range(k)]
    centred = df.select(*[(F.col(c).cast("double") - F.lit(first[f"m{i}"] or 0.0)).alias(f"d{i}") for i, c in enumerate(columns)])
    d = [F.col(f"d{i}") for i in range(k)]
    sums: dict[str, Column] = {}
    for i in range(k):
        sums[f"s{i}"], sums[f"q{i}"] = d[i], d[i] * d[i]
        for j in range(k):
            if i < j:
                sums[f"x{i}_{j}"] = d[i] * d[j]
            if i != j and partial[j]:
                seen = d[j].isNotNull()
                sums[f"s{i}_{j}"], sums[f"q{i}_{j}"] = F.when(seen, d[i]), F.when(seen, d[i] * d[i])
                sums[f"n{i}_{j}"] = (d[i].isNotNull() & seen).cast("double")
    added = centred.agg(*[F.sum(value).alias(name) for name, value in sums.items()]).first().asDict()

    def own(i: int, j: int, kind: str) -> float | None:
        """Sum of column i (or of its square) over the rows that also have column j."""
        return added[f"{kind}{i}_{j}" if i != j and partial[j] else f"{kind}{i}"]

    def correlation(i: int, j: int) -> float | None:
        n = added[f"n{i}_{j}"] if i != j and partial[j] else float(first[f"n{i}"])
        cross = added[f"q{i}" if i == j else f"x{i}_{j}"]
        if not n or cross is None:
            return None
        sx, sy = own(i, j, "s"), own(j, i, "s")
        spread = (own(i, j, "q") - sx * sx / n) * (own(j, i, "q") - sy * sy / n)
        return (cross - sx * sy / n) / math.sqrt(spread) if spread > 0 else None

    rows = [(columns[i], columns[j], i, j, correlation(min(i, j), max(i, j))) for i in range(k) for j in range(k)]
    return df.sparkSession.createDataFrame(rows, "feature_1 string, feature_2 string, i int, j int, r double")


def target_correlations(matrix: DataFrame, target: str) -> DataFrame:
    """Correlation of every feature with the target, with labels, largest first."""
    r = F.col("r")
    return (matrix.filter((F.col("feature_2") == target) & (F.col("feature_1") != target))
            .select(F.col("feature_1").alias("feature"), "r", X.strength(r).alias("strength"),
                    X.direction(r).alias("direction")).orderBy(F.desc("r"), "feature"))


def high_pairs(matrix: DataFrame, threshold: float = 0.8) -> DataFrame:
    """A16."""
    return (matrix.filter((F.col("i") < F.col("j")) & (F.abs("r") > threshold))
            .select("feature_1", "feature_2", "r"))


def means_and_covariances(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column means (``feature_2`` NULL) and pairwise sample covariances."""
    aggs = [F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)]
    aggs += [F.covar_samp(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c_{i}_{j}")
             for i, a in enumerate(columns) for j, b in enumerate(columns) if i <= j]

    def row(a, b, kind, value):
        second = F.lit(b).cast("string").alias("feature_2")
        return F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("feature_1"), second, value.alias("value"))

    rows = [row(c, None, "mean", F.col(f"m_{i}")) for i, c in enumerate(columns)]
    rows += [row(a, b, "covariance", F.col(f"c_{min(i, j)}_{max(i, j)}"))
             for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return unfold(df.agg(*aggs), rows)


def missing_patterns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(pattern, n)``."""
    return df.groupBy(X.missing_pattern(list(columns)).alias("pattern")).agg(F.count("*").alias("n"))


def group_means(df: DataFrame, group: Column, columns: Sequence[str]) -> DataFrame:
    """Counts and means by level or by missing flag."""
    return df.groupBy(group.alias("level")).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns])
