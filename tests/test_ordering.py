"""Running totals, ranks and quantiles agree with plain windows when the table is cut into many ranges."""

import statistics
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortry.operators import metrics, normality, ordering, quantiles, splitting

TIGHT = {"rows_per_range": 100}


@pytest.mark.parametrize("descending", [False, True])
def test_running_equals_window(spark, line, descending):
    df = line.select("rid", "rflag", "price", "outcome")
    cut = ordering.running(df, ["price", "rid"], {"c": "outcome"}, ["rflag"], descending, {"nxt": "outcome"}, **TIGHT)
    side = [F.col(c).desc() if descending else F.col(c).asc() for c in ("price", "rid")]
    w = Window.partitionBy("rflag").orderBy(*side)
    plain = df.withColumn("c", F.sum("outcome").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("nxt", F.lead("outcome").over(w))
    assert cut.columns == plain.columns
    assert cut.exceptAll(plain).isEmpty() and plain.exceptAll(cut).isEmpty()


def test_many_ranges_are_used(spark, line):
    rows = line.count()
    sizes = [r["count"] for r in ordering.with_ranges(line, ["price", "rid"], rows, 100).groupBy("_range").count().collect()]
    assert rows / 200 < len(sizes) <= -(-rows // 100) and max(sizes) < 600


def test_more_ranges_than_a_thousand(spark):
    df = spark.range(3000).select("id", (F.col("id") * 7919 % 3000).alias("x"))
    out = ordering.ranked(df, ["x"], rows_per_range=2)
    assert out.filter(F.col("rank") != F.col("x") + 1).isEmpty() and out.count() == 3000


def test_one_value_in_most_rows(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("x"))
    ranks = ordering.ranked(df, ["x", "id"], **TIGHT).agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()
    assert tuple(ranks) == (1, 3000, 3000)


@pytest.mark.parametrize("options", [{}, {"accuracy": 20}, {"accuracy": 100_000}])
def test_quantiles_are_exact(spark, line, options):
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    found = quantiles.quantile_rows(line, ["qty", "price", "rate"], probs, **options)
    data = line.select("qty", "price", "rate").toPandas()
    for c in data:
        want = np.quantile(data[c].dropna(), probs)
        assert [found[c][p] for p in probs] == pytest.approx(list(want), rel=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.quantile_rows(df, ["x"], [0.5]) == {"x": {0.5: None}}
    assert quantiles._from_all_values(spark.range(5), "id", 1.5) == 1.5


def test_curves_do_not_depend_on_ranges(spark, line):
    a = metrics.roc_curve(line, "outcome", "score")
    b = metrics.roc_curve(line, "outcome", "score", **TIGHT)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    one, two = (metrics.ranking_quality(line, "outcome", "score", **o).first() for o in ({}, TIGHT))
    assert tuple(one) == pytest.approx(tuple(two), rel=1e-12)


def test_auc_equals_spark_evaluator(spark, line):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    scored = line.select(F.col("outcome").cast("double").alias("label"), F.col("score").alias("rawPrediction"))
    want = BinaryClassificationEvaluator(numBins=0).evaluate(scored)
    assert metrics.ranking_quality(line, "outcome", "score").first()["roc_auc"] == pytest.approx(want, abs=1e-12)


def test_split_is_exact_disjoint_and_stable(spark, line):
    flagged = splitting.stratified_split(line, "rid", "outcome")
    sizes = {(r["outcome"], r["is_test"]): r["count"] for r in flagged.groupBy("outcome", "is_test").count().collect()}
    for y in (0, 1):
        n = sizes[(y, True)] + sizes[(y, False)]
        assert sizes[(y, True)] == round(0.2 * n)
    again = splitting.stratified_split(line.repartition(3, "price"), "rid", "outcome", digits=1)
    assert flagged.select("rid", "is_test").exceptAll(again.select("rid", "is_test")).isEmpty()
    assert flagged.count() == line.count() and flagged.drop("is_test").exceptAll(line).isEmpty()


def test_folds_are_even(spark, line):
    folds = splitting.stratified_folds(line, "rid", "outcome", 5)
    sizes = folds.groupBy("outcome", "fold").count().groupBy("outcome").agg(F.max("count") - F.min("count"), F.count("*")).collect()
    assert all(r[1] <= 1 and r[2] == 5 for r in sizes)
    again = splitting.stratified_folds(line.repartition(5), "rid", "outcome", 5, digits=1)
    assert folds.select("rid", "fold").exceptAll(again.select("rid", "fold")).isEmpty()


def test_small_columns(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])], "id int, x double")
    row = normality.w_test(df, ["x"]).first()
    assert row["statistic"] == pytest.approx(0.789, abs=5e-4) and row["p_value"] == pytest.approx(0.0067, abs=3e-4)
    three = normality.w_test(df.limit(3).withColumn("x", F.col("id").cast("double")), ["x"]).first()
    assert three["statistic"] == pytest.approx(1.0) and three["p_value"] == pytest.approx(1.0, abs=1e-6)
    assert normality.w_test(df.limit(2), ["x"]).isEmpty() and normality.w_test(df, []).isEmpty()
    large = spark.range(20000).select((F.col("id") % 997).cast("double").alias("x"))
    assert normality.w_test(large, ["x"]).first()["n"] == 20000


def test_shared_folder(spark, monkeypatch):
    from cohortry import session
    assert session.shared_dir(spark)

    class Conf:
        @staticmethod
        def get(key, default=None):
            return "hdfs://shared/run/" if key == "spark.checkpoint.dir" else default

    class Fake:
        conf = Conf
    assert session.shared_dir(Fake) == "hdfs://shared/run"

    class Bare:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Bare)


def test_staged_tables_are_released(spark, tmp_path):
    from cohortry import session
    kept, session._staged[:] = list(session._staged), []
    df = session.stage(spark.range(10), "gone")
    path = session._staged[0]
    assert df.count() == 10 and session.release(spark) == 1
    assert not Path(path.replace("file:", "")).exists()
    session._staged[:] = kept



def test_score_sums_of_crowded_values(spark):
    """Sums over equal values in closed form equal the sums rank by rank."""
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(2500, 3.0), np.full(70, -1.0), np.full(400, 9.0), rng.normal(size=300).round(1)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    sizes = normality._sizes(df, ["x"])
    got = normality.score_sums(df, ["x"], sizes, 0.375, 0.25).groupBy("value").agg(F.sum("copies").alias("n"), F.sum("m").alias("m"), F.sum("mm").alias("mm"))
    quantile = statistics.NormalDist().inv_cdf
    m = np.array([quantile((i - 0.375) / (len(values) + 0.25)) for i in range(1, len(values) + 1)])
    ordered = np.sort(values)
    for r in got.collect():
        own = m[ordered == r["value"]]
        assert r["n"] == len(own) and r["m"] == pytest.approx(own.sum(), abs=1e-9) and r["mm"] == pytest.approx((own ** 2).sum(), rel=1e-11)


def test_one_value_in_a_thousand_million_rows(spark, monkeypatch):
    """Counts stand for rows: a value is one row, whatever the number of its copies."""
    counts = spark.createDataFrame([("x", 1.0, 10 ** 9), ("x", 2.0, 10 ** 8), ("x", 3.0, 7)], "feature string, value double, n long")
    monkeypatch.setattr(normality, "value_counts", lambda *_: counts)
    total = 10 ** 9 + 10 ** 8 + 7
    mean = (10 ** 9 + 2 * 10 ** 8 + 21) / total
    monkeypatch.setattr(normality, "_sizes", lambda *_: {"x": {"n": total, "mean": mean}})
    w = normality.w_test(counts, ["x"]).first()
    fit = normality.normal_fit(counts, ["x"]).first()
    assert w["n"] == fit["n"] == total and 0 < w["statistic"] < 1 and 0 < fit["r"] < 1
    assert fit["r"] ** 2 == pytest.approx(w["statistic"], rel=1e-3) and fit["intercept"] == pytest.approx(mean, abs=1e-6)
