"""Published values and closed forms."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.functions import expressions as X
from cohortry.functions import special
from cohortry.operators import contingency, missingness, normality, profile
from cohortry.plans import reports


@pytest.mark.parametrize("dof,x", [(1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (5, 11.070498), (10, 18.307038), (30, 43.772972)])
def test_chi_square_tail(dof, x):
    assert special.chi_square_tail(x, dof) == pytest.approx(0.05, abs=1e-7)


def test_tails_at_the_ends():
    assert special.chi_square_tail(0.0, 3) == 1.0 and special.chi_square_tail(2000.0, 5) < 1e-300
    assert math.isnan(special.chi_square_tail(1.0, 0))
    assert special.student_tail(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert special.student_tail(0.0, 10) == pytest.approx(1.0) and special.student_tail(math.inf, 5) == 0.0
    assert special.student_tail(1.959964, 1e8) == pytest.approx(0.05, abs=1e-6)


def test_normal_quantile(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.025, 0.3, 0.5, 0.7, 0.975, 1 - 1e-9]
    df = special.with_normal_quantile(spark.createDataFrame([(v,) for v in p], "p double"), F.col("p"), "z")
    for r in df.collect():
        assert r["z"] == pytest.approx(statistics.NormalDist().inv_cdf(r["p"]), rel=1e-12, abs=1e-14)


@pytest.mark.parametrize("skew,kurt,p", [(-0.1370593225984694, -0.9910102432016696, 4.7895697274981233e-244),
                                         (1.5722838665030459, 1.6804785404038278, 2.662310941715711e-289)])
def test_k_squared_published(spark, skew, kurt, p):
    n = 5110
    g1 = skew * (n - 2) / math.sqrt(n * (n - 1))
    g2 = (kurt * (n - 2) * (n - 3) / (n - 1) - 6) / (n + 1)
    df = X.with_k_squared(spark.createDataFrame([(n, g1, g2)], "n long, g1 double, g2 double"))
    assert math.exp(-df.first()["statistic"] / 2) == pytest.approx(p, rel=1e-11)


def test_chi_square_with_empty_cells(spark):
    rows = [("a", 1)] * 30 + [("b", 0)] * 20 + [("b", 1)] * 10 + [("c", 0)] * 7
    row = contingency.chi_square(contingency.cell_counts(spark.createDataFrame(rows, "g string, y int"), ["g"], "y")).first()
    table = np.array([[0, 30], [20, 10], [7, 0]], dtype=float)
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    assert row["chi2"] == pytest.approx(((table - e) ** 2 / e).sum()) and row["dof"] == 2
    assert row["cramers_v"] == pytest.approx(math.sqrt(row["chi2"] / table.sum())) and row["min_expected"] == pytest.approx(e.min())


def test_chi_square_two_by_two(spark):
    rows = [("a", 1)] * 12 + [("a", 0)] * 5 + [("b", 1)] * 3 + [("b", 0)] * 9
    df = spark.createDataFrame(rows, "g string, y int")
    row = contingency.chi_square(contingency.cell_counts(df, ["g"], "y")).first()
    table = np.array([[5, 12], [9, 3]], dtype=float)
    e = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    want = ((np.maximum(np.abs(table - e) - 0.5, 0)) ** 2 / e).sum()
    assert row["chi2"] == pytest.approx(want)
    pair = contingency.pairwise_chi_square(df, "g", "y", "a").first()
    assert pair["chi2"] == pytest.approx(want) and pair["p_value"] == pytest.approx(row["p_value"])
    single = contingency.chi_square(contingency.cell_counts(df.filter("y = 1"), ["g"], "y")).first()
    assert (single["chi2"], single["dof"], single["p_value"]) == (0.0, 0, 1.0)


def test_pattern_test_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    y = np.where(x > 0.5, np.nan, x + rng.normal(size=400))
    df = spark.createDataFrame([(float(a), None if np.isnan(b) else float(b)) for a, b in zip(x, y)], "x double, y double")
    row = missingness.pattern_test(df, ["x", "y"]).first()
    gone = np.isnan(y)
    want = gone.sum() * (x[gone].mean() - x.mean()) ** 2 / (x.var(ddof=1) + 1e-6)
    assert row["chi2"] == pytest.approx(want, rel=1e-9) and (row["dof"], row["n_patterns"]) == (1, 2)
    assert row["is_mcar"] is False


def test_pattern_test_special_cases(spark):
    full = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "x double, y double")
    assert tuple(missingness.pattern_test(full, ["x", "y"]).first()) == (0.0, 0, 1, 1.0, True)
    one = spark.createDataFrame([(1.0, None), (2.0, None)], "x double, y double")
    assert tuple(missingness.pattern_test(one, ["x", "y"]).first()) == (None, 0, 1, None, None)
    wide = spark.createDataFrame([(1.0, None, "t", 3)], "x double, y double, s string, z int")
    assert missingness.pattern_columns(wide) == ["y", "x", "z"]


def test_t_test_matches_correlation(spark, line):
    """With a 0/1 flag, the pooled t-test and the t of the point-biserial correlation are the same number."""
    a = {r["feature"]: r["t"] for r in missingness.point_biserial(line, "rate", ["qty", "price"]).collect()}
    b = {r["feature"]: r["t"] for r in missingness.mean_difference(line, "rate", ["qty", "price"]).collect()}
    assert a == pytest.approx(b, rel=1e-9)


def test_inflation_of_two_columns(spark, line):
    r = profile.correlations(line, ["price", "score"]).filter("i < j").first()["r"]
    for row in normality.variance_inflation(line, ["price", "score"]).collect():
        assert row["vif"] == pytest.approx(1 / (1 - r * r))


def test_missing_odds_sign(spark, line):
    found = {r["feature"]: r["odds_ratio"] for r in missingness.missing_odds(line, "rate", ["qty", "urgent"]).collect()}
    assert found["qty"] > 1.01 and set(found) == {"intercept", "qty", "urgent"}


def test_percent_text_like_printf(spark):
    values = [0.9935, 0.9355, 0.0005, 0.05, 0.12345, 0.99999, 1.0, 0.0, *[i / 1000 + 0.0005 for i in range(0, 1000, 7)]]
    df = spark.createDataFrame([(v,) for v in values], "p double").select("p", X.percent_text(F.col("p")).alias("t"))
    assert [r["t"] for r in df.collect()] == [f"{v * 100:.1f}%" for v in values]


def test_codes_by_first_appearance(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (5, "c")], "id int, s string")
    assert [r["s"] for r in profile.factorize(df, ["s"], "id").orderBy("id").collect()] == [0, -1, 1, 0, 2]


def test_reports(spark, line):
    tables = reports.missingness_tables(line, "rate", "segment", "outcome", "BUILDING", ["qty", "price"], ["segment", "rflag"])
    found = reports.missingness_findings(tables, "rate", "segment", "BUILDING").collect()
    assert {"missing rate", "segment and outcome", "missing rate and category"} <= {r["finding"] for r in found}
    every = reports.profile_tables(line, "outcome", "rid")
    assert {r["feature"] for r in every["distribution"].collect()} == {"qty", "price", "score"}
    advice = {(r["finding"], r["subject"]): r["verdict"] for r in reports.profile_findings(every).collect()}
    assert advice[("encoding", "ptype")] == "One-Hot Encoding (drop='first')"
    assert advice[("missing values", "rate")].startswith("KNN")


def test_counted_values_give_the_profiles(spark, line):
    columns = ["qty", "price", "rate", "closed", "rflag", "ptype", "outcome"]
    df = line.withColumn("ptype", F.when(F.col("qty") > 3, F.col("ptype"))).select("rid", *columns)
    counted = profile.Counted(df, columns, "rid")

    def rows(table):
        return [tuple(r) for r in table.collect()]

    assert rows(counted.missing(columns)) == rows(profile.missing_profile(df, columns))
    assert rows(counted.cardinality(columns)) == rows(profile.cardinality(df, columns))
    assert sorted(rows(counted.top_values(columns))) == sorted(rows(profile.top_values(df, columns)))
    assert rows(counted.class_balance("outcome")) == rows(profile.class_balance(df, "outcome"))
    for a, b in zip(sorted(rows(counted.moments(["qty", "price", "rate"]))), sorted(rows(profile.moments(df, ["qty", "price", "rate"]))), strict=True):
        assert a[0] == b[0] and a[1:] == pytest.approx(b[1:], rel=1e-9, abs=1e-9)
    one, other = (sorted(rows(t.select("rid", "rflag", "ptype"))) for t in (counted.coded(df, columns), profile.factorize(df, ["rflag", "ptype"], "rid")))
    assert one == other


def test_text_of_a_scored_record(spark):
    from cohortry.plans import scoring
    df = scoring.with_bands(spark.createDataFrame([(0.452,), (0.9,)], "probability double"))
    texts = [r["t"] for r in df.select(scoring.text_of(F.col("risk_level"), F.col("risk_percentage"), F.col("alert")).alias("t")).collect()]
    assert texts[0] == "Stroke Risk: 45.2% (MODERATE)" and texts[1].startswith("Stroke Risk: 90.0% (CRITICAL)\nCRITICAL ALERT")


def test_missing_odds_in_few_tasks(spark):
    """Equal rows are one with a weight, so the steps of the fit don't have the partitions of the table; rows lacking an input are counted."""
    one = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 50 == 3, None).otherwise(F.col("id") % 3).alias("b"),
                                  F.when(F.pmod(F.xxhash64("id"), F.lit(10)) < F.col("id") % 7, None).otherwise(1.0).alias("t"))
    tables, tasks = [], []
    for df in (one, one.crossJoin(spark.range(4)).drop("id").repartition(150)):
        spark.sparkContext.setJobGroup(f"odds{len(tables)}", "")
        try:
            tables.append({r["feature"]: r.asDict() for r in missingness.missing_odds(df, "t", ["a", "b"]).collect()})
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup(f"odds{len(tables) - 1}") for s in tracker.getJobInfo(j).stageIds}
        tasks.append(sum(info.numTasks for s in stages if (info := tracker.getStageInfo(s))))
    for name, row in tables[0].items():
        assert tables[1][name]["coefficient"] == pytest.approx(row["coefficient"], rel=1e-5, abs=1e-7)
        assert (row["n_used"], row["n_lacking"]) == (588, 12) and (tables[1][name]["n_used"], tables[1][name]["n_lacking"]) == (2352, 48)
    assert tables[0]["a"]["coefficient"] > 0.1 and tasks[1] < 5 * 150
