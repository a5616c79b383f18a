"""Leakage, neighbours and encoding of the feature preparation."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import neighbours, rules
from cohortry.plans import catalog, features
from cohortry.session import stage

NUMERIC, CATEGORICAL = ["age", "avg_glucose_level", "bmi"], ["gender", "hypertension", "work_type", "smoking_status"]


@pytest.fixture(scope="module")
def patients(spark):
    rng = np.random.default_rng(42)
    rows = []
    for i in range(500):
        bmi = None if rng.random() < 0.1 else float(rng.uniform(15, 50))
        rows.append((i, float(rng.uniform(1, 80)), float(rng.uniform(50, 300)), bmi, str(rng.choice(["Male", "Female"])),
                     int(rng.random() < 0.1), str(rng.choice(rules.WORK)), str(rng.choice(rules.SMOKING)), int(rng.random() < 0.05), i % 5 == 0))
    return spark.createDataFrame(rows, "rid int, age double, avg_glucose_level double, bmi double, gender string, hypertension int, "
                                       "work_type string, smoking_status string, stroke int, is_test boolean").cache()


def fit(df):
    return features.fit(df.filter("not is_test"), "rid", NUMERIC, CATEGORICAL, "bmi")


def as_dict(df, keep="rid"):
    return {r[keep]: tuple(r) for r in df.collect()}


def test_extreme_test_rows_change_nothing(spark, patients):
    extreme = patients.limit(2).withColumns({"rid": F.col("rid") + 1000, "age": F.lit(999.0), "avg_glucose_level": F.lit(9999.0),
                                             "bmi": F.lit(999.0), "is_test": F.lit(True), "work_type": F.lit("Freelancer")})
    one, two = fit(patients), fit(patients.unionByName(extreme))
    assert (one.centre, one.scale, one.levels) == (two.centre, two.scale, two.levels)
    train = patients.filter("not is_test")
    assert as_dict(features.apply(one, train)) == as_dict(features.apply(two, train))
    out = features.apply(one, extreme)
    rules.verify_complete(out, one.names)
    assert all(r[f"categorical__work_type_{w}"] == 0 for r in out.collect() for w in sorted(rules.WORK)[1:])


def test_names_and_completeness(spark, patients):
    state = fit(patients)
    out = features.apply(state, patients, ["is_test"])
    assert out.columns == ["rid", "is_test", *state.names]
    assert state.names[:4] == ["numerical__age", "numerical__avg_glucose_level", "numerical__bmi", "numerical__bmi_missing"]
    assert state.levels["smoking_status"][0] == "Unknown"
    assert len(state.names) == 4 + 1 + 1 + 4 + 3
    assert out.count() == 500 and rules.verify_complete(out, state.names)


def test_scaler_from_training_rows(spark, patients):
    state = fit(patients)
    train = patients.filter("not is_test").toPandas()
    for c in NUMERIC:
        q = np.quantile(train[c].dropna(), [0.25, 0.5, 0.75])
        assert state.centre[c] == pytest.approx(q[1]) and state.scale[c] == pytest.approx(q[2] - q[0])
    assert state.scale["bmi_missing"] == 1.0


def brute(df, state, row, k=10):
    train = df[~df.is_test & df.bmi.notna()]
    d2 = sum(((row[c] - train[c]) / state.scale[c]) ** 2 for c in ("age", "avg_glucose_level")) + 1
    near = train.assign(d2=d2).sort_values(["d2", "rid"]).head(k)
    w = 1 / np.sqrt(near.d2)
    return ((near.bmi * w).sum() / w.sum() - state.centre["bmi"]) / state.scale["bmi"]


def test_imputed_values(spark, patients):
    state, data = fit(patients), patients.toPandas()
    out = {r["rid"]: r["numerical__bmi"] for r in features.apply(state, patients).collect()}
    missing = data[data.bmi.isna()]
    assert len(missing) > 20
    for _, row in missing.iterrows():
        assert out[row.rid] == pytest.approx(brute(data, state, row), rel=1e-9)


def test_donors_only_from_training_rows(spark, patients):
    state = fit(patients)
    shifted = patients.withColumn("bmi", F.when(F.col("is_test"), F.col("bmi") * 50).otherwise(F.col("bmi")))
    lacking = F.col("bmi").isNull()
    assert as_dict(features.apply(state, patients.filter(lacking))) == as_dict(features.apply(fit(shifted), patients.filter(lacking)))


def test_same_result_on_any_partitioning(spark, patients):
    a = features.apply(fit(patients), patients)
    other = patients.repartition(7, "age")
    b = features.apply(fit(other), other)
    left, right = as_dict(a), as_dict(b)
    assert left.keys() == right.keys()
    for key, row in left.items():
        assert row == pytest.approx(right[key], rel=1e-12)


def test_state_survives_saving(spark, patients, tmp_path):
    state = fit(patients)
    state.save(str(tmp_path / "state"), spark)
    back = features.FeatureState.load(str(tmp_path / "state"), spark)
    assert back.names == state.names
    assert as_dict(features.apply(back, patients)) == as_dict(features.apply(state, patients))


@pytest.mark.parametrize("shape", ["even", "crowded", "copies", "line", "sparse"])
def test_cells_find_the_same_neighbours(spark, shape, monkeypatch):
    for name, value in (("BLOCK_DONORS", 40), ("TOP_DONORS", 150), ("BATCH", 4), ("CROWD", 30)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(3)
    n = 1500
    x, y = rng.uniform(size=n), rng.uniform(size=n)
    if shape == "crowded":
        x[: n // 3], y[: n // 3] = 0.5 + rng.normal(scale=1e-4, size=n // 3), 0.5 + rng.normal(scale=1e-4, size=n // 3)
        x[-5:] *= 1e5
    if shape == "copies":
        x, y = np.round(x * 6), np.round(y * 6)
        x[: n // 3], y[: n // 3] = 2, 2
    if shape == "line":
        y[:] = 1.0
    if shape == "sparse":  # blocks with fewer donors than neighbours wanted
        monkeypatch.setattr(neighbours, "BLOCK_DONORS", 4)
    has = rng.random(n) > 0.2
    rows = [(i, float(a), float(b), float(i % 17) if h else None) for i, (a, b, h) in enumerate(zip(x, y, has))]
    df = spark.createDataFrame(rows, "id int, x double, y double, v double")
    found = neighbours.nearest(df.filter("v is null"), df.filter("v is not null"), ["x", "y"], "id", "v", 10)
    got = {}
    for r in found.collect():
        got.setdefault((r["x"], r["y"]), []).append((r["rank"], r["d2"], r["value"]))
    d_ids = np.flatnonzero(has)
    assert got.keys() == {(a, b) for _, a, b, v in rows if v is None}
    for (a, b), mine in got.items():
        d2 = (a - x[d_ids]) ** 2 + (b - y[d_ids]) ** 2
        order = np.lexsort((d_ids, d2))[:10]
        want = [(i + 1, d2[j], float(d_ids[j] % 17)) for i, j in enumerate(order)]
        assert sorted(mine) == want


def test_few_blocks_are_visited(spark, monkeypatch):
    """Whatever the number of donors, a receiver visits a few blocks, also where blocks hold fewer donors than are wanted."""
    rng = np.random.default_rng(6)
    rows = [(i, *map(float, rng.normal(size=2)), 1.0) for i in range(20_000)]
    donors = stage(spark.createDataFrame(rows, "id int, x double, y double, v double"), "many")
    receivers = spark.createDataFrame([tuple(map(float, rng.normal(size=2))) for _ in range(300)], "x double, y double")
    for block, most in ((400, 6), (50, 16), (4, 60)):
        monkeypatch.setattr(neighbours, "BLOCK_DONORS", block)
        monkeypatch.setattr(neighbours, "TOP_DONORS", 1000)
        part = neighbours.build(donors, ["x", "y"], "id", "v", 10)
        assert len(part.tops["top"]) == 20 and sum(part.tops["n"]) == 20_000
        counts = [r["count"] for r in neighbours.visits(part, receivers, 10).groupBy("x", "y").count().collect()]
        assert len(counts) == 300 and np.mean(counts) < most


def test_a_batch_reads_only_the_folders_it_visits(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(neighbours, "TOP_DONORS", 500)
    monkeypatch.setattr(neighbours, "BLOCK_DONORS", 50)
    rows = [(i, *map(float, rng.uniform(size=2)), float(i)) for i in range(5000)]
    index = neighbours.DonorIndex(stage(spark.createDataFrame(rows, "id int, x double, y double, v double"), "many"), ["x", "y"], "id", "v")
    index.save(str(tmp_path / "index"), spark)
    back = neighbours.DonorIndex.load(str(tmp_path / "index"), spark)
    assert list(back.parts) == [("x+y", "x+y")]
    batch = spark.createDataFrame([(-1, 0.1, 0.1, None), (-2, 0.11, 0.1, None)], "id int, x double, y double, v double")
    met = neighbours.visits(back.part(["x", "y"], ["x", "y"]), batch)
    read = neighbours._pruned(back.part(["x", "y"], ["x", "y"]), met)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*top", plan)
    tops = {r["top"] for r in met.select("top").distinct().collect()}
    assert len(tops) < 4 and {r["top"] for r in read.select("top").distinct().collect()} == tops
    out = {r["id"]: r["v"] for r in neighbours.fill_missing(batch, "v", ["x", "y"], "id", back).collect()}
    for i, x in ((-1, 0.1), (-2, 0.11)):
        d2 = np.array([(r[1] - x) ** 2 + (r[2] - 0.1) ** 2 for r in rows])
        near = np.argsort(d2, kind="stable")[:10]
        assert out[i] == pytest.approx(np.average(near.astype(float), weights=1 / np.sqrt(d2[near] + 1)), rel=1e-9)


def test_fewer_donors_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, 1.0, 3.0), (3, 0.0, None)], "id int, x double, v double")
    out = {r["id"]: r["v"] for r in neighbours.fill_missing(df, "v", ["x"], "id").collect()}
    w = 1 / np.sqrt(2)
    assert out[3] == pytest.approx((1.0 + 3.0 * w) / (1 + w))
    with pytest.raises(ValueError):
        neighbours.fill_missing(df.filter("v is null"), "v", ["x"], "id")


def test_receivers_and_donors_that_lack_coordinates(spark):
    """Distances over the coordinates both know, scaled up by their share of all (the target and its flag are two more)."""
    rng = np.random.default_rng(4)
    data = rng.normal(size=(120, 3))
    data[rng.random(120) < 0.2, 0] = np.nan
    data[rng.random(120) < 0.2, 1] = np.nan
    data[:40, 2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id int, x double, y double, v double")
    out = {r["id"]: r["v"] for r in neighbours.fill_missing(df, "v", ["x", "y"], "id", k=5).collect()}
    donors = data[40:]
    for i in range(40):
        both = ~np.isnan(data[i, :2]) & ~np.isnan(donors[:, :2])
        gap = np.where(both, data[i, :2] - donors[:, :2], 0.0)
        d2 = ((gap * gap).sum(axis=1) + 1) * 4 / (both.sum(axis=1) + 1)
        if not np.isnan(data[i, :2]).all():  # else all donors are as near as each other
            near = np.argsort(d2, kind="stable")[:5]
            assert out[i] == pytest.approx(np.average(donors[near, 2], weights=1 / np.sqrt(d2[near])), rel=1e-9)
        assert out[i] is not None


def test_large_imputation_makes_its_rows_once(spark):
    """The cohort, a join of four tables, is computed once and not for every pass over it."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        made.add(1)
        return float(v % 50)

    rows = spark.range(400).select(F.col("id").cast("string").alias("rid"), counted("id").alias("qty"), (F.col("id") % 90).cast("double").alias("price"),
                                   F.when(F.col("id") % 8 > 0, (F.col("id") % 9).cast("double")).alias("rate"))
    out = catalog.knn_impute_large(rows).collect()
    assert len(out) == 400 and all(r["rate"] is not None for r in out)
    assert made.value == 400
