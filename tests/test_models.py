"""Boosted trees, attributions, training, scoring and streaming."""

import itertools
import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.cohorts import LINE_CATEGORICAL, LINE_NUMERIC
from cohortry.operators import boosting, explain, fairness, metrics, rules, trees
from cohortry.operators.boosting import BoostParams
from cohortry.plans import evaluation, scoring, training
from cohortry.session import shared_dir, stage
from cohortry.sources import writers
from cohortry.streaming import scoring as streaming

SPEC = training.CohortSpec("rid", "outcome", LINE_NUMERIC, LINE_CATEGORICAL, "rate", rising=("qty", "price"))
QUICK = BoostParams(n_trees=12, max_depth=3, learning_rate=0.3, seed=42)


@pytest.fixture(scope="module")
def trained(spark, line):
    return training.train(line, SPEC, QUICK, threshold=0.5)


@pytest.fixture(scope="module")
def toy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3)).round(2)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 0.5 * x[:, 0] * x[:, 2])))
    y = (rng.random(800) < p).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(x, y))], "id int, a double, b double, c double, y int")
    return stage(df, "toy"), x, y


def test_one_split_by_hand(spark, toy):
    df, x, y = toy
    params = BoostParams(n_trees=1, max_depth=1, learning_rate=1.0, row_share=1.0, column_share=1.0, alpha=0.5, lam=2.0, gamma=0.0, pos_weight=3.0)
    table = boosting.bin_table(df, ["a", "b", "c"], "y", "id")
    tree = boosting.fit(table, params).trees[0]
    w = np.where(y == 1, 3.0, 1.0)
    g, h = w * (0.5 - y), w * 0.25
    t = lambda v: np.sign(v) * max(abs(v) - 0.5, 0)
    best = max(((0.5 * (t(g[m].sum()) ** 2 / (h[m].sum() + 2) + t(g[~m].sum()) ** 2 / (h[~m].sum() + 2) - t(g.sum()) ** 2 / (h.sum() + 2)), f, c)
                for f in range(3) for c in table.cuts[f] for m in [x[:, f] < c] if h[m].sum() >= 3 and h[~m].sum() >= 3))
    assert tree[1].gain == pytest.approx(best[0]) and (tree[1].feature, tree[1].cut) == best[1:]
    left = x[:, tree[1].feature] < tree[1].cut
    assert tree[2].value == pytest.approx(-t(g[left].sum()) / (h[left].sum() + 2)) and tree[2].cover == pytest.approx(h[left].sum())


def test_sampling_does_not_depend_on_partitions(spark, toy):
    df, _, _ = toy
    params = BoostParams(n_trees=3, max_depth=2, row_share=0.6)
    a = boosting.fit(boosting.bin_table(df, ["a", "b", "c"], "y", "id"), params)
    b = boosting.fit(boosting.bin_table(df.repartition(6), ["a", "b", "c"], "y", "id"), params)
    for s, t in zip(a.trees, b.trees):
        assert {i: (n.feature, n.cut) for i, n in s.items()} == {i: (n.feature, n.cut) for i, n in t.items()}
        assert [n.value for n in s.values()] == pytest.approx([n.value for n in t.values()])
    other = boosting.fit(boosting.bin_table(df, ["a", "b", "c"], "y", "id"), params.with_(seed=7))
    assert [n.value for n in a.trees[0].values()] != [n.value for n in other.trees[0].values()]


def same_trees(a, b):
    assert len(a) == len(b)
    for s, t in zip(a, b, strict=True):
        assert {i: (n.feature, n.bin, n.cut) for i, n in s.items()} == {i: (n.feature, n.bin, n.cut) for i, n in t.items()}
        for what in ("value", "gain", "cover"):
            assert [getattr(n, what) for n in s.values()] == pytest.approx([getattr(n, what) for n in t.values()], rel=1e-7, abs=1e-9)


def test_one_task_and_one_job_a_level_give_the_same_trees(spark, toy, monkeypatch):
    df, _, _ = toy
    levels = df.withColumns({f"l{k}": (F.pmod("id", F.lit(5)) == k).cast("double") for k in range(1, 5)})
    names = ["a", "b", "c", "l1", "l2", "l3", "l4"]
    table = boosting.bin_table(levels, names, "y", "id", bundles=[["l1", "l2", "l3", "l4"]])
    fits = [BoostParams(n_trees=7, max_depth=3, monotone={"a": 1}), BoostParams(n_trees=4, max_depth=5, row_share=0.5, seed=3, pos_weight=2.0),
            BoostParams(n_trees=2, max_depth=1, column_share=0.3, min_child_weight=1e9)]
    plain = boosting.fit_many(table, fits)
    assert [len(m.trees) for m in plain] == [7, 4, 2] and all(set(t) == {1} for t in plain[2].trees)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 150)
    monkeypatch.setattr(boosting, "WRITE_EVERY", 3)
    for most in (boosting.DRIVER_BYTES, 0):  # sums added on the driver, or where Spark brings them together
        monkeypatch.setattr(boosting, "DRIVER_BYTES", most)
        for one, other in zip(plain, boosting.fit_many(table, fits), strict=True):
            same_trees(one.trees, other.trees)


def test_equal_rows_are_one():
    """Rows that are equal in their bytes and label are one group, drawn by the hashes of all its rows, and give the trees of the single rows."""
    rng = np.random.default_rng(4)
    layout = trees.Layout(["a", "b", "l1", "l2"], [np.arange(1.0, 5), np.arange(1.0, 4), np.ones(1), np.ones(1)], [0, 1, 2, 2], [-1, -1, 1, 2], [5, 4, 3])
    bins = np.stack([rng.integers(0, k, 3000) for k in layout.sizes], axis=1).astype(np.uint8)
    y, inside = (rng.random(3000) < 0.1 + 0.15 * bins[:, 0]).astype(np.uint8), rng.random(3000) < 0.7
    h = rng.integers(-(2**63), 2**63 - 1, 3000)
    rows = trees.Merged.of(bins, y, h, inside)
    assert len(rows.y) <= 120 and rows.inside.sum() == inside.sum() and rows.outside.sum() == (~inside).sum()
    params = BoostParams(n_trees=30, max_depth=4, row_share=0.5, pos_weight=2.0, min_child_weight=1.0)
    for share in (0.5, 1.0):
        drawn, singly = rows.drawn(9, share), inside & trees.drawn_rows(h, 9, share)
        for b, label, n in zip(rows.bins, rows.y, drawn, strict=True):
            assert n == (singly & (bins == b).all(axis=1) & (y == label)).sum()
    grown, margin = trees.grow_here(layout, rows, params)
    own, draws = np.zeros(3000), trees.Draws(layout, params)  # the same trees from the sums of single rows
    for t in range(30):
        tree = trees.Tree(layout, params, draws.next())
        used, at = inside & trees.drawn_rows(h, params.seed + t, 0.5), np.ones(3000, np.int64)
        g, hess = trees.gradients(own, y, 2.0)
        while len(tree.open):
            tree.absorb(tree.open, trees.choose(tree, tree.open, trees.sums(tree, bins + layout.offset, at, used, g, hess)))
            at = tree.step(bins, at)
        own += tree.value[at] * params.learning_rate
        same_trees([tree.nodes()], [grown[t]])
    of = {(*b, label): m for b, label, m in zip(rows.bins.tolist(), rows.y.tolist(), margin)}
    assert [of[*b, label] for b, label in zip(bins.tolist(), y.tolist())] == pytest.approx(own.tolist(), rel=1e-9)


def test_more_rows_in_one_task(spark):
    """A table of some hundred thousand rows is a few jobs, not one a level of every tree."""
    df = spark.range(100_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(40)) / 4).alias("a"), F.pmod("id", F.lit(3)).cast("double").alias("b"))
    df = df.withColumn("y", (F.pmod(F.xxhash64("id", "b"), F.lit(12)) < F.col("a")).cast("int"))
    table = boosting.bin_table(df, ["a", "b"], "y", "id")
    spark.sparkContext.setJobGroup("one task", "")
    try:
        model = boosting.fit(table, BoostParams(n_trees=20, max_depth=3))
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("one task")) < 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 20 and model.trees[0][1].cover == pytest.approx(20_000, rel=0.02)


def test_search_over_more_rows_in_one_task_a_fit(spark):
    """The fits of a search over some ten thousand rows a fold are one job together."""
    df = spark.range(70_000).select("id", (F.pmod(F.xxhash64("id"), F.lit(40)) / 4).alias("a"), F.pmod("id", F.lit(2)).cast("int").alias("fold"))
    df = df.withColumn("y", (F.pmod(F.xxhash64("id", "a"), F.lit(12)) < F.col("a")).cast("int"))
    tables = [boosting.bin_table(df, ["a"], "y", "id", keep=["fold"], fit_on=F.col("fold") != k) for k in range(2)]
    spark.sparkContext.setJobGroup("search", "")
    try:
        found = boosting.validate(tables, [BoostParams(n_trees=n, max_depth=2) for n in (15, 5)])
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("search")) < 20
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r[:2] for r in found] == [(0, 0), (0, 1), (1, 0), (1, 1)] and all(x > 0.65 and abs(r[2] - r[3]) < 0.02 for r in found for x in r[2:])


def test_bundles_change_nothing(spark, toy):
    df, _, _ = toy
    levels = df.withColumns({f"l{k}": (F.pmod("id", F.lit(7)) == k).cast("double") for k in range(1, 7)})
    names, bundle = ["a", *[f"l{k}" for k in range(1, 7)], "b"], [f"l{k}" for k in range(1, 7)]
    params = BoostParams(n_trees=6, max_depth=4, min_child_weight=1.0, gamma=0.0)
    one, other = (boosting.fit(boosting.bin_table(levels, names, "y", "id", bundles=b), params) for b in ([], [bundle]))
    same_trees(one.trees, other.trees)
    assert any(names[n.feature].startswith("l") for t in one.trees for n in t.values() if n.feature >= 0)


def test_search_by_either_way(spark, toy, monkeypatch):
    df, x, y = toy
    dealt = df.withColumn("fold", F.pmod("id", F.lit(3)).cast("int"))
    tables = [boosting.bin_table(dealt, ["a", "b", "c"], "y", "id", keep=["fold"], fit_on=F.col("fold") != k) for k in range(3)]
    fits = [BoostParams(n_trees=5, max_depth=3), BoostParams(n_trees=3, max_depth=2, seed=9)]
    plain = boosting.validate(tables, fits)
    assert [r[:2] for r in plain] == [(i, k) for i in range(2) for k in range(3)] and all(min(r[2:]) > 0.5 for r in plain)
    assert sum(r[3] - r[2] for r in plain) > 0
    model = boosting.fit_many(tables[1], fits[:1], F.col("fold") != 1)[0]
    held = boosting.score(model, dealt.filter("fold = 1"))
    assert metrics.ranking_quality(held, "y", "probability").first()["roc_auc"] == pytest.approx(plain[1][2], rel=1e-9)
    monkeypatch.setattr(boosting, "BLOCK_ROWS", 150)
    for a, b in zip(plain, boosting.validate(tables, fits), strict=True):
        assert a == pytest.approx(b, rel=1e-9)


@pytest.mark.parametrize("sign", [1, -1])
def test_monotone(spark, toy, sign):
    df, x, _ = toy
    table = boosting.bin_table(df, ["a", "b", "c"], "y", "id")
    free = boosting.fit(table, BoostParams(n_trees=15, max_depth=4, learning_rate=0.5, min_child_weight=1))
    held = boosting.fit(table, BoostParams(n_trees=15, max_depth=4, learning_rate=0.5, min_child_weight=1, monotone={"c": sign}))
    grid = np.linspace(-3, 3, 60)

    def steps(model):
        rows = x[:100]
        curves = np.stack([boosting.margins(model, np.column_stack([rows[:, 0], rows[:, 1], np.full(100, v)])) for v in grid])
        return np.diff(curves, axis=0)

    assert (sign * steps(held) >= -1e-12).all() and not (sign * steps(free) >= -1e-12).all()


def test_scorers_agree(spark, toy, tmp_path):
    df, x, _ = toy
    table = boosting.bin_table(df, ["a", "b", "c"], "y", "id")
    model = boosting.fit(table, BoostParams(n_trees=6, max_depth=3))
    a = {r["id"]: r["probability"] for r in boosting.score(model, df).collect()}
    c = {r["id"]: r["probability"] for r in boosting.score_binned(model, table).collect()}
    assert a == pytest.approx(c, rel=1e-12)
    model.save(str(tmp_path / "m"), spark)
    back = boosting.BoostedModel.load(str(tmp_path / "m"), spark)
    assert boosting.margins(back, x) == pytest.approx(boosting.margins(model, x), rel=1e-15)


def test_close_to_spark_trees(spark, trained):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    names = trained.state.names
    data = VectorAssembler(inputCols=names, outputCol="features").transform(trained.scored.drop("probability"))
    gbt = GBTClassifier(labelCol="outcome", maxIter=5, maxDepth=3, seed=1).fit(data.filter("not is_test"))
    theirs = BinaryClassificationEvaluator(labelCol="outcome").evaluate(gbt.transform(data.filter("is_test")))
    ours = trained.record["metrics"]["roc_auc"]
    assert ours > 0.97 and ours > theirs - 0.01


def test_importance_sums_to_one(spark, trained):
    rows = boosting.importance(trained.model, spark).collect()
    assert len(rows) == len(trained.state.names) and sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert rows[0]["feature"] == "numerical__price"
    assert boosting.importance(trained.model, spark, 3).count() == 3


def shapley_by_definition(tree, row, features):
    """Average over all orders, absent features by training cover."""
    def worth(i, present):
        node = tree[i]
        if node.feature < 0:
            return node.value
        if node.feature in present:
            return worth(2 * i if row[node.feature] < node.cut else 2 * i + 1, present)
        l, r = tree[2 * i], tree[2 * i + 1]
        return (worth(2 * i, present) * l.cover + worth(2 * i + 1, present) * r.cover) / (l.cover + r.cover)

    phi = np.zeros(features)
    orders = list(itertools.permutations(range(features)))
    for order in orders:
        present = set()
        for f in order:
            before = worth(1, present)
            present.add(f)
            phi[f] += worth(1, present) - before
    return phi / len(orders), worth(1, set())


def test_attributions_by_definition(spark, toy):
    df, x, _ = toy
    model = boosting.fit(boosting.bin_table(df, ["a", "b", "c"], "y", "id"), BoostParams(n_trees=3, max_depth=4, min_child_weight=1))
    want = [shapley_by_definition(t, x[5], 3) for t in model.trees]
    got = sum(explain.attributions(explain.leaves(t), x[5:6])[0] for t in model.trees)
    assert got == pytest.approx(sum(p for p, _ in want), abs=1e-12)
    assert explain.base_value(model) == pytest.approx(sum(b for _, b in want))


def test_looked_up_like_walked(toy):
    """Margins and attributions of many rows come from tables of cells, for trees of any size and for values that are no numbers."""
    rng = np.random.default_rng(2)

    def grow(i, depth, features):
        if not depth:
            return {i: boosting.Node(float(rng.normal()), float(rng.random() + 0.1))}
        left, right = grow(2 * i, depth - 1, features), grow(2 * i + 1, depth - 1, features)
        cover = left[2 * i].cover + right[2 * i + 1].cover
        return {i: boosting.Node(0.0, cover, int(rng.integers(features)), 0, float(rng.integers(-3, 4)), 1.0), **left, **right}

    forest = [grow(1, depth, features) for depth, features in ((3, 4), (4, 3), (0, 1), (6, 40), (2, 40))]
    model = boosting.BoostedModel([f"f{i}" for i in range(40)], forest, 0.25)
    assert [boosting.Cells(t, boosting.cuts_of(model)).count > 0 for t in forest] == [True, True, True, False, True]
    x = rng.integers(-4, 5, (3000, 40)).astype(float)
    x[::100, 0] = np.nan
    want = np.full(3000, 0.25)
    for tree in forest:
        want += boosting.walk_values(tree, x)
    assert boosting.margins(model, x).tolist() == want.tolist()
    direct = explain.attributions([leaf for tree in forest for leaf in explain.leaves(tree)], x)
    found = explain.Explainer(model)
    assert np.abs(found(x) - direct).max() < 1e-12 and np.abs(found(x[:3]) - direct[:3]).max() < 1e-12
    assert found.made is not None


def test_attributions_add_up(spark, trained):
    rows = trained.scored.limit(50)
    tables = evaluation.explain_tables(trained.model, rows, "rid", None, family="categorical__segment_",
                                       pair=("numerical__rate", "numerical__qty"))
    sums = {r["rid"]: r["s"] for r in tables["shapley"].groupBy("rid").agg(F.sum("phi").alias("s")).collect()}
    base = explain.base_value(trained.model)
    for r in rows.collect():
        assert sums[r["rid"]] + base == pytest.approx(math.log(r["probability"] / (1 - r["probability"])), abs=1e-9)
    assert tables["dependence"].count() == 50
    effect = tables["reference_effect"].first()
    assert effect["n_reference"] + effect["n_other"] == 50
    assert sum(r["n"] for r in tables["level_effects"].collect()) == effect["n_other"]
    assert evaluation.explain_tables(trained.model, rows, "rid", 10)["shapley"].select("rid").distinct().count() == 10


def test_quick_train(spark, line):
    t = training.quick_train(line.limit(1500), SPEC, base=QUICK)
    assert t.record["n_draws"] == 10 and t.record["folds"] == 3 and t.search.count() == 10
    assert set(t.search.columns) >= {"mean_auc", "std_auc", "mean_train_auc", "std_train_auc"} and t.search.first()["mean_train_auc"] > 0.9


def test_search(spark, line):
    draws = training.draw_params(2, 1, {**training.SEARCH_SPACE, "n_trees": ("int", 2, 3)})
    assert draws == training.draw_params(2, 1, {**training.SEARCH_SPACE, "n_trees": ("int", 2, 3)})
    assert all(0.01 <= d["learning_rate"] <= 0.1 and 3 <= d["max_depth"] <= 6 for d in training.draw_params(50))
    t = training.train(line, SPEC, QUICK.with_(max_bins=16), draws, folds=2)
    assert t.search.count() == 2 and t.record["n_draws"] == 2 and t.record["params"] in draws
    assert t.params.monotone["numerical__price"] == 1 and t.params.n_trees == t.record["params"]["n_trees"]


def test_no_positive_rows(spark):
    with pytest.raises(ValueError, match="no positive"):
        boosting.positive_weight(spark.createDataFrame([(0,)], "y int"), "y")
    df = spark.createDataFrame([(i % 5 // 4,) for i in range(10)], "y int")
    assert boosting.positive_weight(df, "y") == 4.0


def test_fairness_needs_two_groups(spark, line):
    with pytest.raises(Exception, match="expected 2 groups"):
        fairness.equalized_odds(line, "outcome", "score", "rflag", exactly_two=True).collect()
    assert fairness.equalized_odds(line, "outcome", "score", "rflag").first()["n_groups"] == 3
    for odds, parity in ((("rflag", ("A", "N", "R")), "closed"), (("rflag", ("A", "R")), "segment")):
        with pytest.raises(Exception, match="expected 2 groups"):
            fairness.audit(line, "outcome", "score", odds, parity).collect()
    assert fairness.audit(line, "outcome", "score", ("rflag", ("A", "R")), "closed").count() == 2


def test_empty_denominators(spark):
    row = metrics.clinical(spark.createDataFrame([(0, 0.1)], "y int, p double"), "y", "p").first()
    assert tuple(row) == (1, 0, 0, 0, 0.0, 1.0, 0.0, 1.0)


FIELDS = (rules.Field("qty", "double", above=0), rules.Field("price", "double", above=0), rules.Field("rate", "double", nullable=True),
          rules.Field("closed", "int", allowed=(0, 1)), rules.Field("urgent", "int", allowed=(0, 1)), rules.Field("rflag", "string"),
          rules.Field("ptype", "string"), rules.Field("segment", "string"))


def test_batch_and_stream_scoring(spark, line, trained, tmp_path):
    writers.save_bundle(trained.state, trained.model, str(tmp_path / "bundle"), spark)
    state, model = writers.load_bundle(str(tmp_path / "bundle"), spark)
    batch = line.limit(200).withColumn("qty", F.when(F.substring("rid", 1, 1) == "0", -1.0).otherwise(F.col("qty"))).cache()
    scored, rejected = scoring.score_batch(batch, state, model, FIELDS)
    bad = batch.filter("qty < 0").count()
    assert bad > 0 and rejected.count() == bad and scored.count() == 200 - bad
    want = {r["rid"]: r["probability"] for r in trained.scored.collect()}
    rows = {r["rid"]: r for r in scored.collect()}
    assert all(r["probability"] == pytest.approx(want[k], rel=1e-9) for k, r in rows.items())
    one = next(iter(rows.values()))
    assert json.loads(one["features_used"])["price"] > 0

    (batch.select(F.col("rid"), F.to_json(F.struct(*[f.name for f in FIELDS])).alias("body")).repartition(10, "rid").write.parquet(str(tmp_path / "in")))
    records = spark.readStream.schema("rid string, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def score(df):
        return scoring.score_json(df, "body", state, model, FIELDS)

    def staged():
        return sorted(os.listdir(shared_dir(spark)))

    score(records_of(spark, tmp_path).limit(1)).count()
    before = staged()
    query = streaming.score_stream_batches(records, score, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert staged() == before and len(os.listdir(tmp_path / "out")) == 10
    out = spark.read.parquet(str(tmp_path / "out"))
    again = {r["rid"]: r["probability"] for r in out.filter("status = 'scored'").collect()}
    assert again == pytest.approx({k: r["probability"] for k, r in rows.items()}, rel=1e-9)
    assert out.filter("status = 'rejected' and size(errors) > 0").count() == bad


def records_of(spark, path):
    return spark.read.schema("rid string, body string").parquet(str(path / "in"))


def test_sinks(spark, line, tmp_path):
    small = line.groupBy("segment").count()
    for fmt in ("parquet", "csv", "json"):
        writers.write_table(small, str(tmp_path / fmt), fmt)
        reader = spark.read.option("header", True).format(fmt)
        assert reader.load(str(tmp_path / fmt)).count() == 5
    writers.write_record(spark, {"auc": 0.5, "params": {"a": 1}}, str(tmp_path / "record"))
    assert spark.read.json(str(tmp_path / "record")).first()["params"]["a"] == 1
