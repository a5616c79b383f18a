"""Every registered query: a function of (spark, folder of the tables) that returns a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortry import cohorts
from cohortry.cohorts import LINE_CATEGORICAL, LINE_NUMERIC
from cohortry.functions import expressions as X
from cohortry.operators import (boosting, contingency, explain, fairness, metrics, missingness, neighbours, normality, profile,
                                rules, splitting)
from cohortry.plans import evaluation, features, reports, scoring, training
from cohortry.session import folder, stage
from cohortry.sources import readers, writers
from cohortry.streaming import scoring as streaming

Query = Callable[[SparkSession, str], DataFrame]
CATALOG: dict[str, Query] = {}

LINE_FEATURES = LINE_NUMERIC + LINE_CATEGORICAL
THRESHOLD = 0.8
LINE_FIELDS = (
    rules.Field("qty", "double", above=0, low=1, high=48),
    rules.Field("price", "double", above=0, warn_above=100000),
    rules.Field("rate", "double", nullable=True, above=0),
    rules.Field("closed", "int", allowed=(0, 1)),
    rules.Field("urgent", "int", allowed=(0, 1)),
    rules.Field("rflag", "string", allowed=("A", "N"), must_contain="R"),
    rules.Field("ptype", "string"),
    rules.Field("segment", "string", allowed=("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")),
    rules.Field("outcome", "int", allowed=(0, 1)),
)


def query(source: str = "line"):
    """Register a function of the cohort under its own name."""
    def register(fn):
        load = cohorts.line_cohort if source == "line" else cohorts.doc_cohort

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(load(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        CATALOG[fn.__name__] = run
        return fn
    return register


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column, so that the order of a floating-point sum does not show."""
    out = {}
    for name, dtype in df.dtypes:
        if dtype == "double":
            out[name] = F.round(F.col(name), special.get(name, digits))
    return df.withColumns(out) if out else df


@query()
def prevalence_by_group(c):
    return rounded(contingency.prevalence(c, "segment", "outcome"))


@query()
def crosstab_margins(c):
    return contingency.crosstab_margins(c, "segment", "outcome")


@query("doc")
def crosstab_dense(c):
    return contingency.crosstab_dense(contingency.cell_counts(c, ["source"], "quality"))


@query("doc")
def expected_freq(c):
    return rounded(contingency.expected_frequencies(contingency.cell_counts(c, ["lang", "source"], "quality")))


@query()
def chi_square(c):
    t = contingency.chi_square(contingency.cell_counts(c, ["segment", "ptype", "rflag", "closed", "urgent"], "outcome"))
    return rounded(t.select("variable", "chi2", F.col("dof").cast("long").alias("dof"), "n", "min_expected"))


@query()
def cramers_v(c):
    t = contingency.chi_square(contingency.cell_counts(c, ["segment", "ptype", "rflag", "closed", "urgent"], "outcome"))
    return rounded(t.select("variable", "cramers_v"))


@query()
def chi_square_p_values(c):
    t = contingency.chi_square(contingency.cell_counts(c, ["segment", "ptype", "rflag", "closed", "urgent"], "outcome"))
    return rounded(t.select("variable", "p_value", "significant"), 9)


@query("doc")
def chi_square_missing(c):
    t = missingness.missing_by_category(c, "quality", ["lang", "source"])
    return rounded(t.select("variable", "chi2", F.col("dof").cast("long").alias("dof"), "n", "p_value"))


@query()
def pairwise_chi_square(c):
    t = contingency.pairwise_chi_square(c, "segment", "outcome", "BUILDING")
    return rounded(t.select("base_level", "other_level", "chi2", "base_rate", "other_rate", "p_value", "significant"))


@query()
def mutual_information(c):
    return rounded(contingency.mutual_information(contingency.cell_counts(c, ["segment", "ptype", "rflag", "closed"], "outcome")), 9)


@query()
def table_summary(c):
    return rounded(profile.table_summary(c, "outcome", ["qty", "price", "rate"], ("price", 100000.0)), 4)


@query()
def level_counts(c):
    return profile.level_counts(c, ["rflag", "ptype", "segment"])


@query()
def missing_profile(c):
    return rounded(profile.missing_profile(c, LINE_FEATURES))


@query()
def cardinality_profile(c):
    return rounded(profile.cardinality(c, LINE_FEATURES), 9)


@query()
def top3_values(c):
    return profile.top_values(c, LINE_FEATURES).select("feature", "value", "n", F.col("position").cast("long").alias("position"))


@query()
def class_balance(c):
    return rounded(profile.class_balance(c, "outcome"))


@query()
def moments(c):
    return rounded(profile.moments(c, LINE_NUMERIC).drop("g1", "g2"))


@query()
def label_codes(c):
    return profile.label_codes(c, ["rflag", "ptype", "segment"], "rid")


def _coded(c):
    return stage(profile.factorize(c, ["rflag", "ptype", "segment"], "rid"), "coded")


@query()
def corr_matrix(c):
    return rounded(profile.correlations(_coded(c), [*LINE_FEATURES, "outcome"]).drop("i", "j"))


@query()
def target_corr(c):
    return rounded(profile.target_correlations(profile.correlations(_coded(c), [*LINE_FEATURES, "outcome"]), "outcome"))


@query()
def high_corr_pairs(c):
    return rounded(profile.high_pairs(profile.correlations(c, [*LINE_NUMERIC, "closed", "urgent", "outcome", "score"])))


@query("doc")
def cov_means(c):
    return rounded(profile.means_and_covariances(c, ["n_chars", "n_words", "quality", "toxic"]), 4)


@query("doc")
def missing_patterns(c):
    return profile.missing_patterns(c, ["n_chars", "n_words", "quality", "toxic"])


@query()
def group_means(c):
    return rounded(profile.group_means(c, X.missing_flag("rate").cast("long"), ["qty", "price", "outcome"]))


@query()
def point_biserial(c):
    t = missingness.point_biserial(c, "rate", ["qty", "price", "closed", "urgent", "outcome"])
    return rounded(t.select("feature", "r", "n", "t", "p_value", "significant"))


@query()
def t_test_missing(c):
    t = missingness.mean_difference(c, "rate", ["qty", "price", "closed", "urgent", "outcome"])
    return rounded(t.select("feature", "n_missing", "n_present", "mean_when_missing", "mean_when_present", "t", "dof", "p_value", "significant"))


@query()
def missing_share(c):
    return rounded(missingness.missing_share(c, "rate"))


@query()
def mcar_test(c):
    return rounded(missingness.pattern_test(c, ["qty", "price", "rate", "closed", "urgent", "outcome"]))


@query("doc")
def mcar_test_documents(c):
    return rounded(missingness.pattern_test(c.withColumn("toxic", F.when(F.col("lang") != "en", F.col("toxic")))))


@query()
def missing_logit(c):
    return rounded(missingness.missing_odds(c, "rate", ["qty", "price", "closed", "urgent"]))


@query()
def missing_logit_certificate(c):
    """At the largest likelihood the residuals have no part along any input; their mean products with the scaled inputs."""
    columns = ["qty", "price", "closed", "urgent"]
    fitted = missingness.missing_odds(c, "rate", columns)
    weights = {r["feature"]: r["coefficient"] for r in fitted.collect()}
    spread = {"intercept": F.lit(1.0), "qty": F.col("qty") / 50, "price": F.col("price") / 1e5, "closed": F.col("closed"), "urgent": F.col("urgent")}
    margin = sum((F.col(x) * weights[x] for x in columns), F.lit(weights["intercept"]))
    gap = X.missing_flag("rate").cast("double") - 1 / (1 + F.exp(-margin))
    sums = c.agg(*[F.avg(gap * x).alias(name) for name, x in spread.items()], F.count("*").alias("n"))
    rows = F.array(*[F.struct(F.lit(name).alias("feature"), (F.round(F.abs(name), 4)).alias("score")) for name in spread])
    return sums.select(F.inline(rows), "n").join(fitted.select("feature", "n_used", "n_lacking"), "feature")


@query()
def mean_impute_contrast(c):
    return rounded(missingness.mean_fill_contrast(c, "rate", "qty"))


@query()
def dagostino(c):
    t = normality.k_squared_test(c, LINE_NUMERIC)
    return rounded(t, 12, statistic=3)


@query("doc")
def shapiro(c):
    t = normality.w_test(c, ["n_chars", "n_words", "quality"])
    return rounded(t.select("feature", "n", "statistic"))


@query()
def distribution_table(c):
    return rounded(normality.distribution_table(c, LINE_NUMERIC))


@query()
def histogram(c):
    t = normality.histogram(c, LINE_NUMERIC)
    return rounded(t.select("feature", F.col("bin").cast("long").alias("bin"), "lower", "n", "density"), 9)


@query("doc")
def kde(c):
    t = normality.density(c, ["n_chars", "n_words"])
    return rounded(t.select("feature", F.col("point").cast("long").alias("point"), "x", "density"), 6, density=12)


@query("doc")
def qq_points(c):
    return rounded(normality.normal_scores(c, ["n_chars", "n_words"], "rid"))


@query()
def qq_fit(c):
    return rounded(normality.normal_fit(c, LINE_NUMERIC))


@query()
def pearson_ci(c):
    t = normality.correlation_interval(c, ["qty", "price", "rate", "closed", "urgent"], "outcome")
    return rounded(t.select("feature", "n", "r", "lower", "upper", "t", "p_value", "remove"))


@query()
def iqr_outliers(c):
    return rounded(normality.iqr_outliers(c, ["qty", "price", "rate"]))


@query()
def vif(c):
    return rounded(normality.variance_inflation(c, ["qty", "price", "rate", "closed", "urgent"]))


@query()
def vif_three(c):
    return rounded(normality.variance_inflation(c, LINE_NUMERIC))


@query()
def validate_report(c):
    return rules.report(c, LINE_FIELDS)


@query()
def dirty_report(c):
    """Texts that are no numbers, numbers below their bound, missing values and an undeclared level, counted by the rules."""
    start = F.substring("rid", 1, 1)
    dirty = c.select(F.when(start == "0", "many").when(start == "1", "-3").otherwise(F.col("qty").cast("string")).alias("qty"),
                     F.when(start == "2", None).otherwise(F.col("closed")).alias("closed"),
                     F.when(start == "3", "Z").otherwise(F.col("rflag")).alias("rflag"))
    return rules.report(dirty, [rules.Field("qty", "double", above=0), rules.Field("closed", "int", allowed=(0, 1)),
                                rules.Field("rflag", "string", allowed=("A", "N", "R"), must_contain="N")])


@query()
def csv_round_trip(c):
    """Written as CSV with its missing values, read back as text, checked for its columns, and coerced."""
    spark = c.sparkSession
    path = folder(spark, "csv")
    names = [f.name for f in LINE_FIELDS]
    writers.write_table(c.select("rid", *names), path, "csv")
    back = readers.read_csv(spark, path)
    assert not rules.column_differences(back, LINE_FIELDS, ["rid"])
    whole = rules.coerce(back, LINE_FIELDS)
    assert rules.drop_key(whole, "rid").columns == names
    return rounded(whole.select("rid", *names))


@query()
def plain_names(c):
    named = c.select(F.concat(F.lit("categorical__segment_"), "segment").alias("feature"))
    return named.groupBy(X.plain_name(F.col("feature")).alias("feature")).agg(F.count("*").alias("n"))


@query()
def outlier_warning(c):
    return rules.outlier_examples(c, "rid", "price", 100000.0)


@query()
def failing_values(c):
    return rules.failing_values(c, LINE_FIELDS, "rid").drop("value")


@query()
def rare_merge(c):
    rare = c.withColumn("rflag", F.when(F.col("rid") == c.agg(F.min("rid")).first()[0], "X").otherwise(F.col("rflag")))
    return rules.merge_rare(rare, "rflag", "X", "N").groupBy("rflag").agg(F.count("*").alias("n"))


@query()
def validate_rows(c):
    return rules.annotate(c, LINE_FIELDS).select(
        "rid", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", "; ").alias("errors"))


@query()
def stratified_split(c):
    return splitting.stratified_split(c, "rid", "outcome").select("rid", "outcome", "is_test")


@query()
def stratified_folds(c):
    return splitting.stratified_folds(c, "rid", "outcome").select("rid", "outcome", F.col("fold").cast("long").alias("fold"))


@query()
def hash_sample(c):
    return splitting.hash_sample(c, "rid", 500).select("rid", "qty", "price")


@query()
def robust_scale(c):
    centre, scale = features.scaler_stats(c, LINE_NUMERIC)
    return rounded(c.select("rid", *[((F.col(x) - centre[x]) / scale[x]).alias(f"numerical__{x}") for x in LINE_NUMERIC]))


@query()
def one_hot(c):
    state = features.FeatureState("rid", [], None, LINE_CATEGORICAL, 10, {}, {}, features.category_levels(c, LINE_CATEGORICAL))
    return c.select("rid", *features.one_hot(state))


@query()
def missing_indicator(c):
    return c.select("rid", "rate", X.missing_flag("rate").cast("long").alias("rate_missing"))


@query("doc")
def knn_impute(c):
    scaled = _scaled_docs(c)
    return rounded(neighbours.fill_missing(scaled, "quality", ["x", "w"], "rid"))


def _scaled_docs(c):
    centre, scale = features.scaler_stats(c, ["n_chars", "n_words"])
    return c.select("rid", ((F.col("n_chars") - centre["n_chars"]) / scale["n_chars"]).alias("x"),
                    ((F.col("n_words") - centre["n_words"]) / scale["n_words"]).alias("w"), F.col("quality").cast("double").alias("quality"))


@query()
def knn_impute_large(c):
    rows = stage(c.select("rid", *LINE_NUMERIC), "rows")  # the cohort is joined once
    centre, scale = features.scaler_stats(rows, LINE_NUMERIC)
    scaled = rows.select("rid", *[((F.col(x) - centre[x]) / scale[x]).alias(x) for x in LINE_NUMERIC])
    return rounded(neighbours.fill_missing(scaled, "rate", ["qty", "price"], "rid", written=True))


@query("doc")
def impute_quality(c):
    return rounded(neighbours.imputation_quality(_scaled_docs(c), "quality", ["x", "w"], "rid")).select(
        F.col("k").cast("long").alias("k"), "n", "rmse", "mae", "r2")


@query("doc")
def feature_matrix(c):
    split = stage(splitting.stratified_split(c, "rid", "toxic"), "split")
    state = features.fit(split.filter(~F.col("is_test")), "rid", ["n_chars", "n_words", "quality"], ["lang"], "quality")
    return rounded(features.apply(state, split, ["is_test"]))


DOC_NUMERIC = ["n_chars", "n_words", "quality"]
DOC_FIELDS = (rules.Field("n_chars", "double", above=0), rules.Field("n_words", "double", above=0), rules.Field("quality", "double", nullable=True),
              rules.Field("lang", "string", allowed=("de", "en", "es", "fr")))


def _fitted_apart(c):
    """A state learned from the training documents, saved and loaded again, and the documents outside."""
    split = stage(splitting.stratified_split(c, "rid", "toxic"), "split")
    path = folder(c.sparkSession, "state")
    features.fit(split.filter(~F.col("is_test")), "rid", DOC_NUMERIC, ["lang"], "quality").save(path, c.sparkSession)
    return features.FeatureState.load(path, c.sparkSession), split.filter("is_test").drop("is_test")


@query("doc")
def transform_new_rows(c):
    """rows that the state has not seen, by the donor index saved with it."""
    state, new = _fitted_apart(c)
    return rounded(features.apply(state, new))


@query()
def missing_cells(c):
    return rules.missing_cells(c, LINE_NUMERIC)


@query()
def confusion(c):
    return metrics.confusion(c, "outcome", "score", THRESHOLD)


@query()
def clinical_metrics(c):
    return rounded(metrics.clinical(c, "outcome", "score", THRESHOLD))


@query()
def class_report(c):
    return rounded(metrics.classification_report(c, "outcome", "score", THRESHOLD))


@query()
def threshold_table(c):
    return rounded(metrics.threshold_table(c, "outcome", "score"))


@query()
def roc_curve(c):
    return rounded(metrics.roc_curve(c, "outcome", "score"))


@query()
def roc_auc(c):
    return rounded(metrics.ranking_quality(c, "outcome", "score").select("roc_auc", "positive_rate"))


@query()
def pr_curve(c):
    return rounded(metrics.precision_recall(c, "outcome", "score"))


@query()
def avg_precision(c):
    return rounded(metrics.ranking_quality(c, "outcome", "score").select("average_precision"))


@query()
def operating_points(c):
    return rounded(metrics.operating_points(metrics.precision_recall(c, "outcome", "score")))


@query()
def group_rates(c):
    return rounded(fairness.group_rates(c, "outcome", "score", ["rflag", "closed", "segment"], THRESHOLD))


@query()
def equalized_odds(c):
    return rounded(fairness.equalized_odds(c, "outcome", "score", "closed", THRESHOLD, exactly_two=True))


@query()
def demographic_parity(c):
    return rounded(fairness.demographic_parity(c, "outcome", "score", "urgent", THRESHOLD, exactly_two=True))


@query()
def fairness_audit(c):
    return rounded(fairness.audit(c, "outcome", "score", ("rflag", ("A", "R")), "closed", THRESHOLD, limit=0.001))


def _direct(fn: Query) -> Query:
    """Register a function of (spark, folder) under its own name."""
    CATALOG[fn.__name__] = fn
    return fn


@query()
def risk_bands(c):
    return scoring.with_bands(c.select("rid", F.col("score").alias("probability")))


@query()
def score_records(c):
    """Validate, set aside, and band the fixture score: the part of scoring that needs no model."""
    valid, rejected = rules.split_rows(c, LINE_FIELDS)
    good = scoring.with_bands(valid.select("rid", F.col("score").alias("probability")))
    bad = rejected.select("rid", F.size("errors").cast("long").alias("n_errors"))
    return good.select("rid", "risk_level", "confidence", F.lit(0).cast("long").alias("n_errors")).unionByName(
        bad.select("rid", F.lit(None).cast("string").alias("risk_level"), F.lit(None).cast("string").alias("confidence"), "n_errors"))


EVENT_FIELDS = (rules.Field("k", "int", low=0, high=90),)


@_direct
def json_records(spark, sf_dir):
    parsed = readers.parse_json(cohorts.table(spark, sf_dir, "events").select("event_id", "props"), "props", EVENT_FIELDS)
    marked = rules.annotate(parsed, EVENT_FIELDS)
    return marked.select("event_id", F.col("k").try_cast("long").alias("k"), F.size("errors").cast("long").alias("n_errors"))


@_direct
def score_stream(spark, sf_dir):
    """A file stream of events, scored to parquet until all available rows are done, then read back."""
    schema = cohorts.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)

    def bands(df):
        p = F.least(F.col("value") / 100, F.lit(1.0))
        parsed = readers.parse_json(df.select("event_id", p.alias("probability"), "props"), "props", EVENT_FIELDS)
        return scoring.with_bands(rules.annotate(parsed, EVENT_FIELDS)).select(
            "event_id", "risk_percentage", "risk_level", "alert", "confidence", F.size("errors").cast("long").alias("n_errors"))

    base = folder(spark, "stream")
    streaming.score_stream(events, bands, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


LINE_SPEC = training.CohortSpec("rid", "outcome", LINE_NUMERIC, LINE_CATEGORICAL, "rate", rising=("qty", "price"))
DEFAULT = boosting.BoostParams(seed=42)


@query()
def boosted_fit(c):
    t = training.train(c, LINE_SPEC, DEFAULT)
    return rounded(t.model.table(c.sparkSession))


@query()
def boosted_score(c):
    t = training.train(c, LINE_SPEC, DEFAULT)
    return rounded(scoring.with_bands(t.scored.filter("is_test").select("rid", "outcome", "probability")))


@query()
def importance(c):
    t = training.train(c, LINE_SPEC, DEFAULT)
    return rounded(boosting.importance(t.model, c.sparkSession))


@query()
def training_record(c):
    t = training.train(c, LINE_SPEC, DEFAULT)
    rows = [(k, float(v)) for k, v in {**t.record["metrics"], "pos_weight": t.record["pos_weight"], "n_rows": t.record["n_rows"]}.items()]
    return rounded(c.sparkSession.createDataFrame(rows, "name string, value double"))


@query()
def random_search(c):
    """The quick search: 10 draws from the whole space, 3 folds."""
    inside = stage(c, "cohort")
    weighted = DEFAULT.with_(pos_weight=boosting.positive_weight(inside, "outcome"))
    return rounded(training.search_summary(training.random_search(inside, LINE_SPEC, weighted, training.draw_params(10), folds=3)))


@query()
def full_evaluation(c):
    t = training.train(c, LINE_SPEC, DEFAULT)
    groups = c.select("rid", "rflag", "closed")
    test = stage(t.scored.filter("is_test").select("rid", "outcome", "probability").join(groups, "rid"), "test")
    tables = evaluation.evaluate(test, "outcome", 0.5, ("rflag", ("A", "R")), "closed")
    return rounded(evaluation.as_rows(tables, ["classification_report", "clinical", "ranking", "thresholds", "roc_curve", "pr_curve", "operating_points", "fairness", "group_rates"]))


SPLIT_FEATURES = ["qty", "closed", "urgent", "rflag_N", "rflag_R"]


def _split_table(c):
    """Features with few values, so that every value is a cut, and the parameters of a single tree of all rows and features."""
    rows = c.select("rid", "outcome", *[F.col(x).cast("double").alias(x) for x in SPLIT_FEATURES[:3]],
                    *[F.when(F.col("rflag") == v, 1.0).otherwise(0.0).alias(f"rflag_{v}") for v in ("N", "R")])
    whole = boosting.BoostParams(n_trees=1, max_depth=1, learning_rate=1.0, row_share=1.0, column_share=1.0, pos_weight=boosting.positive_weight(rows, "outcome"))
    return boosting.bin_table(rows, SPLIT_FEATURES, "outcome", "rid", bundles=[SPLIT_FEATURES[3:]]), whole


@query()
def first_split(c):
    """M2, M3: the first split with its gain, weights and covers, free and under either limit on one feature."""
    table, whole = _split_table(c)
    limits = {"free": {}, "rising": {"qty": 1}, "falling": {"qty": -1}}
    models = boosting.fit_many(table, [whole.with_(monotone=m) for m in limits.values()])
    rows = []
    for limit, model in zip(limits, models, strict=True):
        root, left, right = (model.trees[0][i] for i in (1, 2, 3))
        rows.append((limit, SPLIT_FEATURES[root.feature], root.cut, root.gain, left.value, right.value, left.cover, right.cover))
    schema = "direction string, feature string, cut double, gain double, left_value double, right_value double, left_cover double, right_cover double"
    return rounded(c.sparkSession.createDataFrame(rows, schema), 5)


@query()
def tree_importance(c):
    """M9: normalised mean gains of a tree of two levels."""
    table, whole = _split_table(c)
    return rounded(boosting.importance(boosting.fit(table, whole.with_(max_depth=2)), c.sparkSession))


def _attributed(c):
    t = training.train(c, LINE_SPEC, DEFAULT)
    return t, explain.attribute(t.model, t.scored, "rid")


@query()
def shap_values(c):
    """Attributions of all rows, with the margin they must add up to."""
    t = training.train(c, LINE_SPEC, DEFAULT)
    wide = explain.attribute(t.model, t.scored, "rid", keep=["probability"])
    total = F.aggregate("phi", F.lit(0.0), lambda s, x: s + x) + explain.base_value(t.model)
    logit = F.log(F.col("probability") / (1 - F.col("probability")))
    return rounded(wide.select("rid", total.alias("margin"), logit.alias("logit")), 5)


@query()
def shap_global(c):
    t, wide = _attributed(c)
    return rounded(explain.global_importance(wide, t.model.features))


@query()
def shap_dependence(c):
    t, wide = _attributed(c)
    return rounded(explain.dependence(wide, t.model.features, "rid", "numerical__rate", "numerical__qty"))


@query()
def shap_reference_level(c):
    t, wide = _attributed(c)
    return rounded(explain.reference_effect(wide, t.model.features, "categorical__segment_"))


@query()
def shap_level_effects(c):
    t, wide = _attributed(c)
    return rounded(explain.level_effects(wide, t.model.features, "categorical__segment_"))


NODE = boosting.Node
#: A small model with known covers and gains, for results that SQL can state.
FIXED_MODEL = boosting.BoostedModel(
    ["qty", "price", "closed", "categorical__segment_BUILDING", "categorical__segment_MACHINERY"],
    [{1: NODE(0.0, 1000.0, 1, 0, 50000.0, 120.5), 2: NODE(-0.6, 600.0), 3: NODE(0.0, 400.0, 0, 0, 25.0, 40.25), 6: NODE(0.2, 150.0), 7: NODE(0.9, 250.0)},
     {1: NODE(0.0, 1000.0, 2, 0, 0.5, 18.0), 2: NODE(0.0, 500.0, 3, 0, 0.5, 7.5), 3: NODE(0.05, 500.0), 4: NODE(-0.1, 400.0), 5: NODE(0.3, 100.0)},
     {1: NODE(0.0, 1000.0, 4, 0, 0.5, 3.25), 2: NODE(0.02, 800.0), 3: NODE(-0.15, 200.0)}], -0.4)


def _fixed_rows(c):
    levels = [F.when(F.col("segment") == v, 1.0).otherwise(0.0).alias(f"categorical__segment_{v}") for v in ("BUILDING", "MACHINERY")]
    return c.select("rid", *[F.col(x).cast("double").alias(x) for x in ("qty", "price", "closed")], *levels)


def _fixed_score(rows):
    scored = scoring.with_bands(boosting.score(FIXED_MODEL, rows).withColumn("closed", F.col("closed").cast("int")), used=["closed"])
    return rounded(scored.select("rid", "probability", "risk_percentage", "risk_level", "alert", "confidence", "features_used"))


@query()
def score_model(c):
    return _fixed_score(_fixed_rows(c))


@query()
def stream_model(c):
    """The same scoring on a stream of written records."""
    spark = c.sparkSession
    base = folder(spark, "stream")
    rows = _fixed_rows(c)
    rows.write.parquet(f"{base}/in")
    records = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    streaming.score_stream(records, _fixed_score, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out")


#: A small model over prepared documents, for scores that SQL can state.
DOC_MODEL = boosting.BoostedModel(
    ["numerical__n_chars", "numerical__quality", "categorical__lang_es", "numerical__quality_missing"],
    [{1: NODE(0.0, 1000.0, 0, 0, 0.5, 60.0), 2: NODE(0.0, 700.0, 1, 0, -0.25, 20.0), 3: NODE(0.9, 300.0), 4: NODE(-1.0, 200.0), 5: NODE(0.2, 500.0)},
     {1: NODE(0.0, 1000.0, 2, 0, 0.5, 9.0), 2: NODE(-0.3, 750.0), 3: NODE(0.4, 250.0)},
     {1: NODE(0.0, 1000.0, 3, 0, 0.5, 5.0), 2: NODE(-0.1, 900.0), 3: NODE(1.3, 100.0)}], -0.2)


def _doc_records(new):
    """Raw JSON of documents, some unreadable, some with a wrong type, some with a value outside its domain."""
    n = F.pmod(F.col("rid"), F.lit(35))
    body = F.to_json(F.struct("n_chars", F.when(n == 1, F.lit("many")).otherwise(F.col("n_words").cast("string")).alias("n_words"), "quality",
                              F.when(n == 2, F.lit("xx")).otherwise(F.col("lang")).alias("lang")))
    return new.select("rid", F.when(n == 3, F.lit("{")).otherwise(body).alias("body"))


def _doc_scores(scored):
    wanted = ["rid", "status", "probability", "risk_percentage", "risk_level", "alert", "confidence", "features_used"]
    return rounded(scored.select(*wanted, F.coalesce(F.size("errors"), F.lit(0)).cast("long").alias("n_errors")), 5)


@query("doc")
def score_cohort(c):
    """R1 from raw records to bands, with a state and donors learned from other rows."""
    state, new = _fitted_apart(c)
    return _doc_scores(scoring.score_json(_doc_records(new), "body", state, DOC_MODEL, DOC_FIELDS))


@query("doc")
def stream_cohort(c):
    """R2: the same on a stream of written records, a file in each micro-batch."""
    spark = c.sparkSession
    state, new = _fitted_apart(c)
    base = folder(spark, "stream")
    _doc_records(new).repartition(4, "rid").write.parquet(f"{base}/in")
    records = spark.readStream.schema("rid long, body string").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    streaming.score_stream_batches(records, lambda df: scoring.score_json(df, "body", state, DOC_MODEL, DOC_FIELDS), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return _doc_scores(spark.read.parquet(f"{base}/out").drop("batch"))


def _fixed_phi(c):
    return explain.attribute(FIXED_MODEL, _fixed_rows(c), "rid")


@query()
def shap_fixed(c):
    phi = [F.get("phi", F.lit(i)).alias(f"phi_{name.rpartition('_')[2].lower()}") for i, name in enumerate(FIXED_MODEL.features)]
    return rounded(_fixed_phi(c).select("rid", *phi))


@query()
def shap_tables_fixed(c):
    """Global importance, effect of the reference level and effects of the other levels, as one table."""
    wide = stage(_fixed_phi(c), "phi")
    names, family = FIXED_MODEL.features, "categorical__segment_"
    most = explain.global_importance(wide, names).select("feature", F.lit("mean_abs_phi").alias("metric"), F.col("mean_abs_phi").alias("value"))
    level = explain.level_effects(wide, names, family).select("feature", F.lit("mean_phi").alias("metric"), F.col("mean_phi").alias("value"))
    effect = explain.reference_effect(wide, names, family).select(F.col("verdict").alias("feature"), F.lit("effect").alias("metric"), F.col("effect").alias("value"))
    return rounded(most.unionByName(level).unionByName(effect))


@query()
def shap_dependence_fixed(c):
    return rounded(explain.dependence(_fixed_phi(c), FIXED_MODEL.features, "rid", "price", "qty"))


@query()
def missingness_report(c):
    tables = reports.missingness_tables(stage(c, "cohort"), "rate", "segment", "outcome", "BUILDING",
                                        ["qty", "price", "closed", "urgent", "outcome"], ["segment", "rflag", "ptype"])
    return rounded(reports.missingness_findings(tables, "rate", "segment", "BUILDING"))


@query()
def profile_report(c):
    return rounded(reports.profile_findings(reports.profile_tables(stage(c.drop("score"), "cohort"), "outcome", "rid")))
