"""Classification metrics from a scored table: label 0/1 and a probability."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortry.functions.expressions import predicted_class
from cohortry.operators.ordering import running
from cohortry.operators.profile import unfold
from cohortry.session import stage


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _counts(label: str, predicted: Column) -> list[Column]:
    y = F.col(label)
    return [F.count_if((y == 0) & (predicted == 0)).alias("tn"), F.count_if((y == 0) & (predicted == 1)).alias("fp"),
            F.count_if((y == 1) & (predicted == 0)).alias("fn"), F.count_if((y == 1) & (predicted == 1)).alias("tp")]


def confusion(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """``(tn, fp, fn, tp)`` in one pass."""
    return df.agg(*_counts(label, predicted_class(F.col(score), threshold)))


def clinical(df: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Sensitivity (recall of the positive class), specificity, PPV, NPV; zero where undefined."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion(df, label, score, threshold).select(
        "tn", "fp", "fn", "tp", _share(tp, tp + fn).alias("sensitivity"), _share(tn, tn + fp).alias("specificity"),
        _share(tp, tp + fp).alias("ppv"), _share(tn, tn + fn).alias("npv"))


def classification_report(df: DataFrame, label: str, score: str, threshold: float = 0.5,
                          names: tuple[str, str] = ("negative", "positive")) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    wide = confusion(df, label, score, threshold)
    total = tn + fp + fn + tp
    wide = wide.select(
        "*", total.alias("total"), (tn + fp).alias("s0"), (tp + fn).alias("s1"),
        _share(tn, tn + fn).alias("p0"), _share(tn, tn + fp).alias("r0"), _share(2.0 * tn, 2 * tn + fn + fp).alias("f0"),
        _share(tp, tp + fp).alias("p1"), _share(tp, tp + fn).alias("r1"), _share(2.0 * tp, 2 * tp + fp + fn).alias("f1"))

    def row(name, p, r, f, n):
        return F.struct(F.lit(name).alias("class_name"), p.alias("precision"), r.alias("recall"), f.alias("f1_score"), n.alias("support"))

    def macro(x):
        return (F.col(f"{x}0") + F.col(f"{x}1")) / 2

    def weighted(x):
        return _share(F.col(f"{x}0") * F.col("s0") + F.col(f"{x}1") * F.col("s1"), F.col("total"))

    accuracy = _share(tn + tp, F.col("total"))
    rows = [row(names[i], F.col(f"p{i}"), F.col(f"r{i}"), F.col(f"f{i}"), F.col(f"s{i}")) for i in (0, 1)]
    rows += [row("accuracy", accuracy, accuracy, accuracy, F.col("total")),
             row("macro avg", macro("p"), macro("r"), macro("f"), F.col("total")),
             row("weighted avg", weighted("p"), weighted("r"), weighted("f"), F.col("total"))]
    return unfold(wide, rows)


def threshold_table(df: DataFrame, label: str, score: str, thresholds: Sequence[float] = (0.3, 0.5, 0.7)) -> DataFrame:
    """Recall and precision at each threshold, all from one pass."""
    y, s = F.col(label), F.col(score)
    aggs = [F.count_if(y == 1).alias("pos")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((s >= t) & (y == 1)).alias(f"tp{i}"), F.count_if(s >= t).alias(f"sel{i}")]
    rows = [F.struct(F.lit(float(t)).alias("threshold"), _share(F.col(f"tp{i}"), F.col("pos")).alias("recall"),
                     _share(F.col(f"tp{i}"), F.col(f"sel{i}")).alias("precision"), F.col(f"sel{i}").alias("n_selected"))
            for i, t in enumerate(thresholds)]
    return unfold(df.agg(*aggs), rows)


def score_counts(df: DataFrame, label: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: equal scores are counted before anything is ordered."""
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return stage(known.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")), "scores")


def cumulative_counts(df: DataFrame, label: str, score: str, **options) -> DataFrame:
    """One row per distinct score, high to low: ``score, pos, neg, tp, fp, next_pos, next_neg, all_pos, all_neg``."""
    grouped = score_counts(df, label, score)
    steps = running(grouped, ["score"], {"tp": "pos", "fp": "neg"}, descending=True, staged=True,
                    following={"next_pos": "pos", "next_neg": "neg"}, **options)
    totals = grouped.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).first()
    return steps.withColumns({"all_pos": F.lit(totals["p"]).cast("long"), "all_neg": F.lit(totals["n"]).cast("long")})


def roc_curve(df: DataFrame, label: str, score: str, steps: DataFrame | None = None, **options) -> DataFrame:
    """``(threshold, fpr, tpr)``; inner points on a straight line are dropped, (0, 0) is added.

    This and the next two take ready ``cumulative_counts`` as ``steps`` when several are wanted.
    """
    steps = cumulative_counts(df, label, score, **options) if steps is None else steps
    first = F.col("tp") + F.col("fp") == F.col("pos") + F.col("neg")
    last = F.col("next_pos").isNull()
    straight = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
    kept = steps.filter(first | last | ~straight)
    curve = kept.select(F.col("score").alias("threshold"), F.try_divide("fp", "all_neg").alias("fpr"),
                        F.try_divide("tp", "all_pos").alias("tpr"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return start.unionByName(curve)


def ranking_quality(df: DataFrame, label: str, score: str, steps: DataFrame | None = None, **options) -> DataFrame:
    """ROC-AUC by trapezoids, average precision as a step sum, and the positive rate."""
    steps = cumulative_counts(df, label, score, **options) if steps is None else steps
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    precise = F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))
    sums = steps.agg(F.sum(area).alias("a"), F.sum(precise).alias("s"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    p, n = F.col("p"), F.col("n")
    return sums.select(F.try_divide(F.col("a"), p.cast("double") * n).alias("roc_auc"), F.try_divide("s", "p").alias("average_precision"),
                       F.try_divide(p, p + n).alias("positive_rate"))


def roc_auc_by(df: DataFrame, label: str, score: str, by: Sequence[str], **options) -> DataFrame:
    """E5 for each group: ``by..., roc_auc``; running totals go along the scores of all groups at once."""
    counts = df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    steps = running(counts, ["score"], {"upto": "neg"}, by=by, **options)
    sums = steps.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)).alias("a"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(*by, F.try_divide("a", F.col("p").cast("double") * F.col("n")).alias("roc_auc"))


def precision_recall(df: DataFrame, label: str, score: str, steps: DataFrame | None = None, **options) -> DataFrame:
    """``(threshold, precision, recall)`` and the end point (1, 0) without a threshold."""
    steps = cumulative_counts(df, label, score, **options) if steps is None else steps
    curve = steps.select(F.col("score").alias("threshold"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                         F.try_divide("tp", "all_pos").alias("recall"))
    end = df.sparkSession.range(1).select(F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(end)


def operating_points(curve: DataFrame, thresholds: Sequence[float] = (0.1, 0.3, 0.5, 0.7), recall: float = 0.8) -> DataFrame:
    """The curve points nearest to given thresholds and to a given recall; ties take the lower threshold."""
    def near(distance):
        return F.min(F.when(F.col("threshold").isNotNull(), F.struct(distance.alias("d"), "threshold", "precision", "recall")))

    found = curve.agg(*[near(F.abs(F.col("threshold") - t)).alias(f"t{i}") for i, t in enumerate(thresholds)],
                      near(F.abs(F.col("recall") - recall)).alias("r"))

    def row(kind, target, column):
        return F.struct(F.lit(kind).alias("kind"), F.lit(float(target)).alias("target"), F.col(f"{column}.threshold").alias("threshold"),
                        F.col(f"{column}.precision").alias("precision"), F.col(f"{column}.recall").alias("recall"))

    return unfold(found, [row("threshold", t, f"t{i}") for i, t in enumerate(thresholds)] + [row("recall", recall, "r")])
