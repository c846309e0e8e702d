"""Score curves: average precision, AUROC, PR/ROC rows, thresholds and point metrics.

Everything starts from one histogram per (keys, score); running sums over it are spread over the
cluster, so neither many ties nor many distinct scores meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stemweave.plans.durable import written
from stemweave.plans.skew import exact_quantiles, running_totals

MODEL = ["model"]


def score_counts(df: DataFrame, by: Sequence[str], weight: Column | None = None) -> DataFrame:
    """Rows and positives per distinct score."""
    one = F.lit(1).cast("long") if weight is None else weight
    return df.groupBy(*by, "score").agg(F.sum(one).alias("n"), F.sum(F.col("label") * one).alias("pos"))


def cumulative_by_score(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Running rows ``above`` and positives ``tp`` from the highest score down, with the totals."""
    return running_totals(
        counts, by, [F.col("score").desc()], {"above": F.col("n"), "tp": F.col("pos")}, whole={"n_all": "above", "p_all": "tp"}
    )


def curve_areas(cumulative: DataFrame, by: Sequence[str]) -> DataFrame:
    """Step-wise average precision and tie-aware AUROC in one aggregate."""
    neg = F.col("n") - F.col("pos")
    negatives = F.col("n_all") - F.col("p_all")
    return (
        cumulative.groupBy(*by, "n_all", "p_all")
        .agg(
            F.sum(F.col("pos") * F.col("tp") / F.col("above")).alias("_ap"),
            F.sum(neg * (F.col("tp") - F.col("pos") / 2.0)).alias("_u"),
        )
        .select(
            *by,
            F.when(F.col("p_all") > 0, F.col("_ap") / F.col("p_all")).alias("average_precision"),
            F.when((F.col("p_all") > 0) & (negatives > 0), F.col("_u") / (F.col("p_all") * negatives)).alias("auroc"),
        )
    )


def areas(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return curve_areas(cumulative_by_score(score_counts(df, by), by), by)


def average_precision(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return areas(df, by).select(*by, "average_precision")


def auroc(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    return areas(df, by).select(*by, "auroc")


def pr_curve(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Precision and recall at every distinct score, closed by (1, 0) without a threshold."""
    points = cumulative_by_score(score_counts(df, by), by).select(
        *by,
        (F.col("tp") / F.col("above")).alias("precision"),
        F.when(F.col("p_all") > 0, F.col("tp") / F.col("p_all")).otherwise(1.0).alias("recall"),
        F.col("score").alias("threshold"),
    )
    closing = df.select(*by).distinct().select(
        *by, F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(closing)


def roc_curve(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """False and true positive rates at every distinct score, opened by (0, 0)."""
    negatives = F.col("n_all") - F.col("p_all")
    points = cumulative_by_score(score_counts(df, by), by).select(
        *by,
        F.when(negatives > 0, (F.col("above") - F.col("tp")) / negatives).alias("fpr"),
        F.when(F.col("p_all") > 0, F.col("tp") / F.col("p_all")).alias("tpr"),
        F.col("score").alias("threshold"),
    )
    opening = df.select(*by).distinct().select(
        *by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(None).cast("double").alias("threshold")
    )
    return points.unionByName(opening)


def precision_at_recall(curve: DataFrame, targets: Sequence[float], by: Sequence[str] = MODEL) -> DataFrame:
    """Precision interpolated linearly on recall.

    Recall repeats along the curve; the last point of a run (lowest threshold) is the left end and
    the first point of the next run the right end of the interpolation.
    """
    asked = curve.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    left = F.col("recall") <= F.col("target")
    low_order = F.struct("recall", F.coalesce(-F.col("threshold"), F.lit(float("-inf"))))
    high_order = F.struct(F.col("recall"), -F.col("threshold"))
    ends = asked.groupBy(*by, "target").agg(
        F.max(F.when(left, F.struct(low_order.alias("o"), F.col("precision").alias("v")))).alias("lo"),
        F.min(F.when(~left, F.struct(high_order.alias("o"), F.col("precision").alias("v")))).alias("hi"),
    )
    r0, r1 = F.col("lo.o.recall"), F.col("hi.o.recall")
    p0, p1 = F.col("lo.v"), F.col("hi.v")
    value = F.when(F.col("hi").isNull(), p0).otherwise(p0 + (p1 - p0) * (F.col("target") - r0) / (r1 - r0))
    return ends.select(*by, "target", value.alias("precision_at_recall"))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _ratio(2.0 * tp, 2 * tp + fp + fn)


def classification_metrics(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Confusion counts, precision, recall, F1, macro-F1, gain over chance, Brier score."""
    t, p = F.col("label") == 1, F.col("prediction") == 1
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
        F.avg(F.pow(F.col("score") - F.col("label"), 2)).alias("brier"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    base = (tp + fn) / (tp + fp + fn + tn)
    return counts.select(
        *by, "tp", "fp", "fn", "tn",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        f1(tp, fp, fn).alias("f1"),
        ((f1(tp, fp, fn) + f1(tn, fn, fp)) / 2).alias("macro_f1"),
        F.when(base > 0, _ratio(tp, tp + fp) / base).otherwise(0.0).alias("multiple_over_random"),
        "brier",
    )


def _macro(tp: Column, above: Column) -> Column:
    fp, fn = above - tp, F.col("p_all") - tp
    tn = F.col("n_all") - above - fn
    return (f1(tp, fp, fn) + f1(tn, fn, fp)) / 2


def threshold_grid() -> list[float]:
    """0.05 to 0.95 in steps of 0.01, with linspace's rounding."""
    step = (0.95 - 0.05) / 90
    return [0.05 + i * step for i in range(90)] + [0.95]


def _scan_thresholds(counts: DataFrame, by: Sequence[str], grid: DataFrame) -> DataFrame:
    """Macro-F1 at every threshold of ``grid(by, threshold)`` from counts of the score histogram.

    Thresholds and scores form one ordered list; a running sum from the top gives the rows at or
    above each threshold without pairing thresholds with scores.
    """
    marks = grid.select(*by, F.col("threshold").alias("score"), F.lit(0).cast("long").alias("n"),
                        F.lit(0).cast("long").alias("pos"), F.lit(1).alias("mark"))
    merged = counts.select(*by, "score", "n", "pos", F.lit(0).alias("mark")).unionByName(marks)
    running = running_totals(
        merged, by, [F.col("score").desc(), F.col("mark")], {"above": F.col("n"), "tp": F.col("pos")},
        whole={"n_all": "above", "p_all": "tp"},
    )
    return running.filter("mark = 1").select(
        *by, F.col("score").alias("threshold"), _macro(F.col("tp"), F.col("above")).alias("macro_f1")
    )


def choose_threshold_grid(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Best macro-F1 on the fixed grid; of equal values the threshold nearest one half."""
    counts = written(score_counts(df, by), "scores")
    grid = counts.select(*by).distinct().withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in threshold_grid()])))
    scanned = _scan_thresholds(counts, by, grid)
    order = F.struct(F.col("macro_f1"), -F.abs(F.col("threshold") - 0.5), -F.col("threshold"))
    return scanned.groupBy(*by).agg(F.max(F.struct(order.alias("o"), "threshold", "macro_f1")).alias("b")).select(
        *by, "b.threshold", "b.macro_f1"
    )


def quantile_candidates() -> list[float]:
    """300 probabilities from 0.01 to 0.99, with linspace's rounding."""
    step = (0.99 - 0.01) / 299
    return [0.01 + i * step for i in range(299)] + [0.99]


def choose_threshold_quantile(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Best macro-F1 over 0, 0.5, 1 and 300 score quantiles; of equal values the highest threshold."""
    counts = written(score_counts(df, by), "scores")
    quantiles = exact_quantiles(counts, by, "score", quantile_candidates(), "threshold", weight="n").select(*by, "threshold")
    fixed = counts.select(*by).distinct().withColumn("threshold", F.explode(F.array(F.lit(0.0), F.lit(0.5), F.lit(1.0))))
    scanned = _scan_thresholds(counts, by, quantiles.unionByName(fixed).distinct())
    return scanned.groupBy(*by).agg(F.max(F.struct("macro_f1", "threshold")).alias("b")).select(
        *by, "b.threshold", "b.macro_f1"
    )


def macro_by_tree(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Mean over trees with a positive of the tree's average precision."""
    per_tree = areas(df, [*by, "tree_id"]).filter(F.col("average_precision").isNotNull())
    return per_tree.groupBy(*by).agg(
        F.avg("average_precision").alias("tree_macro_ap"), F.count(F.lit(1)).alias("trees_with_positive")
    )


def per_view_load(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Mean recommendations and mean false recommendations per view."""
    views = df.groupBy(*by, "sample_id").agg(
        F.sum("prediction").alias("made"), F.sum(F.col("prediction") * (1 - F.col("label"))).alias("false_made")
    )
    return views.groupBy(*by).agg(
        F.avg("false_made").alias("mean_false_recommendations_per_view"),
        F.avg("made").alias("mean_recommendations_per_view"),
    )


def tree_metrics(df: DataFrame, by: Sequence[str] = MODEL) -> DataFrame:
    """Average precision, macro-F1, precision and recall per (keys, tree)."""
    keys = [*by, "tree_id"]
    scores = areas(df, keys).select(*keys, F.col("average_precision").alias("pr_auc"))
    points = classification_metrics(df, keys).select(*keys, "macro_f1", "precision", "recall")
    return points.join(scores, keys)


def metric_rollup(df: DataFrame) -> DataFrame:
    """Counts by model, tree and view in one pass over grouping sets."""
    return df.groupingSets(
        [[F.col("model")], [F.col("model"), F.col("tree_id")], [F.col("model"), F.col("tree_id"), F.col("sample_id")]],
        "model", "tree_id", "sample_id",
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"), F.sum("prediction").alias("recommended"),
        F.grouping_id().cast("long").alias("level"),
    )
