"""Run summaries: runtimes, variants, thresholds per fold and batch aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.functions.hashing import counting
from stemweave.plans.skew import exact_quantiles


def runtime_summary(runs: DataFrame, repeats: int | None = None) -> DataFrame:
    """Mean per sample over repeats, then mean, sd, median, min and max over samples per stage."""
    per_sample = runs.groupBy("stage", "sample_id").agg(F.avg("seconds").alias("mean_seconds"), F.count(F.lit(1)).alias("n"))
    stats = per_sample.groupBy("stage").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("mean_seconds").alias("mean"),
        F.stddev_samp("mean_seconds").alias("sd"),
        F.min("mean_seconds").alias("min"),
        F.max("mean_seconds").alias("max"),
        (F.count_if(F.col("n") != repeats) if repeats is not None else F.lit(0).cast("long")).alias("incomplete_samples"),
    )
    median = exact_quantiles(per_sample, ["stage"], "mean_seconds", [0.5], "median").select("stage", "median")
    return stats.join(median, "stage")


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population std, min and max per column in long form."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}"), F.min(c).alias(f"i_{c}"), F.max(c).alias(f"x_{c}")]
    rows = [
        F.struct(
            F.lit(c).alias("metric"), F.col(f"a_{c}").alias("mean"), F.col(f"s_{c}").alias("std"),
            F.col(f"i_{c}").cast("double").alias("min"), F.col(f"x_{c}").cast("double").alias("max"),
        )
        for c in columns
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def variant_summary(df: DataFrame, metrics: Sequence[str], baseline: str) -> DataFrame:
    """Per variant and metric: mean, mean change against ``baseline`` and samples better, worse, equal.

    ``df(variant, sample_id, <metrics>)`` has one row per (variant, sample).
    """
    long = df.select("variant", "sample_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("m")).select("variant", "sample_id", "m.*")
    base = long.filter(F.col("variant") == baseline).select("sample_id", "metric", F.col("value").alias("base"))
    delta = F.col("value") - F.col("base")
    return long.join(base, ["sample_id", "metric"]).groupBy("variant", "metric").agg(
        F.count(F.lit(1)).alias("samples"), F.avg("value").alias("mean"), F.avg(delta).alias("mean_delta"),
        F.count_if(delta > 1e-9).alias("improved"), F.count_if(delta < -1e-9).alias("degraded"), F.count_if(F.abs(delta) <= 1e-9).alias("unchanged"),
    )


def pooled_ratio(df: DataFrame, by: Sequence[str], top: str, bottom: str, name: str) -> DataFrame:
    """Sum over sum, null where nothing was counted."""
    return df.groupBy(*by).agg(F.sum(top).alias("_t"), F.sum(bottom).alias("_b")).select(*by, F.when(F.col("_b") > 0, F.col("_t") / F.col("_b")).alias(name))


def select_direction_threshold(records: DataFrame, folds: int, candidates: Sequence[float], min_coverage: float = 0.5) -> DataFrame:
    """Per held-out fold the confidence threshold with the best accuracy on the other folds.

    ``records(fold, confidence, correct)``. Coverage counts against the records at the lowest
    candidate; what it lacks to ``min_coverage`` is taken off the accuracy. Equal values go to the
    higher accuracy, the higher coverage, then the lower threshold. Records are first counted by
    the highest candidate they pass, so only a small histogram meets folds and candidates.
    """
    levels = sorted(float(c) for c in candidates)
    passed = F.aggregate(F.array(*[F.lit(c) for c in levels]), F.lit(0), lambda acc, c: acc + F.when(F.col("confidence") >= c, 1).otherwise(0))
    cells = records.groupBy("fold", passed.alias("passed")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("correct").cast("long")).alias("good"))
    options = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("at"), F.lit(c).alias("threshold")) for i, c in enumerate(levels)]))
    spread = (
        cells.withColumn("held_out", F.explode(counting(folds))).filter("fold <> held_out").withColumn("o", options)
    )
    kept = F.col("passed") >= F.col("o.at")
    scored = spread.groupBy("held_out", "o.threshold").agg(
        F.sum(F.when(F.col("passed") >= 1, F.col("n")).otherwise(0)).alias("base"),
        F.sum(F.when(kept, F.col("n")).otherwise(0)).alias("used"),
        F.sum(F.when(kept, F.col("good")).otherwise(0)).alias("good"),
    )
    accuracy = F.when(F.col("used") > 0, F.col("good") / F.col("used")).otherwise(0.0)
    coverage = F.col("used") / F.greatest(F.col("base"), F.lit(1))
    value = F.when(coverage >= min_coverage, accuracy).otherwise(accuracy - (min_coverage - coverage))
    best = F.max(F.struct(value.alias("value"), accuracy.alias("accuracy"), coverage.alias("coverage"), (-F.col("threshold")).alias("_n")))
    return scored.groupBy("held_out").agg(best.alias("b")).select(
        "held_out", (-F.col("b._n")).alias("threshold"), "b.value", "b.accuracy", "b.coverage"
    )


def aggregate_runs(runs: DataFrame) -> DataFrame:
    """Runs, share of acyclic results, mean attachment rate and buds, per category and overall."""
    return runs.rollup("category").agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(F.col("is_dag").cast("double")).alias("dag_rate"),
        F.avg("attachment_rate").alias("attachment_rate_mean"),
        F.sum("buds").alias("total_buds"),
    )


def mean_of_metrics(df: DataFrame) -> DataFrame:
    """Mean of every numeric column, in long form."""
    numeric = [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    means = df.agg(*[F.avg(c).alias(c) for c in numeric])
    return means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("mean")) for c in numeric])).alias("r")).select("r.*")


def routing_health(stats: DataFrame) -> DataFrame:
    """Success rate over routed and skipped parts per sample, and trunk nodes of degree above two.

    ``stats(sample_id, routed, skipped, trunk_fork_nodes)``.
    """
    total = F.col("routed") + F.col("skipped")
    return stats.select(
        "sample_id", F.when(total > 0, F.col("routed") / total).otherwise(0.0).alias("success_rate"), "trunk_fork_nodes",
        (F.col("trunk_fork_nodes") == 0).alias("single_trunk_path"),
    )
