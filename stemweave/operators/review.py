"""Blinded review packages and the analysis of returned ratings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemweave.functions.hashing import MODULUS, portable_hash
from stemweave.functions.keys import review_category
from stemweave.operators.resample import bootstrap_mean
from stemweave.plans.skew import attach_groups

RATINGS = ("acceptable", "harmless", "harmful")


def build_review(oof: DataFrame, adjacency: DataFrame, seed: int, models: tuple[str, str], top: int = 3) -> DataFrame:
    """Top segments of both models per sample under seeded panel names, with the truth audit.

    ``oof(model, sample_id, segment_id, label, score)``, ``adjacency(sample_id, segment_id, neighbor_id)``.
    The rank filter also runs before the shuffle, so a sample sends at most ``top`` rows per task.
    """
    window = Window.partitionBy("sample_id", "model").orderBy(F.col("score").desc(), "segment_id")
    best = oof.filter(F.col("model").isin(*models)).withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)
    straight = portable_hash(seed, F.col("sample_id")) < MODULUS // 2
    first = F.col("model") == models[0]
    panel = F.when(straight == first, "Panel A").otherwise("Panel B")
    truths = oof.filter((F.col("model") == models[0]) & (F.col("label") == 1)).select("sample_id", F.col("segment_id").alias("truth_id"))
    counts = truths.groupBy("sample_id").agg(F.count(F.lit(1)).alias("truth_cut_count"))
    near = adjacency.join(
        truths.withColumnRenamed("truth_id", "neighbor_id"), ["sample_id", "neighbor_id"], "left_semi"
    ).select("sample_id", "segment_id").distinct().withColumn("_near", F.lit(1))
    chosen = best.join(near, ["sample_id", "segment_id"], "left").join(counts, "sample_id", "left")
    return chosen.select(
        "sample_id", panel.alias("panel"), "model", "rank", "segment_id",
        (F.col("label") == 1).cast("int").alias("exact_truth"),
        F.greatest((F.col("label") == 1).cast("int"), F.coalesce("_near", F.lit(0))).alias("hop1_truth"),
        F.coalesce("truth_cut_count", F.lit(0)).alias("truth_cut_count"),
    )


def scoring_sheet(review: DataFrame) -> DataFrame:
    """The empty sheet that goes to the reviewer: no model names in it."""
    blank = lambda n: F.lit("").alias(n)
    return review.select("sample_id", "panel", "rank", *[blank(r) for r in RATINGS], blank("confidence_1_to_5"), blank("reason_or_note"))


def blind_key(review: DataFrame) -> DataFrame:
    return review.select("sample_id", "panel", "model").distinct()


def with_category(sheet: DataFrame) -> DataFrame:
    return sheet.withColumn("category", review_category(*[F.col(c) for c in RATINGS]))


def key_violations(df: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.groupBy(*on).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], validate: str, how: str = "inner") -> DataFrame:
    """Join that refuses repeated keys on the side(s) ``validate`` calls "one"."""
    sides = {"one_to_one": (left, right), "many_to_one": (right,), "one_to_many": (left,)}[validate]
    for side in sides:
        if key_violations(side, on).limit(1).count():
            raise ValueError(f"join on {list(on)} is not {validate}")
    if validate == "many_to_one":
        return attach_groups(left, right, on, how)
    return left.join(right, list(on), how)


def read_log(states: DataFrame, column: str = "scores") -> DataFrame:
    """Rows of a log whose JSON object maps ``sample|panel|slot`` to ``{"category": ...}``."""
    schema = T.MapType(T.StringType(), T.StructType([T.StructField("category", T.StringType())]))
    entries = states.select(F.explode(F.from_json(F.col(column), schema)).alias("key", "value"))
    parts = F.split(F.col("key"), r"\|", 3)
    category = F.trim(F.col("value.category"))
    return entries.select(
        parts[0].alias("sample_id"), parts[1].alias("panel"), parts[2].cast("int").alias("display_slot"),
        F.when(category.isin(*RATINGS), category).otherwise("").alias("category"),
    )


def reconcile_review(log: DataFrame, sheet: DataFrame, slots: int = 3) -> DataFrame:
    """Agreement of the log with the sheet per key: match, mismatch, log_only, sheet_only."""
    keys = ["sample_id", "panel", "display_slot"]
    a = log.filter(F.col("display_slot") <= slots).select(*keys, F.col("category").alias("log_category"))
    b = sheet.filter(F.col("display_slot") <= slots).select(*keys, F.col("category").alias("sheet_category"))
    state = (
        F.when(F.col("sheet_category").isNull(), "log_only")
        .when(F.col("log_category").isNull(), "sheet_only")
        .when(F.col("log_category") == F.col("sheet_category"), "match")
        .otherwise("mismatch")
    )
    return a.join(b, keys, "full").withColumn("agreement", state)


def _counts() -> list[Column]:
    return [F.count(F.lit(1)).alias("recommendations"), *[F.count_if(F.col("category") == r).alias(r) for r in RATINGS]]


def _rates() -> list[Column]:
    n = F.col("recommendations")
    rate = lambda top: F.when(n > 0, top / n)
    return [
        *[rate(F.col(r)).alias(f"{r}_rate") for r in RATINGS],
        rate(F.col("acceptable") + F.col("harmless")).alias("non_harmful_rate"),
    ]


def review_rates(rated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts and rates per group with the at-least-one flags."""
    counted = rated.groupBy(*by).agg(*_counts())
    return counted.select(
        *by, "recommendations", *RATINGS, *_rates(),
        (F.col("acceptable") > 0).cast("long").alias("success"),
        (F.col("acceptable") + F.col("harmless") > 0).cast("long").alias("non_harmful_success"),
        (F.col("harmful") > 0).cast("long").alias("any_harmful"),
    )


def review_rates_by_rank(rated: DataFrame, ranks: int = 10) -> DataFrame:
    """Counts and rates for every model and rank 1..ranks, also where nothing was rated."""
    frame = rated.select("model").distinct().withColumn("model_rank", F.explode(F.sequence(F.lit(1), F.lit(ranks))))
    counted = rated.groupBy("model", "model_rank").agg(*_counts())
    n = F.col("recommendations")
    joined = frame.join(counted, ["model", "model_rank"], "left").na.fill(0, ["recommendations", *RATINGS])
    return joined.select(
        "model", "model_rank", "recommendations", *RATINGS,
        F.when(n > 0, F.col("acceptable") / n).alias("acceptable_rate"),
        F.when(n > 0, F.col("harmful") / n).alias("harmful_rate"),
    )


def paired_review(tree_rows: DataFrame, models: tuple[str, str]) -> DataFrame:
    """Tree rows of both models side by side with differences first - second; trees with both only."""
    a, b = models
    wide = tree_rows.groupBy("tree_id").pivot("model", [a, b]).agg(
        F.first("acceptable_rate").alias("acc"), F.first("harmful_rate").alias("harm"), F.first("success").alias("success")
    )
    delta = lambda c: (F.col(f"{a}_{c}") - F.col(f"{b}_{c}"))
    return wide.filter(F.col(f"{a}_acc").isNotNull() & F.col(f"{b}_acc").isNotNull()).select(
        "tree_id",
        delta("acc").alias("acceptable_difference"), delta("harm").alias("harmful_difference"), delta("success").alias("success_difference"),
    )


def paired_intervals(pairs: DataFrame, n: int = 10000, seed: int = 20260862) -> DataFrame:
    return bootstrap_mean(pairs, ["acceptable_difference", "harmful_difference", "success_difference"], n, seed)
