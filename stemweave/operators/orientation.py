"""Directions of detected objects against the line work they sit on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.functions.geometry import clamp, norm

# fixed values: decay of attachment confidence and the reliability limits
ATTACHMENT_DECAY_PX = 36.0
SHORT_AXIS_PX = 4.0


def directed_orientation(df: DataFrame, max_distance: float, min_confidence: float) -> DataFrame:
    """Base and tip of an axis, its confidence and why it is not reliable.

    ``df(ax, ay, bx, by, distance_a, distance_b, score, aspect_ratio)``: both axis ends and their
    distances to the line work. The nearer end is the base.
    """
    c = F.col
    a_first = c("distance_a") <= c("distance_b")
    pick = lambda p, q: F.when(a_first, c(p)).otherwise(c(q))
    base_x, base_y, tip_x, tip_y = pick("ax", "bx"), pick("ay", "by"), pick("bx", "ax"), pick("by", "ay")
    vx, vy = tip_x - base_x, tip_y - base_y
    length = norm(vx, vy)
    near = F.least(c("distance_a"), c("distance_b"))
    elongated = clamp((c("aspect_ratio") - 1.0) / 1.2, 0.0, 1.0)
    polarity = clamp(F.abs(c("distance_a") - c("distance_b")) / F.greatest(length * 0.35, F.lit(2.0)), 0.0, 1.0)
    confidence = F.coalesce(c("score"), F.lit(1.0)) * F.exp(-near / ATTACHMENT_DECAY_PX) * polarity * (0.3 + 0.7 * elongated)
    reason = (
        F.when(near > max_distance, "far_from_skeleton")
        .when(length < SHORT_AXIS_PX, "short_axis")
        .when(confidence < min_confidence, "ambiguous_polarity")
        .otherwise("")
    )
    size = F.greatest(length, F.lit(1e-6))
    return df.select(
        *df.columns, base_x.alias("base_x"), base_y.alias("base_y"), tip_x.alias("tip_x"), tip_y.alias("tip_y"),
        (vx / size).alias("vx"), (vy / size).alias("vy"), near.alias("attachment_distance"), confidence.alias("confidence"),
        reason.alias("failure_reason"), (reason == "").alias("is_reliable"),
    )


def axial_difference(a: Column, b: Column) -> Column:
    """Difference of two undirected angles, at most a right angle; a right angle when one is missing."""
    d = F.abs(a - b)
    return F.coalesce(F.least(d, math.pi - d), F.lit(math.pi / 2))


def validate_angles(df: DataFrame) -> DataFrame:
    """Agreement of an axis with tangent and normal.

    ``df(axis_angle, tangent_angle?, normal_angle?, is_elongated)``. The tangent counts until 60
    degrees, the normal until 45; round objects weigh 0.3 and 0.3 instead of a half each.
    """
    t = axial_difference(F.col("axis_angle"), F.col("tangent_angle"))
    n = axial_difference(F.col("axis_angle"), F.col("normal_angle"))
    fold = lambda v: F.least(v, math.pi - v)
    ts = F.greatest(F.lit(0.0), 1.0 - fold(t) / (math.pi / 3))
    ns = F.greatest(F.lit(0.0), 1.0 - fold(n) / (math.pi / 4))
    score = F.when(F.col("is_elongated"), 0.5 * ts + 0.5 * ns).otherwise(0.3 * ts + 0.3 * ns)
    return df.select(*df.columns, t.alias("tangent_difference"), n.alias("normal_difference"), score.alias("consistency_score"), (score >= 0.5).alias("is_consistent"))


def object_center(boxes: DataFrame, pixels: DataFrame) -> DataFrame:
    """Mean of an object's pixels, else the centre of its box, rounded and clamped to the image.

    ``boxes(sample_id, box_id, x1, y1, x2, y2, width, height)``, ``pixels(sample_id, box_id, x, y)``.
    """
    means = pixels.groupBy("sample_id", "box_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    joined = boxes.join(means, ["sample_id", "box_id"], "left")
    place = lambda mean, lo, hi, size: clamp(F.rint(F.coalesce(F.col(mean), (F.col(lo) + F.col(hi)) / 2)), 0.0, F.col(size) - 1)
    return joined.select("sample_id", "box_id", place("mx", "x1", "x2", "width").alias("cx"), place("my", "y1", "y2", "height").alias("cy"))


def axial_consistency(df: DataFrame, by: list[str], angle: str) -> DataFrame:
    from stemweave.functions.geometry import axial_stats

    return df.groupBy(*by).agg(axial_stats(F.col(angle)).alias("s")).select(*by, "s.*")


def point_axis(df: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    from stemweave.functions.geometry import principal_axis

    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("points"), principal_axis(F.col(x), F.col(y)).alias("a")).select(*by, "points", "a.axis_angle", "a.aspect_ratio")
