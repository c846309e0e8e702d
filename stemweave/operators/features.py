"""Feature tables of segments, branches and regions, and their context."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.functions import geometry as g
from stemweave.functions.keys import split_groups
from stemweave.operators.graph import incidence, neighbor_sums
from stemweave.plans.skew import attach_groups, attach_scalars

# fixed values: the five kinds of segment
CANDIDATE_TYPES = ("junction--bud", "bud--bud", "junction--junction", "bud--endpoint", "junction--endpoint")


def segment_features(
    segments: DataFrame, images: DataFrame, depths: DataFrame, buds: DataFrame, branches: DataFrame, region_distance: DataFrame | None = None
) -> DataFrame:
    """Ids, labels and the 39 features of every segment.

    ``segments(sample_id, segment_id, start_node, end_node, start_types, end_types, candidate_type,
    group_ids, polyline, length_px, is_candidate, label_mask, is_cut_segment)``;
    ``images(sample_id, width, height)``; ``depths(sample_id, segment_id, depth)``; ``buds(sample_id,
    segment_id, label, score, distance, is_reliable, vx, vy)`` assigned to segments; ``branches(
    sample_id, group_id, local_crowding, relative_height, bud_density)``; ``region_distance(sample_id,
    segment_id, distance)``, zero where absent. Geometry stays in the row; neighbours, depths, buds
    and groups are aggregates joined on the segment.
    """
    c = F.col
    keys = ["sample_id", "segment_id"]
    poly = c("polyline")
    geo = segments.select(
        *keys, g.chord(poly).alias("chord"), g.turning_mean(poly).alias("curvature_mean"), g.turning_max(poly).alias("curvature_max"),
        g.tangent(poly).alias("direction"), g.mean_point(poly).alias("mid"), F.array_min(F.transform(poly, lambda p: p.x)).alias("x_lo"),
        F.array_max(F.transform(poly, lambda p: p.x)).alias("x_hi"), F.array_min(F.transform(poly, lambda p: p.y)).alias("y_lo"), F.array_max(F.transform(poly, lambda p: p.y)).alias("y_hi"),
    )
    near = neighbor_sums(segments.select(*keys, "start_node", "end_node", "length_px", c("label_mask").cast("long").alias("label_mask")), ["length_px", "label_mask"])
    ends = incidence(segments).groupBy("sample_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    loops = segments.filter("start_node = end_node").groupBy("sample_id", c("start_node").alias("node_id")).agg(F.count(F.lit(1)).alias("l"))
    degree = ends.join(loops, ["sample_id", "node_id"], "left").select("sample_id", "node_id", (c("n") + F.coalesce("l", F.lit(0))).alias("degree"))
    at = lambda side: degree.select("sample_id", c("node_id").alias(f"{side}_node"), c("degree").alias(f"{side}_degree"))
    deepest = depths.groupBy("sample_id").agg(F.max("depth").alias("max_depth"), F.count(F.lit(1)).alias("n_segments"))
    owned = segments.select(*keys, F.explode("group_ids").alias("group_id"))
    sizes = owned.groupBy("sample_id", "group_id").agg(F.count(F.lit(1)).alias("group_size"))
    grouped = attach_groups(owned, sizes.join(branches, ["sample_id", "group_id"], "left"), ["sample_id", "group_id"]).groupBy(*keys).agg(
        F.max("group_size").alias("group_size"), *[F.avg(v).alias(f"g_{v}") for v in ("local_crowding", "relative_height", "bud_density")]
    )
    with_direction = attach_groups(buds, geo.select(*keys, "direction"), keys)
    reliable = c("is_reliable")
    per_bud = with_direction.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bud_n"), F.count_if(c("label") == 0).alias("flower_n"), F.avg(F.coalesce("score", F.lit(0.0))).alias("score_mean"),
        F.avg(F.coalesce("distance", F.lit(0.0))).alias("distance_mean"), F.count_if(reliable).alias("reliable_n"),
        F.avg(F.when(reliable, F.abs(c("direction.x") * c("vx") + c("direction.y") * c("vy")))).alias("alignment"),
    )
    roi = (region_distance if region_distance is not None else segments.select(*keys, F.lit(0.0).alias("distance"))).select(*keys, c("distance").alias("roi"))
    j = segments.join(geo, keys).join(near, keys).join(depths, keys).join(per_bud, keys, "left").join(grouped, keys, "left").join(roi, keys, "left")
    j = j.join(at("start"), ["sample_id", "start_node"], "left").join(at("end"), ["sample_id", "end_node"], "left")
    j = attach_groups(attach_groups(j, images.select("sample_id", "width", "height"), ["sample_id"]), deepest, ["sample_id"])
    w, h = c("width"), c("height")
    diagonal = F.greatest(g.norm(w.cast("double"), h.cast("double")), F.lit(1.0))
    zero = lambda name: F.coalesce(c(name), F.lit(0.0))
    has = lambda side, *names: F.arrays_overlap(c(f"{side}_types"), F.array(*[F.lit(n) for n in names])).cast("double")
    kind = lambda name: F.coalesce(c("candidate_type") == name, F.lit(False)).cast("double")
    border = F.least(c("x_lo"), c("y_lo"), w - 1 - c("x_hi"), h - 1 - c("y_hi"))
    n = F.coalesce("bud_n", F.lit(0))
    features: dict[str, Column] = {
        "length_norm": c("length_px") / diagonal,
        "chord_norm": c("chord") / diagonal,
        "tortuosity": c("length_px") / F.greatest(c("chord"), F.lit(1.0)),
        "curvature_mean": c("curvature_mean"),
        "curvature_max": c("curvature_max"),
        "mid_x_norm": c("mid.x") / F.greatest(w, F.lit(1)),
        "relative_height": 1.0 - c("mid.y") / F.greatest(h, F.lit(1)),
        "orientation_x": c("direction.x"),
        "orientation_y": c("direction.y"),
        "image_edge_distance_norm": F.greatest(border, F.lit(0.0)) / diagonal,
        "roi_edge_distance_norm": F.greatest(zero("roi"), F.lit(0.0)) / diagonal,
        "root_depth_norm": c("depth") / F.when(c("max_depth") > 0, c("max_depth")).otherwise(1),
        "neighbor_count": c("neighbors").cast("double"),
        "candidate_neighbor_count": c("sum_label_mask").cast("double"),
        "neighbor_length_mean_norm": F.when(c("neighbors") > 0, c("sum_length_px") / c("neighbors")).otherwise(0.0) / diagonal,
        "same_group_segment_count_norm": F.coalesce("group_size", F.lit(0)) / F.greatest(c("n_segments"), F.lit(1)),
        "start_degree": c("start_degree").cast("double"),
        "end_degree": c("end_degree").cast("double"),
        "start_bud": has("start", "bud"),
        "end_bud": has("end", "bud"),
        "start_junction": has("start", "junction", "root"),
        "end_junction": has("end", "junction", "root"),
        "start_endpoint": has("start", "endpoint"),
        "end_endpoint": has("end", "endpoint"),
        "candidate_bud_bud": kind("bud--bud"),
        "candidate_junction_bud": kind("junction--bud"),
        "candidate_bud_endpoint": kind("bud--endpoint"),
        "candidate_junction_endpoint": kind("junction--endpoint"),
        "candidate_junction_junction": kind("junction--junction"),
        "bud_count_norm": n / 10.0,
        "bud_density_norm": n / F.greatest(c("length_px"), F.lit(1.0)) * 100.0,
        "flower_bud_ratio": F.coalesce("flower_n", F.lit(0)) / F.greatest(n, F.lit(1)),
        "bud_score_mean": zero("score_mean"),
        "bud_attachment_distance_norm": zero("distance_mean") / diagonal,
        "reliable_direction_ratio": F.coalesce("reliable_n", F.lit(0)) / F.greatest(n, F.lit(1)),
        "bud_direction_alignment": zero("alignment"),
        "local_crowding": zero("g_local_crowding"),
        "group_relative_height": zero("g_relative_height"),
        "group_bud_density": zero("g_bud_density"),
    }
    return j.select(
        *keys, F.coalesce("candidate_type", F.lit("")).alias("candidate_type"), F.array_join("group_ids", ";").alias("group_ids"), "is_cut_segment",
        ((c("label_mask") != 0) & (c("is_candidate") != 0)).cast("int").alias("label_mask"), *[v.alias(k) for k, v in features.items()],
    )


END_TYPES = ("bud", "junction", "endpoint", "root")


def segment_features_min(segments: DataFrame, images: DataFrame) -> DataFrame:
    """Ids, labels and the ten columns of the small node table: length over the diagonal, candidate, types of both ends."""
    diagonal = F.greatest(g.norm(F.col("width").cast("double"), F.col("height").cast("double")), F.lit(1.0))
    j = attach_groups(segments, images.select("sample_id", "width", "height"), ["sample_id"])
    flags = [F.array_contains(f"{side}_types", t).cast("double").alias(f"{side}_{t}") for t in END_TYPES for side in ("start", "end")]
    return j.select(
        "sample_id", "segment_id", "is_cut_segment", ((F.col("label_mask") != 0) & (F.col("is_candidate") != 0)).cast("int").alias("label_mask"),
        (F.col("length_px") / diagonal).alias("length_norm"), F.col("is_candidate").cast("double").alias("is_candidate"), *flags,
    )


def segment_edges(segments: DataFrame) -> DataFrame:
    """(sample_id, node_id, segment_id): segments that share a node are neighbours; pairs are not listed."""
    ends = segments.select("sample_id", "segment_id", F.explode(F.array("start_node", "end_node")).alias("node_id"))
    return ends.distinct().select("sample_id", "node_id", "segment_id")


def branch_features(groups: DataFrame, attachments: DataFrame, images: DataFrame, crowding: DataFrame) -> DataFrame:
    """Length, height, bud numbers and crowding of every group that is not a trunk.

    ``groups(sample_id, group_id, group_type, points, edges)``, ``attachments(sample_id, group_id,
    label)``, ``crowding(sample_id, group_id, crowding)``. The height is not turned upside down.
    """
    c = F.col
    per = attachments.filter("group_id IS NOT NULL").groupBy("sample_id", "group_id").agg(F.count(F.lit(1)).alias("buds"), F.count_if(c("label") == 0).alias("flowers"))
    j = groups.filter("group_type <> 'trunk'").select("sample_id", "group_id", g.group_length(c("points"), c("edges")).alias("length"), g.mean_point(c("points")).y.alias("cy"))
    j = j.join(per, ["sample_id", "group_id"], "left").join(crowding, ["sample_id", "group_id"], "left")
    j = attach_groups(j, images.select("sample_id", "width", "height"), ["sample_id"])
    diagonal = F.greatest(g.norm(c("width").cast("double"), c("height").cast("double")), F.lit(1.0))
    n = F.coalesce("buds", F.lit(0))
    return j.select(
        "sample_id", "group_id", (c("length") / diagonal).alias("branch_length_norm"), (c("cy") / F.greatest(c("height"), F.lit(1))).alias("relative_height"), n.alias("bud_count"),
        (n / F.greatest(c("length"), F.lit(1.0))).alias("bud_density"), F.when(n > 0, c("flowers") / n).alias("flower_bud_ratio"), F.coalesce("crowding", F.lit(0.0)).alias("local_crowding"),
    )


def region_features(segments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per (tree, view, group): mean and maximum of every column, label, counts by kind.

    A segment counts in each of its groups; ``trunk`` is no region.
    """
    names = F.filter(split_groups(F.col("group_ids")), lambda v: v != "trunk")
    long = segments.withColumn("group_id", F.explode(names))
    aggs = [
        F.min("sample_id").alias("sample_id"), F.min("split").alias("split"), F.max("is_cut_segment").alias("region_label"),
        F.count(F.lit(1)).alias("n_segments"), F.sum("is_cut_segment").alias("n_positive_segments"),
    ]
    for name in columns:
        aggs += [F.avg(name).alias(f"{name}_mean"), F.max(F.col(name).cast("double")).alias(f"{name}_max")]
    aggs += [F.count_if(F.col("candidate_type") == t).alias("cand_" + re.sub("--", "_", t)) for t in CANDIDATE_TYPES]
    return long.groupBy("tree_id", "view", "group_id").agg(*aggs)


def append_feature(df: DataFrame, values: DataFrame, keys: Sequence[str], name: str, default: float) -> DataFrame:
    """Add a column by key, ``default`` where nothing was measured."""
    return df.join(values.select(*keys, name), list(keys), "left").withColumn(name, F.coalesce(name, F.lit(default)))


def missing_keys(df: DataFrame, values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of ``values`` that are not in the table; must be empty before a column is appended."""
    return values.select(*keys).distinct().join(df.select(*keys), list(keys), "left_anti")


def mean_aspect(buds: DataFrame, keys: Sequence[str], label: int = 1) -> DataFrame:
    """Mean aspect ratio of the buds with ``label``."""
    return buds.filter(F.col("label") == label).groupBy(*keys).agg(F.avg("aspect_ratio").alias("mean_aspect"))


def neighbor_mean(features: DataFrame, segments: DataFrame, columns: Sequence[str], hops: int = 1) -> DataFrame:
    """Mean of the neighbours' columns, zero without neighbours; repeated for more hops."""
    keys = ["sample_id", "segment_id"]
    current = features.select(*keys, *columns)
    for _ in range(hops):
        joined = segments.select(*keys, "start_node", "end_node").join(current, keys)
        sums = neighbor_sums(joined, columns)
        current = sums.select(*keys, *[(F.col(f"sum_{v}") / F.greatest(F.col("neighbors"), F.lit(1))).alias(v) for v in columns])
    return current


def view_context(features: DataFrame, columns: Sequence[str], key: str = "sample_id") -> DataFrame:
    """The view's mean of every column next to the segment's own."""
    means = features.groupBy(key).agg(*[F.avg(v).alias(f"view_{v}") for v in columns])
    return attach_groups(features, means, [key])


def append_embedding(df: DataFrame, embeddings: DataFrame, keys: Sequence[str], dim: int) -> DataFrame:
    """Append a vector by key, zeros where there is none."""
    joined = df.join(embeddings.select(*keys, "embedding"), list(keys), "left")
    zeros = F.array_repeat(F.lit(0.0), dim)
    return joined.withColumn("embedding", F.coalesce(F.col("embedding").cast("array<double>"), zeros))


def standardize(df: DataFrame, columns: Sequence[str], train: Column) -> DataFrame:
    """Subtract the mean and divide by the sample deviation (at least 1e-6) of the training rows."""
    stats = df.agg(*[x for v in columns for x in (F.avg(F.when(train, F.col(v))).alias(f"_m_{v}"), F.stddev_samp(F.when(train, F.col(v))).alias(f"_s_{v}"))])
    joined = attach_scalars(df, stats)
    rest = [c for c in df.columns if c not in columns]
    return joined.select(*rest, *[((F.col(v) - F.col(f"_m_{v}")) / F.greatest(F.coalesce(f"_s_{v}", F.lit(0.0)), F.lit(1e-6))).alias(v) for v in columns])


def feature_sets(columns: Sequence[str], groups: Mapping[str, Sequence[str]], ablations: Mapping[str, Sequence[str]]) -> tuple[dict[str, list[str]], dict[str, list[str]]]:
    """Columns of every ablation (groups less the removed ones) and the columns that are missing."""
    there = set(columns)
    present = {k: [c for c in v if c in there] for k, v in groups.items()}
    if not any(present.values()):
        raise ValueError("no feature column is present")
    sets = {name: [c for k, v in present.items() if k not in removed for c in v] for name, removed in ablations.items()}
    return {k: v for k, v in sets.items() if v}, {k: [c for c in v if c not in there] for k, v in groups.items()}


def attachment_stats(attachments: DataFrame) -> DataFrame:
    """Per sample: buds, attached, by method, mean distance of the attached."""
    a = F.col("segment_id").isNotNull()
    return attachments.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("buds"), F.count_if(a).alias("attached"), F.count_if(~a).alias("unattached"),
        (F.count_if(a) / F.count(F.lit(1))).alias("attachment_rate"), F.avg(F.when(a, F.col("distance"))).alias("mean_distance"),
    )


def apply_overlay(segments: DataFrame, active_cuts: DataFrame, assignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Manual labels over automatic ones, and what is wrong with the manual labels.

    ``active_cuts(sample_id, cut_id)``, ``assignments(sample_id, cut_id, segment_id)``: they must
    name exactly the active cuts, and a segment may take one cut. A chosen context segment becomes
    a candidate.
    """
    cut = ["sample_id", "cut_id"]
    marked = active_cuts.select(*cut, F.lit(1).alias("active"), F.lit(0).alias("assigned")).unionByName(assignments.select(*cut, F.lit(0).alias("active"), F.lit(1).alias("assigned")))
    per_cut = marked.groupBy(*cut).agg(F.sum("active").alias("active"), F.sum("assigned").alias("assigned"))
    problems = per_cut.select(
        "sample_id", F.col("cut_id").alias("item"),
        F.when(F.col("assigned") == 0, "unassigned_cut").when(F.col("active") == 0, "inactive_cut").when(F.col("assigned") > 1, "cut_assigned_twice").alias("problem"),
    ).filter("problem IS NOT NULL")
    taken = assignments.groupBy("sample_id", "segment_id").agg(F.count(F.lit(1)).alias("cuts"), F.min("cut_id").alias("cut_id"))
    twice = taken.filter("cuts > 1").select("sample_id", F.col("segment_id").cast("string").alias("item"), F.lit("segment_with_several_cuts").alias("problem"))
    joined = segments.join(taken, ["sample_id", "segment_id"], "left")
    chosen = F.col("cuts").isNotNull()
    labelled = joined.select(
        *[c for c in segments.columns if c not in ("is_cut_segment", "is_candidate", "label_mask")], chosen.cast("int").alias("is_cut_segment"),
        F.when(chosen, 1).otherwise(F.col("is_candidate")).alias("is_candidate"), F.when(chosen, 1).otherwise(F.col("is_candidate")).alias("label_mask"), "cut_id",
    )
    return labelled, problems.withColumn("item", F.col("item").cast("string")).unionByName(twice)
