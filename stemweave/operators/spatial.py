"""Points, lines and boxes of a sample brought together.

Edges are rows ``(sample_id, segment_id, x0, y0, x1, y1)``; points are rows with ``px, py``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.functions.geometry import EPSILON, norm
from stemweave.plans.durable import written
from stemweave.plans.grid import GROWTH, as_edges, crossings, met, nearest, nearest_within, parted, within
from stemweave.plans.skew import attach_groups, running_totals
from stemweave.plans.slices import LIMIT, fit_whole, in_tasks

S = ["sample_id"]
FAR = 1 << 20  # coordinates of samples whose points and pixels meet in one task are smaller


def _back(points: DataFrame, hits: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Give every point row the hit of its coordinates; many points may share one spot."""
    return attach_groups(points, hits, [*keys, "px", "py"], how)


def assign_nearest(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Nearest segment of the sample, lowest id on ties; points without one stay with nulls."""
    hits = nearest(points, edges, S, radius, ["segment_id"])
    return _back(points, hits, S)


def assign_in_group(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Nearest segment among those of the point's own group.

    ``points`` carry ``group_id``; ``edges`` carry ``group_ids ARRAY`` (an edge counts in each).
    """
    owned = edges.withColumn("group_id", F.explode("group_ids")).drop("group_ids")
    keys = ["sample_id", "group_id"]
    return _back(points, nearest(points, owned, keys, radius, ["segment_id"]), keys)


def assign_points(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Nearest segment of the own group; where no segment has that group, the nearest of all.

    Points without coordinates come back unattached.
    """
    owned = edges.withColumn("group_id", F.explode("group_ids")).drop("group_ids")
    known = owned.select("sample_id", "group_id").distinct()
    placed = points.filter("px IS NOT NULL AND py IS NOT NULL")
    in_group = placed.join(known, ["sample_id", "group_id"], "left_semi")
    others = placed.join(known, ["sample_id", "group_id"], "left_anti")
    a = _back(in_group, nearest(in_group, owned, ["sample_id", "group_id"], radius, ["segment_id"]), ["sample_id", "group_id"])
    b = _back(others, nearest(others, edges, S, radius, ["segment_id"]), S)
    lost = points.filter("px IS NULL OR py IS NULL")
    return (
        a.withColumn("group_matched", F.lit(True))
        .unionByName(b.withColumn("group_matched", F.lit(False)))
        .unionByName(lost, allowMissingColumns=True)
    )


def snap_points(
    points: DataFrame, edges: DataFrame, vertices: DataFrame, line_radius: float = 15.0, vertex_radius: float = 12.0, in_group: bool = False, skip_first: bool = False
) -> DataFrame:
    """Snap to the nearest vertex within its radius, else to the nearest line within its radius.

    ``in_group`` looks only at lines and vertices of the point's ``group_id``, which all three tables carry then;
    ``skip_first`` leaves out the vertices with ``pos`` 0, by which a group hangs on its parent.
    """
    keys = [*S, "group_id"] if in_group else S
    if skip_first:
        vertices = vertices.filter("pos > 0")
    v = nearest_within(points, as_edges(vertices, "x", "y"), keys, vertex_radius, ["vertex_id"]).select(
        *keys, "px", "py", F.col("vertex_id"), F.col("fx").alias("vx"), F.col("fy").alias("vy"), F.col("distance").alias("vertex_distance")
    )
    e = nearest_within(points, edges, keys, line_radius, ["segment_id"]).select(
        *keys, "px", "py", "segment_id", "fx", "fy", F.col("distance").alias("line_distance")
    )
    joined = _back(_back(points, v, keys), e, keys)
    to_vertex = F.col("vertex_id").isNotNull()
    return joined.select(
        *points.columns,
        F.when(to_vertex, "vertex").when(F.col("segment_id").isNotNull(), "line").otherwise("none").alias("snapped_to"),
        F.coalesce("vx", "fx", "px").alias("sx"), F.coalesce("vy", "fy", "py").alias("sy"),
        F.coalesce("vertex_distance", "line_distance").alias("snap_distance"),
    )


def local_crowding(centroids: DataFrame, radius: float) -> DataFrame:
    """1 / max(distance to the nearest other centroid, 1); zero for a single group.

    Centroids on the same spot have distance zero; the others look for a different spot.
    """
    spots = centroids.groupBy("sample_id", "px", "py").agg(F.count(F.lit(1)).alias("here"))
    away = _nearest_other(spots.select("sample_id", "px", "py"), radius)
    d = F.when(F.col("here") > 1, 0.0).otherwise(F.col("other_distance"))
    per_spot = spots.join(away, ["sample_id", "px", "py"], "left").select(
        "sample_id", "px", "py", F.coalesce(1.0 / F.greatest(d, F.lit(1.0)), F.lit(0.0)).alias("crowding")
    )
    return attach_groups(centroids, per_spot, ["sample_id", "px", "py"])


def _nearest_other(spots: DataFrame, radius: float) -> DataFrame:
    """Distance to the nearest different spot, in widening rounds."""
    from functools import reduce

    from stemweave.plans.durable import written
    from stemweave.plans.grid import GROWTH, MAX_ROUNDS

    several = spots.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("sample_id")
    every = written(spots.join(several, "sample_id", "left_semi"), "centroids")
    edges = as_edges(every, "px", "py")
    pending, found = every, []
    for _ in range(MAX_ROUNDS):
        hits = written(
            within(pending, edges, S, radius)
            .filter((F.col("px") != F.col("x0")) | (F.col("py") != F.col("y0")))
            .groupBy("sample_id", "px", "py").agg(F.min("distance").alias("other_distance")),
            "hits",
        )
        found.append(hits)
        pending = written(pending.join(hits, ["sample_id", "px", "py"], "left_anti"), "centroids")
        if not pending.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        radius *= GROWTH
    raise RuntimeError("nearest other: spots left after the widest round")


def infer_parent(groups: DataFrame, edges: DataFrame, radius: float = 12.0) -> DataFrame:
    """The other group nearest to a group's first point, if within ``radius``.

    ``groups(sample_id, group_id, px, py)`` holds the first points, ``edges`` carry ``group_id``.
    """
    target = edges.withColumnRenamed("group_id", "parent_id")
    pairs = within(groups, target, S, radius).filter(F.col("parent_id") != F.col("group_id"))
    best = pairs.groupBy("sample_id", "group_id").agg(F.min(F.struct("distance", "parent_id")).alias("b"))
    return groups.join(best, ["sample_id", "group_id"], "left").select(
        "sample_id", "group_id", F.col("b.parent_id").alias("parent_id"), F.col("b.distance").alias("distance")
    )


def choose_anchor(vertices: DataFrame, parents: DataFrame, radius: float) -> DataFrame:
    """Vertex of each group nearest to its parent's points; the lowest vertex without a parent.

    ``vertices(sample_id, group_id, parent_id?, pos, px, py)``, ``parents(sample_id, parent_id, x, y)``.
    """
    keys = ["sample_id", "parent_id"]
    near = nearest(vertices.filter("parent_id IS NOT NULL"), as_edges(parents, "x", "y"), keys, radius, [], [])
    joined = attach_groups(vertices, near.select(*keys, "px", "py", "distance"), [*keys, "px", "py"], "left")
    return joined.groupBy("sample_id", "group_id").agg(
        F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "pos"))).alias("n"),
        F.max(F.struct(F.col("py"), (-F.col("pos")).alias("neg"))).alias("l"),
    ).select("sample_id", "group_id", F.coalesce("n.pos", -F.col("l.neg")).alias("anchor_pos"), F.col("n.distance").alias("distance"))


def nearest_oriented_edge(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """Nearest edge with its tangent turned away from the root.

    ``edges`` carry ``root_dist0`` and ``root_dist1``, the distances of both ends from the root.
    """
    away = F.col("root_dist1") >= F.col("root_dist0")
    length = norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    sign = F.when(away, 1.0).otherwise(-1.0)
    turned = edges.withColumns({
        "tx": F.when(length > 0, sign * (F.col("x1") - F.col("x0")) / length).otherwise(0.0),
        "ty": F.when(length > 0, sign * (F.col("y1") - F.col("y0")) / length).otherwise(0.0),
    })
    return _back(points, nearest(points, turned, S, radius, ["segment_id"], ["tx", "ty"]), S)


def root_projection(roots: DataFrame, trunk: DataFrame, radius: float) -> DataFrame:
    """Arc position of every group root on its sample's trunk, the last root and the extension.

    ``roots(sample_id, group_id, px, py)``; ``trunk`` edges carry ``arc`` (length before the edge)
    and ``length_px`` of the whole trunk.
    """
    edges = trunk.withColumn("edge_length", norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).withColumn("segment_id", F.col("pos"))
    hits = _back(roots, nearest(roots, edges, S, radius, ["segment_id"], ["arc", "edge_length", "length_px"]), S, "inner")
    placed = hits.select("sample_id", "group_id", "distance", "length_px", (F.col("arc") + F.col("fraction") * F.col("edge_length")).alias("root_arc"))
    last = placed.groupBy("sample_id").agg(F.max("root_arc").alias("last_root_arc"))
    return attach_groups(placed, last, S).withColumn(
        "extension_ratio", F.when(F.col("length_px") > 0, (F.col("length_px") - F.col("last_root_arc")) / F.col("length_px")).otherwise(0.0)
    )


def attach_points(
    points: DataFrame, pixels: DataFrame, components: DataFrame, edges: DataFrame,
    spur: float = 80.0, snap: float = 12.0, min_pixels: int = 64, fallback_group: bool = True,
) -> DataFrame:
    """Attach points to line pixels: own component first, then any within ``spur``, then a group.

    ``points(sample_id, bud_index, px, py, component_label, support_state?)``,
    ``pixels(sample_id, component_label, x, y)``, ``components(sample_id, component_label, size)``,
    ``edges`` carry ``group_id``. Components below ``min_pixels`` do not count; points in state
    ``background_reject`` stay out.
    """
    usable = components.filter(F.col("size") >= min_pixels).select("sample_id", "component_label").withColumn("_ok", F.lit(True))
    rejected = F.coalesce(F.col("support_state") == "background_reject", F.lit(False))
    seen = points.join(usable, ["sample_id", "component_label"], "left").withColumn(
        "component_label", F.when(~rejected & F.col("_ok").isNotNull(), F.col("component_label")).otherwise(-1)
    ).drop("_ok")
    live = seen.filter(~rejected)
    px = as_edges(pixels.select("sample_id", "component_label", "x", "y").distinct(), "x", "y")
    own = nearest_within(live.filter("component_label > 0"), px, ["sample_id", "component_label"], spur, ["y0", "x0"])
    own = own.select("sample_id", "component_label", "px", "py", F.struct("distance", F.col("fx").alias("x"), F.col("fy").alias("y")).alias("own"))
    rest = attach_groups(live, own, ["sample_id", "component_label", "px", "py"], "left")
    wide = nearest_within(rest.filter("own IS NULL"), px.drop("component_label").distinct(), S, spur, ["y0", "x0"])
    wide = wide.select("sample_id", "px", "py", F.struct("distance", F.col("fx").alias("x"), F.col("fy").alias("y")).alias("any"))
    placed = attach_groups(rest, wide, ["sample_id", "px", "py"], "left")
    spot = F.coalesce("own", F.when(F.col("own").isNull(), F.col("any")))
    method = F.when(F.col("own.distance") <= snap, "component_snap").when(F.col("own").isNotNull(), "component").when(F.col("any").isNotNull(), "fallback").otherwise("none")
    attached = placed.select(*points.columns, spot.alias("spot"), method.alias("attachment_method")).unionByName(
        seen.filter(rejected).select(*points.columns, F.lit("rejected").alias("attachment_method")), allowMissingColumns=True
    )
    flat = attached.select(
        *[c for c in points.columns if c not in ("px", "py")], F.col("px").alias("bud_x"), F.col("py").alias("bud_y"),
        F.col("spot.x").alias("px"), F.col("spot.y").alias("py"), F.col("spot.distance").alias("attach_distance"), "attachment_method",
    )
    grouped = flat.filter("px IS NOT NULL") if fallback_group else flat.filter("px IS NOT NULL AND attachment_method <> 'fallback'")
    owner = nearest(grouped, edges, S, snap, ["group_id"]).select("sample_id", "px", "py", "group_id")
    asked = F.col("px").isNotNull() & (F.lit(fallback_group) | (F.col("attachment_method") != "fallback"))
    return attach_groups(flat, owner, ["sample_id", "px", "py"], "left").withColumn("group_id", F.when(asked, F.col("group_id"))).withColumnsRenamed(
        {"px": "skeleton_x", "py": "skeleton_y"}
    )


def arm_evidence(arms: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Points near each arm: how many, how dense, how well aligned, how far along, and which way they vote.

    ``arms(sample_id, arm_id, pos, x0, y0, x1, y1)`` are the edges of the arms in walking direction,
    ``points(sample_id, point_id, px, py, vx, vy, weight)``. An arm's direction is its chord, from its first to its last
    vertex; density is points per pixel of the chord (0 without one), alignment the mean size of the cosine to it. Progress
    is the mean share of the arm's length at the points' nearest vertices. A point votes for the arm's direction with its
    weight times what its cosine has above 0.15; the confidence is the sum of these weights over 1.5, 1 at most.
    """
    c = F.col
    keys = ["sample_id", "arm_id"]
    walked = written(running_totals(arms, keys, [c("pos")], {"at": norm(c("x1") - c("x0"), c("y1") - c("y0"))}, whole={"length_px": "at"}), "walked")
    ends = walked.groupBy(*keys).agg(F.first("length_px").alias("length_px"), F.min(F.struct("pos", "x0", "y0")).alias("a"), F.max(F.struct("pos", "x1", "y1")).alias("b"))
    dx, dy = c("b.x1") - c("a.x0"), c("b.y1") - c("a.y0")
    chords = written(ends.select(*keys, "length_px", norm(dx, dy).alias("chord_px"), dx.alias("dx"), dy.alias("dy"), c("a.x0").alias("x"), c("a.y0").alias("y")), "chords")
    pairs = written(within(points, arms, S, radius).select(*keys, "point_id", "px", "py", "vx", "vy", "weight").distinct(), "pairs")
    vertices = walked.select(*keys, c("x1").alias("x"), c("y1").alias("y"), "at").unionByName(chords.select(*keys, "x", "y", F.lit(0.0).alias("at")))
    reached = nearest(pairs, as_edges(vertices), keys, radius, ["at"]).select(*keys, "px", "py", "at")
    seen = attach_groups(pairs, reached, [*keys, "px", "py"]).join(chords.drop("x", "y"), keys)
    size = norm(c("vx"), c("vy")) * c("chord_px")
    cosine = F.when(size > 0, (c("vx") * c("dx") + c("vy") * c("dy")) / size).otherwise(0.0)
    vote = c("weight") * F.greatest(F.abs("cosine") - 0.15, F.lit(0.0))
    per = seen.withColumn("cosine", cosine).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.avg(F.abs("cosine")).alias("mean_alignment"), F.avg(c("at") / F.greatest("length_px", F.lit(1e-6))).alias("progress"),
        F.sum(vote * F.signum("cosine")).alias("_signed"), F.sum(vote).alias("_votes"),
    )
    n, zero = F.coalesce("points", F.lit(0)), F.lit(0.0)
    return chords.join(per, keys, "left").select(
        *keys, "length_px", "chord_px", n.alias("points"), F.when(c("chord_px") < 1e-6, 0.0).otherwise(n / c("chord_px")).alias("density"), "mean_alignment",
        F.coalesce("progress", F.lit(0.5)).alias("terminal_progress"), F.when(c("_votes") > 0, c("_signed") / F.greatest("_votes", F.lit(1e-6))).otherwise(0.0).alias("flow_vote"),
        F.least(F.coalesce(c("_votes") / 1.5, zero), F.lit(1.0)).alias("flow_confidence"),
    )


def counted_of(hits: str, merge: float) -> Column:
    """The distances of the hits that count, from hits (pos, d) in order: those farther than ``merge`` from all before them."""
    none = F.array().cast("array<double>")
    return F.aggregate(hits, none, lambda kept, h: F.when(F.exists(kept, lambda k: F.abs(k - h.d) <= merge), kept).otherwise(F.array_append(kept, h.d)))


def map_cuts(cuts: DataFrame, edges: DataFrame, segments: DataFrame, cell: float = 32.0, merge: float = 1.0) -> DataFrame:
    """Which segments a cut line crosses and whether one of them is meant.

    ``cuts(sample_id, cut_id, ax0, ay0, ax1, ay1)``, ``edges(sample_id, segment_id, pos, x0..y1)``,
    ``segments(sample_id, segment_id, is_candidate, start_landmark_id, end_landmark_id)``. Along a polyline a hit within
    ``merge`` of one that counts already is the same hit. The hits that count, in order of segment and position, form one
    cluster when none is farther than ``merge`` from the first.
    """
    keys = ["sample_id", "cut_id"]
    length = norm(F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0"))
    along = norm(F.col("hit.x") - F.col("ax0"), F.col("hit.y") - F.col("ay0"))
    hits = crossings(cuts, edges, S, cell).withColumn("along", F.when(length > 0, along).otherwise(0.0)).select(*keys, "segment_id", "pos", "along")
    first = hits.groupBy(*keys).agg(F.min(F.struct("segment_id", "pos", "along")).alias("f")).select(*keys, F.col("f.along").alias("start"))
    placed = attach_groups(hits, first, keys).withColumn("d", F.col("along") - F.col("start"))
    # beyond twice the distance a hit counts, or one that does and is too far as well took it in
    close = F.array_sort(F.collect_list(F.when(F.abs("d") <= 2 * merge, F.struct("pos", "d"))))
    per_segment = placed.groupBy(*keys, "segment_id").agg(close.alias("close"), F.max(F.abs("d")).alias("most")).select(
        *keys, "segment_id", ((F.col("most") > 2 * merge) | F.exists(counted_of("close", merge), lambda k: F.abs(k) > merge)).alias("apart"))
    known = per_segment.join(segments, ["sample_id", "segment_id"])
    chosen = F.col("is_candidate") == 1
    per_cut = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("intersected"), F.count_if(chosen).alias("candidates"), F.min(F.when(chosen, F.col("segment_id"))).alias("candidate"),
        F.bool_or("apart").alias("apart"),
    )
    ends = known.filter(chosen).select(*keys, "segment_id", F.explode(F.array_distinct(F.array("start_landmark_id", "end_landmark_id"))).alias("landmark"))
    common = ends.groupBy(*keys, "landmark").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max("n").alias("at_one_landmark"))
    joined = cuts.select(*keys).join(per_cut, keys, "left").join(common, keys, "left")
    single = ~F.col("apart")
    n, m = F.coalesce("intersected", F.lit(0)), F.coalesce("candidates", F.lit(0))
    status = (
        F.when(n == 0, "non_intersection").when(m == 0, "context_only").when(single & (m == 1), "unique_candidate")
        .when(single & (F.col("at_one_landmark") == m), "shared_landmark_ambiguous").otherwise("multiple_physical_crossings")
    )
    return joined.select(*keys, status.alias("status"), n.alias("intersected"), m.alias("candidates"), F.when(status == "unique_candidate", F.col("candidate")).alias("suggested_segment_id"))


def least_foot(ax0, ay0, ax1, ay1, x0, y0, x1, y1) -> np.ndarray:
    """Least distance of an end of two segments to the other one, as ``project_point`` has it."""
    def foot(px, py, qx, qy, rx, ry):
        dx, dy = rx - qx, ry - qy
        square = dx * dx + dy * dy
        long = square > EPSILON
        f = np.where(long, np.clip(((px - qx) * dx + (py - qy) * dy) / np.where(long, square, 1.0), 0.0, 1.0), 0.0)
        u, v = px - (qx + f * dx), py - (qy + f * dy)
        return np.sqrt(u * u + v * v)

    line, edge = (ax0, ay0, ax1, ay1), (x0, y0, x1, y1)
    return np.minimum.reduce([foot(*line[:2], *edge), foot(*line[2:], *edge), foot(*edge[:2], *line), foot(*edge[2:], *line)])


def nearest_segments(lines: DataFrame, edges: DataFrame, radius: float, crossed: DataFrame | None = None) -> DataFrame:
    """(sample_id, cut_id, segment_id, distance): the segment nearest to every line ``(ax0, ay0, ax1, ay1)``, whole line against whole
    edge, the lowest id on ties (distances count to 1e-9); lines of samples without edges are left out.

    The nearest points of two segments that don't cross are an end of one of them; ``crossed(sample_id, cut_id, segment_id)``
    has those that do, if they are known. Where a sample has few edges, the ends of every pair are projected; elsewhere ends are searched within a radius on both sides, and lines without a hit go to the
    next, eight times wider round, as in ``nearest``.
    """
    keys = ["sample_id", "cut_id"]
    asked = written(lines.select(*keys, "ax0", "ay0", "ax1", "ay1"), "lines")
    target = written(edges.select("sample_id", "segment_id", "x0", "y0", "x1", "y1"), "edges")
    few, many = parted(asked, target, S)
    if crossed is None:
        crossed = crossings(asked, target, S, radius)
    touched = crossed.select(*keys, F.lit(0.0).alias("distance"), "segment_id")
    names = ["ax0", "ay0", "ax1", "ay1", "x0", "y0", "x1", "y1"]
    kinds = ", ".join(f"{n} {t}" for n, t in few.join(target, "sample_id").select(*keys, "segment_id").dtypes)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = [batch.column(3 + i).to_numpy(zero_copy_only=False) for i in range(8)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(least_foot(*ends), from_pandas=True)], names=[*keys, "segment_id", "distance"])

    sides = met(few, target, S).select(*keys, "segment_id", *[F.col(n).cast("double").alias(n) for n in names])
    pairs = sides.mapInArrow(apart, kinds + ", distance double").filter("distance IS NOT NULL").select(*keys, "distance", "segment_id")
    # rounding goes through decimals, so pairs are ordered by a whole number of 1e-9 and only the least distance is rounded
    order = F.struct(F.rint(F.col("distance") * 1e9).alias("step"), "segment_id")
    best = lambda near: near.groupBy(*keys).agg(F.min(order).alias("b"), F.min("distance").alias("d")).select(*keys, "b.segment_id", F.round("d", 9).alias("distance"))
    if many is None:
        return best(pairs.unionByName(touched))
    found = [best(pairs.unionByName(touched.join(many[0].select(*keys), keys, "left_anti")))]
    spots = F.explode(F.array(F.struct(F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.col("x1").alias("px"), F.col("y1").alias("py"))))
    target = written(many[1], "edges")
    pending = many[0].select(*keys, F.col("ax0").alias("x0"), F.col("ay0").alias("y0"), F.col("ax1").alias("x1"), F.col("ay1").alias("y1"))
    pending = written(pending.join(target.select("sample_id").distinct(), "sample_id", "left_semi"), "lines")
    ends = written(target.withColumn("p", spots).select("sample_id", "segment_id", "p.px", "p.py").distinct(), "ends")
    near: DataFrame | None = touched.join(many[0].select(*keys), keys, "left_semi")
    while not pending.isEmpty():
        own = within(pending.withColumn("p", spots).select(*keys, "p.px", "p.py"), target, S, radius).select(*keys, "distance", "segment_id")
        other = within(ends, pending, S, radius).select(*keys, "distance", "segment_id")
        hits = written(best(own.unionByName(other) if near is None else own.unionByName(other).unionByName(near)), "hits")
        found.append(hits)
        pending, near = written(pending.join(hits.select(*keys), keys, "left_anti"), "lines"), None
        radius *= GROWTH
    return reduce(DataFrame.unionByName, found)


def label_cuts(cuts: DataFrame, edges: DataFrame, segments: DataFrame, radius: float, cell: float = 32.0) -> tuple[DataFrame, DataFrame]:
    """Every cut with its status and nearest segment, and every crossed segment of a cut with its pruned end.

    ``cuts(sample_id, cut_id, ax0, ay0, ax1, ay1, nx, ny)`` with the normal of the pruned side,
    ``segments(sample_id, segment_id, start_node, start_x, start_y, end_node, end_x, end_y, distal_node)``. A cut that crosses one
    segment is ``exact``, several ``ambiguous``, none ``nonintersecting``; the nearest segment is named in any case. Of a crossed
    segment the end farther along the normal, seen from the cut's middle, is pruned (the start on ties), and it is said
    whether that is its distal end.
    """
    crossed = crossed_segments(cuts, edges, cell)
    return match_cuts(cuts, edges, crossed, radius), check_cuts(cuts, segments, crossed)


def crossed_segments(cuts: DataFrame, edges: DataFrame, cell: float = 32.0) -> DataFrame:
    """(sample_id, cut_id, segment_id, intersections) of the segments that a cut crosses."""
    keys = ["sample_id", "cut_id"]
    lines = cuts.select(*keys, "ax0", "ay0", "ax1", "ay1")
    hits = crossings(lines, edges.select("sample_id", "segment_id", "x0", "y0", "x1", "y1"), S, cell)
    return written(hits.groupBy(*keys, "segment_id").agg(F.count(F.lit(1)).alias("intersections")), "crossed")


def match_cuts(cuts: DataFrame, edges: DataFrame, crossed: DataFrame, radius: float) -> DataFrame:
    """The first table of ``label_cuts``."""
    keys = ["sample_id", "cut_id"]
    count = crossed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    near = nearest_segments(cuts, edges, radius, crossed).withColumnRenamed("segment_id", "nearest_segment_id").withColumnRenamed("distance", "nearest_distance_px")
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 1, "exact").when(n > 1, "ambiguous").otherwise("nonintersecting")
    return cuts.select(*keys).join(count, keys, "left").join(near, keys, "left").select(*keys, status.alias("status"), n.alias("candidates"), "nearest_segment_id", "nearest_distance_px")


def check_cuts(cuts: DataFrame, segments: DataFrame, crossed: DataFrame) -> DataFrame:
    """The second table of ``label_cuts``, which needs no nearest segment."""
    keys = ["sample_id", "cut_id"]
    middle = cuts.select(*keys, "nx", "ny", ((F.col("ax0") + F.col("ax1")) / 2).alias("mx"), ((F.col("ay0") + F.col("ay1")) / 2).alias("my"))
    dot = lambda end: F.col("nx") * (F.col(f"{end}_x") - F.col("mx")) + F.col("ny") * (F.col(f"{end}_y") - F.col("my"))
    checks = crossed.join(middle, keys).join(segments, ["sample_id", "segment_id"]).withColumns({"start_dot": dot("start"), "end_dot": dot("end")})
    pruned = F.when(F.col("start_dot") >= F.col("end_dot"), F.col("start_node")).otherwise(F.col("end_node"))
    one = crossed.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select(*keys, F.lit(True).alias("_one"))
    checks = checks.join(one, keys, "left")
    return checks.select(*keys, "segment_id", "intersections", F.coalesce("_one", F.lit(False)).alias("exact"), "start_dot", "end_dot", pruned.alias("pruned_node"), (pruned == F.col("distal_node")).alias("direction_consistent"))


# --- boxes, tiles, components ---------------------------------------------------------------------


def tile_grid(images: DataFrame, size: int = 256, stride: int = 128) -> DataFrame:
    """Tiles of every image, the last ones pushed back to the border."""
    starts = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col(n) - size) / stride), F.lit(0)) * stride, F.lit(stride).cast("long"))
    place = lambda v, n: F.greatest(F.least(F.col(v), F.col(n) - size), F.lit(0))
    tiles = images.withColumn("ty", F.explode(starts("height"))).withColumn("tx", F.explode(starts("width")))
    x, y = place("tx", "width"), place("ty", "height")
    return tiles.select(
        "sample_id", x.alias("x1"), y.alias("y1"), F.least(x + size, F.col("width")).alias("x2"), F.least(y + size, F.col("height")).alias("y2")
    ).distinct()


def drop_blank_tiles(tiles: DataFrame, blanks: DataFrame, share: float = 0.8, size: int = 256) -> DataFrame:
    """Leave out tiles whose blank share ``blanks(sample_id, x1, y1, blank_pixels)`` of a full tile is too high."""
    joined = tiles.join(blanks, ["sample_id", "x1", "y1"], "left")
    return joined.filter(F.coalesce("blank_pixels", F.lit(0)) / (size * size) <= share).select(*tiles.columns)


def classify_support(df: DataFrame, min_overlap: float = 0.2, mask_limit: float = 12.0, edge_limit: float = 24.0) -> DataFrame:
    """supported, border_candidate or background_reject from overlap, mask and border distance."""
    near = (F.col("overlap") >= min_overlap) | (F.col("mask_distance") <= mask_limit)
    state = F.when(near, "supported").when(F.col("edge_distance") <= edge_limit, "border_candidate").otherwise("background_reject")
    return df.withColumn("support_state", state)


def extension_evidence(df: DataFrame, min_score: float = 0.5, need: int = 2) -> DataFrame:
    """Whether a sample has enough confident border candidates to extend its region."""
    good = (F.col("support_state") == "border_candidate") & (F.col("score") >= min_score)
    return df.groupBy("sample_id").agg(F.count_if(good).alias("border_candidates")).withColumn("extend", F.col("border_candidates") >= need)


def aligned_components(root: DataFrame, components: DataFrame, limit: float) -> DataFrame:
    """Components below the root's box: vertical gap in (0, limit], horizontal gap at most limit.

    ``root`` has one row per sample ``(sample_id, x1, x2, y2)``.
    """
    r = root.select("sample_id", F.col("x1").alias("rx1"), F.col("x2").alias("rx2"), F.col("y2").alias("ry2"))
    joined = attach_groups(components, r, S)
    down = F.col("y1") - F.col("ry2")
    side = F.greatest(F.col("rx1") - F.col("x2"), F.col("x1") - F.col("rx2"), F.lit(0))
    return joined.withColumns({"vertical_gap": down, "horizontal_gap": side}).filter((down > 0) & (down <= limit) & (side <= limit)).drop("rx1", "rx2", "ry2")


def nearest_component(points: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """Component with most pixels in the square window of a point, smallest label on ties.

    Samples that fit a task meet there, rows of points and pixels dealt once; bigger ones and those with missing values or far
    coordinates meet by cells.
    """
    whole_numbers = {"tinyint", "smallint", "int", "bigint"}
    types = dict(pixels.dtypes)
    if not {dict(points.dtypes)[k] for k in ("px", "py")} | {types[k] for k in ("x", "y", "component_label")} <= whole_numbers or points.schema["sample_id"].dataType != pixels.schema["sample_id"].dataType:
        return _component_by_cells(points, pixels, radius)
    pixels = written(pixels.select("sample_id", "component_label", "x", "y").filter("sample_id IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL"), "pixels")
    here = points.withColumns({"_kind": F.lit(0), "_x": F.col("px").cast("long"), "_y": F.col("py").cast("long"), "_label": F.lit(0).cast("long")})
    there = pixels.select("sample_id", F.lit(1).alias("_kind"), F.col("x").cast("long").alias("_x"), F.col("y").cast("long").alias("_y"), F.col("component_label").cast("long").alias("_label"))
    far = lambda v: F.col(v).isNull() | ~F.col(v).between(radius - FAR, FAR - radius)
    whole, others = fit_whole(here.unionByName(there, allowMissingColumns=True), S, LIMIT, far("_x") | far("_y") | F.col("_label").isNull())
    schema = ", ".join([f"`{k}` {t}" for k, t in points.dtypes] + ["component_label long", "votes long"])
    solved = in_tasks(whole, S, [F.col("_kind")], _local_votes(points.columns, radius), schema).withColumn("component_label", F.col("component_label").cast(types["component_label"]))
    if others is None:
        return solved
    others = written(others, "others")
    spots = others.filter("_kind = 0").select(*points.columns)
    areas = others.filter("_kind = 1").select("sample_id", F.col("_label").cast(types["component_label"]).alias("component_label"), F.col("_x").alias("x"), F.col("_y").alias("y"))
    return solved.unionByName(_component_by_cells(spots, areas, radius))


def _local_votes(columns: Sequence[str], radius: int):
    """For ``in_tasks``: the points (kind 0) of whole samples with the label that most pixels (kind 1) of their windows have.

    Pixels stand by (sample, x, y), so a window is one stretch of them per x.
    """

    def solve(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        kind, x, y, label = (table.column(k).to_numpy() for k in ("_kind", "_x", "_y", "_label"))
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        place = lambda g, x, y: ((g * 2 * FAR) + x + FAR) * 2 * FAR + y + FAR
        rows, dots = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        spot, back = np.unique(place(group[rows], x[rows], y[rows]), return_inverse=True)
        known = place(group[dots], x[dots], y[dots])
        order = np.argsort(known, kind="stable")
        known, (names, code) = known[order], np.unique(label[dots][order], return_inverse=True)
        side = np.arange(-radius, radius + 1) * 2 * FAR
        low = np.searchsorted(known, spot[:, None] + side - radius, "left")
        many = np.searchsorted(known, spot[:, None] + side + radius, "right") - low
        best, votes = np.full(len(spot), -1), np.zeros(len(spot), dtype=np.int64)
        total = np.cumsum(many.sum(axis=1))
        begin = 0
        while begin < len(spot):  # as many windows at once as hold about a million pixels
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + 1_000_000, "right")))
            n = many[begin:end].ravel()
            at = np.repeat(low[begin:end].ravel() - np.cumsum(n) + n, n) + np.arange(n.sum())
            of = np.repeat(np.repeat(np.arange(begin, end), many.shape[1]), n)
            pair, count = np.unique(of * max(len(names), 1) + code[at], return_counts=True)
            which, what = np.divmod(pair, max(len(names), 1))
            first = np.lexsort((what, -count, which))
            first = first[np.flatnonzero(np.diff(which[first], prepend=-1))]
            best[which[first]], votes[which[first]] = what[first], count[first]
            begin = end
        none = (best < 0)[back]
        found = pa.array(np.append(names, 0)[best][back], mask=none)
        return pa.Table.from_arrays([*[table.column(k).take(pa.array(rows)) for k in columns], found, pa.array(votes[back], mask=none)], names=[*columns, "component_label", "votes"])

    return solve


def _component_by_cells(points: DataFrame, pixels: DataFrame, radius: int) -> DataFrame:
    """A pixel reaches the points of the 3x3 cells around it; only counts per label leave the join."""
    size = 2 * radius + 1
    cell = lambda v: F.floor(v / size).cast("long")
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    spots = points.select("sample_id", "px", "py").distinct()
    spread = spots.withColumn("d", near).select("sample_id", "px", "py", (cell(F.col("px")) + F.col("d.a")).alias("cx"), (cell(F.col("py")) + F.col("d.b")).alias("cy"))
    px = pixels.select("sample_id", "component_label", "x", "y", cell(F.col("x")).alias("cx"), cell(F.col("y")).alias("cy"))
    inside = (F.abs(F.col("px") - F.col("x")) <= radius) & (F.abs(F.col("py") - F.col("y")) <= radius)
    votes = spread.join(px, ["sample_id", "cx", "cy"]).filter(inside).groupBy("sample_id", "px", "py", "component_label").agg(F.count(F.lit(1)).alias("votes"))
    best = votes.groupBy("sample_id", "px", "py").agg(F.max(F.struct("votes", (-F.col("component_label")).alias("neg"))).alias("b"))
    return _back(points, best.select("sample_id", "px", "py", (-F.col("b.neg")).alias("component_label"), F.col("b.votes").alias("votes")), S)


def largest_instance(images: DataFrame, instances: DataFrame, min_score: float) -> DataFrame:
    """Box of the largest instance above a score per image, else the whole frame."""
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    best = instances.filter(F.col("score") >= min_score).groupBy("sample_id").agg(
        F.max(F.struct(area.alias("area"), F.col("score"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))).alias("b")
    )
    joined = images.join(best, "sample_id", "left")
    return joined.select(
        "sample_id", F.coalesce("b.x1", F.lit(0.0)).alias("x1"), F.coalesce("b.y1", F.lit(0.0)).alias("y1"),
        F.coalesce("b.x2", F.col("width")).alias("x2"), F.coalesce("b.y2", F.col("height")).alias("y2"), F.col("b").isNull().alias("is_full_frame"),
    )


def band_of_largest(pixels: DataFrame, tolerance: int = 5) -> DataFrame:
    """Pixels in the rows of the sample's largest component, widened by ``tolerance``."""
    comps = pixels.groupBy("sample_id", "component_label").agg(F.count(F.lit(1)).alias("area"), F.min("y").alias("lo"), F.max("y").alias("hi"))
    best = comps.groupBy("sample_id").agg(F.max(F.struct("area", (-F.col("component_label")).alias("neg"), "lo", "hi")).alias("b"))
    joined = attach_groups(pixels, best, S)
    return joined.filter(F.col("y").between(F.col("b.lo") - tolerance, F.col("b.hi") + tolerance)).drop("b")


def bottom_component(components: DataFrame) -> DataFrame:
    """The root component of a sample: structural in size, near the lowest, then the largest.

    ``components(sample_id, component_label, area, y1, y2, image_height)``. Structural is 8 % of the
    largest area and 32 pixels, or 25 % of the tallest height and 24 pixels; a sample without any takes
    all. Near is max(24, 3 % of the image height). Ties go to the taller, the lower, the first label.
    """
    c = F.col
    tall = c("y2") - c("y1") + 1
    most = components.groupBy("sample_id").agg(F.max("area").alias("_area"), F.max(tall).alias("_tall"))
    big = (c("area") >= F.greatest(F.lit(32.0), F.rint(0.08 * c("_area")))) | (tall >= F.greatest(F.lit(24.0), F.rint(0.25 * c("_tall"))))
    marked = attach_groups(components, most, S).withColumn("_big", big)
    some = marked.groupBy("sample_id").agg(F.max("_big").alias("_some"))
    kept = attach_groups(marked, some, S).filter(c("_big") | ~c("_some")).drop("_big", "_some")
    low = kept.groupBy("sample_id").agg(F.max("y2").alias("_low"))
    near = attach_groups(kept.drop("_area", "_tall"), low, S).filter(c("y2") >= c("_low") - F.greatest(F.lit(24.0), F.rint(0.03 * c("image_height"))))
    best = near.groupBy("sample_id").agg(F.max(F.struct("area", tall.alias("tall"), "y2", (-c("component_label")).alias("neg"))).alias("b"))
    return best.select("sample_id", (-c("b.neg")).alias("component_label"), c("b.area").alias("area"), c("b.y2").alias("y2"))


def root_point(pixels: DataFrame, band: int = 12) -> DataFrame:
    """In the bottom band the pixel with the best thickness less 0.15 per pixel off the mean column.

    ``pixels(sample_id, x, y, thickness)``; ties go to the first pixel in row order.
    """
    low = pixels.groupBy("sample_id").agg(F.max("y").alias("_low"))
    inside = attach_groups(pixels, low, S).filter(F.col("y") >= F.col("_low") - band).drop("_low")
    mean = inside.groupBy("sample_id").agg(F.avg("x").alias("_mean"))
    scored = attach_groups(inside, mean, S).withColumn("value", F.col("thickness") - 0.15 * F.abs(F.col("x") - F.col("_mean")))
    best = scored.groupBy("sample_id").agg(F.max(F.struct("value", (-F.col("y")).alias("up"), (-F.col("x")).alias("neg"))).alias("b"))
    return best.select("sample_id", (-F.col("b.neg")).alias("x"), (-F.col("b.up")).alias("y"), F.col("b.value").alias("value"))


def trunk_side(points: DataFrame, trunk: DataFrame, radius: float, neutral: float = 5.0) -> DataFrame:
    """-1, 0 or 1: the side of the nearest trunk edge a point lies on, 0 within ``neutral``."""
    edges = trunk.withColumn("segment_id", F.col("pos"))
    hits = _back(points, nearest(points, edges, S, radius, ["segment_id"], ["x0", "y0", "x1", "y1"]), S)
    cross = (F.col("x1") - F.col("x0")) * (F.col("py") - F.col("y0")) - (F.col("y1") - F.col("y0")) * (F.col("px") - F.col("x0"))
    side = F.when(F.col("distance").isNull(), None).when(F.col("distance") <= neutral, 0).otherwise(F.signum(cross).cast("int"))
    return hits.select(*points.columns, "distance", side.alias("side"))
