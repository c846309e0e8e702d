"""Geometry of points, edges and polylines as Column expressions.

A polyline is ``ARRAY<STRUCT<x: DOUBLE, y: DOUBLE>>``; a row holds a whole polyline, so nothing is
shuffled. ``steps`` turns it into its edges with running arc length.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def norm(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def clamp(v: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda b: b if isinstance(b, Column) else F.lit(float(b))
    return F.greatest(as_col(low), F.least(as_col(high), v))


def first(poly: Column) -> Column:
    return F.get(poly, F.lit(0))


def last(poly: Column) -> Column:
    return F.get(poly, F.size(poly) - 1)


def edges(poly: Column) -> Column:
    """Array of ``(x0, y0, x1, y1, len)``, empty below two points."""
    n = F.greatest(F.size(poly) - 1, F.lit(0))
    return F.zip_with(
        F.slice(poly, F.lit(1), n),
        F.slice(poly, F.lit(2), n),
        lambda a, b: F.struct(
            a.x.alias("x0"), a.y.alias("y0"), b.x.alias("x1"), b.y.alias("y1"), norm(b.x - a.x, b.y - a.y).alias("len")
        ),
    )


def _total(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, e: acc + of(e))


def poly_length(poly: Column) -> Column:
    return _total(edges(poly), lambda e: e.len)


def group_length(points: Column, index_pairs: Column) -> Column:
    """Length of a group over its edge list of point indices; bad indices count nothing."""
    def of(pair: Column) -> Column:
        a, b = F.get(points, F.get(pair, F.lit(0))), F.get(points, F.get(pair, F.lit(1)))
        return F.coalesce(norm(b.x - a.x, b.y - a.y), F.lit(0.0))

    return _total(index_pairs, of)


def linear_chain(points: Column) -> Column:
    """Edges 0-1, 1-2, ... used where an annotation has none."""
    n = F.size(points)
    empty = F.array().cast("array<array<int>>")
    return F.when(n < 2, empty).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.array(i, i + 1)))


def chord(poly: Column) -> Column:
    return norm(last(poly).x - first(poly).x, last(poly).y - first(poly).y)


def tortuosity(poly: Column, floor: float = 1.0) -> Column:
    """Arc over chord, the chord not below ``floor`` (1 for tortuosity, 1e-6 for sinuosity)."""
    return poly_length(poly) / F.greatest(chord(poly), F.lit(floor))


def straightness(poly: Column) -> Column:
    return chord(poly) / F.greatest(poly_length(poly), F.lit(EPSILON))


def angle_between(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle of two vectors in radians, null where one of them is zero."""
    length = norm(ax, ay) * norm(bx, by)
    return F.when(length > 0, F.acos(clamp((ax * bx + ay * by) / length, -1.0, 1.0)))


def turning_angles(poly: Column) -> Column:
    """Angles in radians at inner points whose both edges have a length."""
    e = edges(poly)
    n = F.greatest(F.size(e) - 1, F.lit(0))
    angles = F.zip_with(
        F.slice(e, F.lit(1), n), F.slice(e, F.lit(2), n),
        lambda a, b: angle_between(a.x1 - a.x0, a.y1 - a.y0, b.x1 - b.x0, b.y1 - b.y0),
    )
    return F.array_compact(angles)


def turning_mean(poly: Column) -> Column:
    t = turning_angles(poly)
    return F.when(F.size(t) > 0, _total(t, lambda v: v) / F.size(t)).otherwise(0.0)


def turning_max(poly: Column) -> Column:
    return F.coalesce(F.array_max(turning_angles(poly)), F.lit(0.0))


def turning_sum(poly: Column) -> Column:
    return _total(turning_angles(poly), lambda v: v)


def unit(dx: Column, dy: Column) -> Column:
    n = norm(dx, dy)
    return F.when(n > 0, point(dx / n, dy / n)).otherwise(point(F.lit(0.0), F.lit(0.0)))


def tangent(poly: Column) -> Column:
    """Unit vector from the first to the last point."""
    return unit(last(poly).x - first(poly).x, last(poly).y - first(poly).y)


def weighted_tangent(poly: Column) -> Column:
    """Direction of the edges weighted by their length; end to end when every edge is too short."""
    used = F.filter(edges(poly), lambda e: e.len > EPSILON)
    sums = F.aggregate(
        used, point(F.lit(0.0), F.lit(0.0)),
        lambda acc, e: point(acc.x + (e.x1 - e.x0) * e.len, acc.y + (e.y1 - e.y0) * e.len),
    )
    return F.when(F.size(used) > 0, unit(sums.x, sums.y)).otherwise(tangent(poly))


def end_tangent(poly: Column, from_start: bool = True, k: int = 3) -> Column:
    """Length-weighted tangent of the first k edges seen from one end."""
    p = poly if from_start else F.reverse(poly)
    head = F.slice(p, F.lit(1), F.least(F.size(p), F.lit(max(k, 1) + 1)))
    used = F.filter(edges(head), lambda e: e.len > EPSILON)
    return F.when(F.size(used) > 0, weighted_tangent(head)).otherwise(tangent(p))


def project_point(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(fraction, x, y, distance): nearest place of a segment to a point."""
    dx, dy = x1 - x0, y1 - y0
    square = dx * dx + dy * dy
    f = F.when(square > EPSILON, clamp(((px - x0) * dx + (py - y0) * dy) / square, 0.0, 1.0)).otherwise(0.0)
    fx, fy = x0 + f * dx, y0 + f * dy
    return F.struct(f.alias("fraction"), fx.alias("x"), fy.alias("y"), norm(px - fx, py - fy).alias("distance"))


def project_on_polyline(px: Column, py: Column, poly: Column) -> Column:
    """struct(arc, x, y, distance): nearest place of a polyline, the first of equal ones."""
    start = F.struct(
        px.cast("double").alias("px"), py.cast("double").alias("py"), F.lit(0.0).alias("offset"), F.lit(0.0).alias("arc"), F.lit(None).cast("double").alias("x"),
        F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("distance"),
    )

    def step(acc: Column, e: Column) -> Column:
        p = project_point(acc.px, acc.py, e.x0, e.y0, e.x1, e.y1)
        closer = acc.distance.isNull() | (p.distance < acc.distance)
        pick = lambda new, old: F.when(closer, new).otherwise(old)
        return F.struct(
            acc.px.alias("px"), acc.py.alias("py"), (acc.offset + e.len).alias("offset"), pick(acc.offset + p.fraction * e.len, acc.arc).alias("arc"),
            pick(p.x, acc.x).alias("x"), pick(p.y, acc.y).alias("y"), pick(p.distance, acc.distance).alias("distance"),
        )

    return F.aggregate(edges(poly), start, step, lambda acc: F.struct(acc.arc.alias("arc"), acc.x.alias("x"), acc.y.alias("y"), acc.distance.alias("distance")))


def dedupe_consecutive(poly: Column, tolerance: float = 0.0) -> Column:
    """Drop a point that does not differ from the last kept one."""
    empty = F.array().cast("array<struct<x:double,y:double>>")

    def step(acc: Column, p: Column) -> Column:
        before = F.get(acc, F.size(acc) - 1)
        far = norm(p.x - before.x, p.y - before.y) > tolerance
        return F.when((F.size(acc) == 0) | far, F.array_append(acc, p)).otherwise(acc)

    return F.aggregate(poly, empty, step)


def poly_slice(poly: Column, a: Column, b: Column) -> Column:
    """Part of a polyline between two arc positions with interpolated ends.

    The two positions travel in the fold's state, so an expensive expression is evaluated once.
    """
    state = F.struct(a.alias("a"), b.alias("b"), F.lit(0.0).alias("offset"), F.array().cast("array<struct<x:double,y:double>>").alias("points"))

    def step(acc: Column, e: Column) -> Column:
        lo, hi = F.greatest(acc.a, acc.offset), F.least(acc.b, acc.offset + e.len)
        at = lambda s: point(e.x0 + (s - acc.offset) / e.len * (e.x1 - e.x0), e.y0 + (s - acc.offset) / e.len * (e.y1 - e.y0))
        hit = (hi + EPSILON >= lo) & (e.len > EPSILON)
        return F.struct(
            acc.a.alias("a"), acc.b.alias("b"), (acc.offset + e.len).alias("offset"),
            F.when(hit, F.concat(acc.points, F.array(at(lo), at(hi)))).otherwise(acc.points).alias("points"),
        )

    empty = F.array().cast("array<struct<x:double,y:double>>")
    finish = lambda acc: F.when(acc.b - acc.a > EPSILON, dedupe_consecutive(acc.points, EPSILON)).otherwise(empty)
    return F.aggregate(edges(poly), state, step, finish)


def intersect_segments(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Crossing point of two segments within 1e-6 of their ends; null when parallel or apart."""
    rx, ry, sx, sy = ax1 - ax0, ay1 - ay0, bx1 - bx0, by1 - by0
    d = rx * sy - ry * sx
    ox, oy = bx0 - ax0, by0 - ay0
    t, u = (ox * sy - oy * sx) / d, (ox * ry - oy * rx) / d
    inside = t.between(-EPSILON, 1 + EPSILON) & u.between(-EPSILON, 1 + EPSILON)
    return F.when((F.abs(d) > EPSILON) & inside, point(ax0 + t * rx, ay0 + t * ry))


def segment_distance(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Distance of two segments: zero when they cross, else the nearest end to the other segment."""
    ends = F.least(
        project_point(ax0, ay0, bx0, by0, bx1, by1).distance, project_point(ax1, ay1, bx0, by0, bx1, by1).distance,
        project_point(bx0, by0, ax0, ay0, ax1, ay1).distance, project_point(bx1, by1, ax0, ay0, ax1, ay1).distance,
    )
    return F.when(intersect_segments(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1).isNotNull(), 0.0).otherwise(ends)


def max_chord_deviation(poly: Column) -> Column:
    """Largest distance of an inner point from the chord."""
    a, b = first(poly), last(poly)
    inner = F.slice(poly, F.lit(2), F.greatest(F.size(poly) - 2, F.lit(0)))
    return F.coalesce(F.array_max(F.transform(inner, lambda p: project_point(p.x, p.y, a.x, a.y, b.x, b.y).distance)), F.lit(0.0))


def densify_edge(x0: Column, y0: Column, x1: Column, y1: Column, spacing: float) -> Column:
    """Rounded points along an edge, at most ``spacing`` apart, both ends included."""
    n = F.greatest(F.ceil(norm(x1 - x0, y1 - y0) / spacing), F.lit(1))
    return F.transform(
        F.sequence(F.lit(0).cast("long"), n),
        lambda i: F.struct(F.rint(x0 + (x1 - x0) * i / n).cast("long").alias("x"), F.rint(y0 + (y1 - y0) * i / n).cast("long").alias("y")),
    )


def rescale_points(poly: Column, sx: Column, sy: Column) -> Column:
    return F.transform(poly, lambda p: point(p.x * sx, p.y * sy))


def clamp_points(poly: Column, width: Column, height: Column) -> Column:
    return F.transform(poly, lambda p: point(clamp(p.x, 0.0, width - 1), clamp(p.y, 0.0, height - 1)))


def border_distance(poly: Column, width: Column, height: Column) -> Column:
    """Smallest distance of any point to the image border."""
    return F.array_min(F.transform(poly, lambda p: F.least(p.x, p.y, width - 1 - p.x, height - 1 - p.y)))


def mean_point(poly: Column) -> Column:
    """Mean of the vertices (not the middle of the arc)."""
    n = F.size(poly)
    return point(_total(poly, lambda p: p.x) / n, _total(poly, lambda p: p.y) / n)


# --- boxes -------------------------------------------------------------------------------------------


def box_area(b: Column) -> Column:
    return (b.x2 - b.x1) * (b.y2 - b.y1)


def box_intersection(a: Column, b: Column) -> Column:
    w = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    h = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def box_overlap(a: Column, b: Column) -> Column:
    """Intersection over the smaller area."""
    return box_intersection(a, b) / F.least(box_area(a), box_area(b))


def box_iou(a: Column, b: Column) -> Column:
    i = box_intersection(a, b)
    return i / (box_area(a) + box_area(b) - i)


def box_center(b: Column) -> Column:
    return point((b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2)


# --- circular and moment statistics (aggregates) ------------------------------------------------------


def axial_stats(angle: Column) -> Column:
    """Aggregate over undirected angles: count, resultant length R, mean direction in degrees.

    Angles are doubled so that opposite directions agree. Below two angles R is one half and
    nothing is called consistent.
    """
    x, y, n = F.avg(F.cos(2 * angle)), F.avg(F.sin(2 * angle)), F.count(angle)
    mean = 0.5 * F.atan2(y, x)
    positive = F.when(mean < 0, mean + math.pi).otherwise(mean)
    few = n < 2
    r = F.when(few, 0.5).otherwise(F.sqrt(x * x + y * y))
    return F.struct(
        n.alias("n"), r.alias("consistency_r"), (~few & (r >= 0.6)).alias("is_consistent"),
        F.when(few, 0.0).otherwise(F.degrees(positive)).alias("mean_direction_deg"),
    )


def principal_axis(x: Column, y: Column) -> Column:
    """Aggregate over points: axis angle in [0, pi) and aspect ratio from second moments.

    Null when the points are collinear, coincide, or when the smaller moment vanishes.
    """
    n = F.count(x)
    xx, yy, xy = F.var_pop(x) * n, F.var_pop(y) * n, F.covar_pop(x, y) * n
    trace, det = xx + yy, xx * yy - xy * xy
    root = F.sqrt(F.greatest(trace * trace - 4 * det, F.lit(0.0)))
    large, small = (trace + root) / 2, (trace - root) / 2
    angle = F.when(F.abs(xy) < 1e-10, F.when(xx >= yy, 0.0).otherwise(math.pi / 2)).otherwise(0.5 * F.atan2(2 * xy, xx - yy))
    angle = F.when(angle < 0, angle + math.pi).otherwise(angle)
    usable = (det > 0) & (trace > 0) & (small >= 1e-10)
    return F.when(usable, F.struct(angle.alias("axis_angle"), F.sqrt(large / small).alias("aspect_ratio")))


# --- runs in arrays -----------------------------------------------------------------------------------


def max_false_run(flags: Column) -> Column:
    """Longest run of false values."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, f: Column) -> Column:
        run = F.when(f, 0).otherwise(acc.run + 1)
        return F.struct(run.alias("run"), F.greatest(acc.best, run).alias("best"))

    return F.aggregate(flags, start, step, lambda acc: acc.best)


def exit_islands(values: Column, threshold: Column | float) -> Column:
    """Array of (first, last) index of every run above ``threshold``."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    empty = F.array().cast("array<struct<first:int,last:int>>")
    start = F.struct(F.lit(0).alias("i"), empty.alias("out"))

    def step(acc: Column, v: Column) -> Column:
        tail = F.get(acc.out, F.size(acc.out) - 1)
        grows = (F.size(acc.out) > 0) & (tail.last == acc.i - 1)
        new = F.array_append(acc.out, F.struct(acc.i.alias("first"), acc.i.alias("last")))
        longer = F.array_append(F.slice(acc.out, F.lit(1), F.greatest(F.size(acc.out) - 1, F.lit(0))), F.struct(tail.first.alias("first"), acc.i.alias("last")))
        return F.struct((acc.i + 1).alias("i"), F.when(v > limit, F.when(grows, longer).otherwise(new)).otherwise(acc.out).alias("out"))

    return F.aggregate(values, start, step, lambda acc: acc.out)


def lower_tail_penalty(value: Column, p05: Column, iqr: Column) -> Column:
    return F.greatest(p05 - value, F.lit(0.0)) / F.greatest(iqr, F.lit(0.05))


def robust_distance(value: Column, median: Column, iqr: Column) -> Column:
    return F.abs(value - median) / F.greatest(iqr, F.lit(0.05))


def array_quantile(values: Column, p: float) -> Column:
    """Linearly interpolated quantile of an array of doubles."""
    s = F.array_sort(values)
    pos = (F.size(s) - 1) * F.lit(float(p))
    lo, hi = F.get(s, F.floor(pos).cast("int")), F.get(s, F.ceil(pos).cast("int"))
    return lo + (hi - lo) * (pos - F.floor(pos))


def path_profile(path: Column, root_y: Column, top_y: Column, width: Column, height: Column) -> Column:
    """Taper profile of ``ARRAY<STRUCT<x, y, r>>`` ordered from the root up."""
    n = F.size(path)
    r = F.transform(path, lambda p: p.r)
    third = F.greatest(F.floor(n / 3), F.lit(1)).cast("int")
    tail = F.least(F.greatest(F.floor(n / 10), F.lit(3)), n).cast("int")
    median = F.greatest(array_quantile(r, 0.5), F.lit(1e-6))
    lower = array_quantile(F.slice(r, F.lit(1), third), 0.5)
    upper = array_quantile(F.slice(r, n - third + 1, third), 0.5)
    ending = array_quantile(F.slice(r, n - tail + 1, tail), 0.5)
    quarter = array_quantile(r, 0.25)
    xs, ys = F.transform(path, lambda p: p.x), F.transform(path, lambda p: p.y)
    arc = poly_length(F.transform(path, lambda p: point(p.x, p.y)))
    return F.struct(
        median.alias("median_radius_px"), quarter.alias("p25_radius_px"), (quarter / median).alias("sustained_to_median_ratio"),
        (upper / F.greatest(lower, F.lit(1e-6))).alias("upper_to_lower_radius_ratio"), (ending / median).alias("terminal_to_median_radius_ratio"),
        ((F.get(ys, n - 1) - top_y) / F.greatest(height, F.lit(1.0))).alias("terminal_below_component_top_norm_height"),
        (arc / F.greatest(root_y - F.array_min(ys), F.lit(1.0))).alias("tortuosity"),
        ((F.array_max(xs) - F.array_min(xs)) / F.greatest(width, F.lit(1.0))).alias("lateral_drift_norm_width"),
    )
