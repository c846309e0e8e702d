"""Geometry queries over the polylines, strokes, boxes and pixels."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, rsql, table
from stemweave.functions import geometry as g
from stemweave.operators import orientation

c = F.col


def P():
    return c("poly")


PE = fx.with_views("path_points", "path_edges")
ENDS = """ends AS (SELECT group_id, arg_min(x, pos) AS ax, arg_min(y, pos) AS ay, arg_max(x, pos) AS bx, arg_max(y, pos) AS "by" FROM path_points GROUP BY 1)"""
TURNS = """tn AS (SELECT group_id, pos, x1 - x0 AS dx, y1 - y0 AS dy, len, lead(x1 - x0) OVER w AS ex, lead(y1 - y0) OVER w AS ey, lead(len) OVER w AS elen FROM path_edges WINDOW w AS (PARTITION BY group_id ORDER BY pos)),
 ta AS (SELECT group_id, pos, acos(greatest(-1.0, least(1.0, (dx * ex + dy * ey) / (len * elen)))) AS a FROM tn WHERE elen > 0 AND len > 0)"""
PROJ = lambda px, py: f"""greatest(0.0, least(1.0, (({px} - x0) * (x1 - x0) + ({py} - y0) * (y1 - y0)) / (len * len)))"""


def on_paths(columns):
    return lambda s, sf: rounded(fx.paths(s, sf).select("group_id", *columns()))


# a point per path to project: the middle of its first and its 20th point
def middle(axis: str):
    at = lambda i: F.get(P(), i).getField(axis)
    return (at(0) + at(20)) / 2


TARGET = "tg AS (SELECT group_id, (max(x) FILTER (pos = 0) + max(x) FILTER (pos = 20)) / 2 AS px, (max(y) FILTER (pos = 0) + max(y) FILTER (pos = 20)) / 2 AS py FROM path_points GROUP BY 1)"


def _slice(s, sf):
    poly = fx.paths(s, sf).withColumn("len", g.poly_length(P()))
    cut = poly.select("group_id", g.poly_slice(P(), c("len") * 0.25, c("len") * 0.75).alias("part"))
    return rounded(cut.select("group_id", F.posexplode("part").alias("pos", "p")).select("group_id", c("pos").cast("long").alias("pos"), "p.x", "p.y"))


def _pairs(s, sf):
    """Edges of a path against the edge eight positions later."""
    e = fx.paths(s, sf).select("group_id", g.edges(P()).alias("e"))
    return e.select("group_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("e") - 9), lambda i: F.struct(i.cast("long").alias("pos"), F.get("e", i).alias("a"), F.get("e", i + 8).alias("b")))).alias("p")).select("group_id", "p.*")


def _both(fn):
    a, b = c("a"), c("b")
    return fn(a.x0, a.y0, a.x1, a.y1, b.x0, b.y0, b.x1, b.y1)


PAIR_SQL = """pr AS (SELECT a.group_id, a.pos, a.x0, a.y0, a.x1, a.y1, b.x0 AS u0, b.y0 AS v0, b.x1 AS u1, b.y1 AS v1,
   (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) AS d FROM path_edges a JOIN path_edges b ON a.group_id = b.group_id AND b.pos = a.pos + 8),
 it AS (SELECT *, CASE WHEN abs(d) > 1e-6 THEN ((u0 - x0) * (v1 - v0) - (v0 - y0) * (u1 - u0)) / d END AS t, CASE WHEN abs(d) > 1e-6 THEN ((u0 - x0) * (y1 - y0) - (v0 - y0) * (x1 - x0)) / d END AS u FROM pr),
 ih AS (SELECT *, coalesce(t BETWEEN -1e-6 AND 1 + 1e-6 AND u BETWEEN -1e-6 AND 1 + 1e-6, false) AS hit FROM it)"""


def _pd(px, py, x0, y0, x1, y1):
    f = f"greatest(0.0, least(1.0, (({px} - {x0}) * ({x1} - {x0}) + ({py} - {y0}) * ({y1} - {y0})) / (({x1} - {x0}) ** 2 + ({y1} - {y0}) ** 2)))"
    return f"sqrt(({px} - ({x0} + {f} * ({x1} - {x0}))) ** 2 + ({py} - ({y0} + {f} * ({y1} - {y0}))) ** 2)"


def _densify(s, sf):
    pts = fx.strokes(s, sf).select("sample_id", F.explode(g.densify_edge(c("x0"), c("y0"), c("x1"), c("y1"), 2.0)).alias("p"))
    return pts.select("sample_id", "p.x", "p.y").distinct()


def _boxes(s, sf):
    b = fx.boxes(s, sf)
    box = F.struct("x1", "y1", "x2", "y2")
    other = F.struct((c("x1") + 2).alias("x1"), (c("y1") + 1).alias("y1"), (c("x2") + 3).alias("x2"), (c("y2") + 2).alias("y2"))
    return rounded(b.select("view", "box_id", g.box_area(box).alias("area"), g.box_intersection(box, other).alias("intersection"), g.box_overlap(box, other).alias("overlap"), g.box_iou(box, other).alias("iou"), g.box_center(box).x.alias("cx"), g.box_center(box).y.alias("cy")))


THETA = "(CASE WHEN atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) < 0 THEN atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) + pi() ELSE atan2(embedding[2]::DOUBLE, embedding[1]::DOUBLE) END)"


def theta(i: int):
    a = F.atan2(F.get("embedding", i + 1).cast("double"), F.get("embedding", i).cast("double"))
    return F.when(a < 0, a + math.pi).otherwise(a)


def theta_sql(i: int) -> str:
    a = f"atan2(embedding[{i + 2}]::DOUBLE, embedding[{i + 1}]::DOUBLE)"
    return f"(CASE WHEN {a} < 0 THEN {a} + pi() ELSE {a} END)"


def _axial(s, sf):
    e = table(s, sf, "embeddings").select(c("label").cast("long").alias("label"), theta(0).alias("theta"))
    return rounded(orientation.axial_consistency(e, ["label"], "theta"))


def _axis(s, sf):
    return rounded(orientation.point_axis(fx.pixels(s, sf), ["sample_id", "layer"]))


def _directed(s, sf):
    pts = fx.paths(s, sf)
    at = lambda i: F.get(P(), i)
    df = pts.select(
        "group_id", at(0).x.alias("ax"), at(0).y.alias("ay"), at(1).x.alias("bx"), at(1).y.alias("by"), (F.abs(at(2).x) / 3).alias("distance_a"),
        (F.abs(at(2).y) / 3).alias("distance_b"), (F.abs(at(3).x) / 300).alias("score"), (1 + F.abs(at(3).y) / 100).alias("aspect_ratio"))
    out = orientation.directed_orientation(df, 48.0, 0.05)
    return rounded(out.select("group_id", "base_x", "base_y", "tip_x", "tip_y", "vx", "vy", "attachment_distance", "confidence", "failure_reason", "is_reliable"))


def _angles(s, sf):
    df = table(s, sf, "embeddings").select("vec_id", theta(0).alias("axis_angle"), F.when(c("vec_id") % 5 == 0, None).otherwise(theta(2)).alias("tangent_angle"), theta(4).alias("normal_angle"), (c("vec_id") % 2 == 0).alias("is_elongated"))
    return rounded(orientation.validate_angles(df).select("vec_id", "tangent_difference", "normal_difference", "consistency_score", "is_consistent"))


def _islands(s, sf):
    v = fx.paths(s, sf).select("group_id", F.explode(g.exit_islands(F.transform(P(), lambda p: p.x), 20.0)).alias("i"))
    return v.select("group_id", c("i.first").cast("long").alias("first"), c("i.last").cast("long").alias("last"))


def _profile(s, sf):
    path = F.transform(P(), lambda p: F.struct(p.x.alias("x"), p.y.alias("y"), (F.abs(p.x + p.y) + 1).alias("r")))
    return rounded(fx.paths(s, sf).select("group_id", g.path_profile(path, F.get(P(), 0).y, F.lit(-400.0), F.lit(1000.0), F.lit(800.0)).alias("v")).select("group_id", "v.*"))


def _centers(s, sf):
    b = fx.boxes(s, sf).select("sample_id", "box_id", "x1", "y1", "x2", "y2", F.lit(60.0).alias("width"), F.lit(40.0).alias("height"))
    px = fx.boxes(s, sf).filter("partkey % 3 = 0").select("sample_id", "box_id", F.explode(F.array(c("x1"), c("x2"), c("x2") + 7)).alias("x"), c("y1").alias("y"))
    return rounded(orientation.object_center(b, px))


Q = "quantile_cont"
QUERIES = [
    Query("poly_length", on_paths(lambda: [g.poly_length(P()).alias("length"), g.group_length(P(), F.concat(g.linear_chain(P()), F.array(F.array(F.lit(0), F.lit(31)), F.array(F.lit(0), F.lit(99))))).alias("closed_length")]),
          PE.rstrip() + f", {ENDS} SELECT e.group_id, {rsql('sum(len)', 'length')}, {rsql('sum(len) + sqrt((any_value(bx) - any_value(ax)) ** 2 + (any_value(\"by\") - any_value(ay)) ** 2)', 'closed_length')} FROM path_edges e JOIN ends ON ends.group_id = e.group_id GROUP BY 1"),
    Query("tortuosity", on_paths(lambda: [g.chord(P()).alias("chord"), g.tortuosity(P()).alias("tortuosity"), g.tortuosity(P(), 1e-6).alias("sinuosity"), g.straightness(P()).alias("straightness")]),
          PE + f", {ENDS}, l AS (SELECT group_id, sum(len) AS len FROM path_edges GROUP BY 1), z AS (SELECT l.group_id, len, sqrt((bx - ax) ** 2 + (\"by\" - ay) ** 2) AS ch FROM l JOIN ends USING (group_id)) "
          f"SELECT group_id, {rsql('ch', 'chord')}, {rsql('len / greatest(ch, 1)', 'tortuosity')}, {rsql('len / greatest(ch, 1e-6)', 'sinuosity')}, {rsql('ch / greatest(len, 1e-6)', 'straightness')} FROM z"),
    Query("turning_angles", on_paths(lambda: [g.turning_mean(P()).alias("mean_turn"), g.turning_max(P()).alias("max_turn"), g.turning_sum(P()).alias("sum_turn")]),
          PE + f", {TURNS} SELECT group_id, {rsql('avg(a)', 'mean_turn')}, {rsql('max(a)', 'max_turn')}, {rsql('sum(a)', 'sum_turn')} FROM ta GROUP BY 1"),
    Query("tangents", on_paths(lambda: [g.tangent(P()).x.alias("tx"), g.tangent(P()).y.alias("ty"), g.weighted_tangent(P()).x.alias("wx"), g.weighted_tangent(P()).y.alias("wy"), g.end_tangent(P(), False, 3).x.alias("ex"), g.end_tangent(P(), False, 3).y.alias("ey")]),
          PE + f""", {ENDS}, w AS (SELECT group_id, sum((x1 - x0) * len) AS sx, sum((y1 - y0) * len) AS sy, sum((x0 - x1) * len) FILTER (pos >= 28) AS qx, sum((y0 - y1) * len) FILTER (pos >= 28) AS qy FROM path_edges GROUP BY 1),
          z AS (SELECT *, sqrt((bx - ax) ** 2 + ("by" - ay) ** 2) AS ch, sqrt(sx * sx + sy * sy) AS sn, sqrt(qx * qx + qy * qy) AS qn FROM w JOIN ends USING (group_id))
          SELECT group_id, {rsql('(bx - ax) / ch', 'tx')}, {rsql('("by" - ay) / ch', 'ty')}, {rsql('sx / sn', 'wx')}, {rsql('sy / sn', 'wy')}, {rsql('qx / qn', 'ex')}, {rsql('qy / qn', 'ey')} FROM z"""),
    Query("project_on_polyline", lambda s, sf: rounded(fx.paths(s, sf).select("group_id", g.project_on_polyline(middle("x"), middle("y"), P()).alias("p")).select("group_id", "p.*")),
          PE + f""", {TARGET}, j AS (SELECT e.*, px, py, {PROJ('px', 'py')} AS f FROM path_edges e JOIN tg USING (group_id)),
          k AS (SELECT *, x0 + f * (x1 - x0) AS fx, y0 + f * (y1 - y0) AS fy FROM j), m AS (SELECT *, sqrt((px - fx) ** 2 + (py - fy) ** 2) AS d FROM k),
          r AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY d, pos) AS rn FROM m)
          SELECT group_id, {rsql('coalesce(before, 0) + f * len', 'arc')}, {rsql('fx', 'x')}, {rsql('fy', 'y')}, {rsql('d', 'distance')} FROM r WHERE rn = 1"""),
    Query("poly_slice", _slice,
          PE + f""", t AS (SELECT group_id, sum(len) AS total FROM path_edges GROUP BY 1), j AS (SELECT e.*, coalesce(before, 0) AS off, greatest(total * 0.25, coalesce(before, 0)) AS lo, least(total * 0.75, coalesce(before, 0) + len) AS hi FROM path_edges e JOIN t USING (group_id)),
          k AS (SELECT * FROM j WHERE hi + 1e-6 >= lo), u AS (SELECT group_id, pos, 0 AS o, x0 + (lo - off) / len * (x1 - x0) AS x, y0 + (lo - off) / len * (y1 - y0) AS y FROM k UNION ALL SELECT group_id, pos, 1, x0 + (hi - off) / len * (x1 - x0), y0 + (hi - off) / len * (y1 - y0) FROM k),
          v AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM u WINDOW w AS (PARTITION BY group_id ORDER BY pos, o))
          SELECT group_id, row_number() OVER (PARTITION BY group_id ORDER BY pos, o) - 1 AS pos, {rsql('x', 'x')}, {rsql('y', 'y')} FROM v WHERE lx IS NULL OR sqrt((x - lx) ** 2 + (y - ly) ** 2) > 1e-6"""),
    Query("intersect_segments", lambda s, sf: rounded(_pairs(s, sf).withColumn("h", _both(g.intersect_segments)).filter("h IS NOT NULL").select("group_id", "pos", "h.x", "h.y")),
          PE + f", {PAIR_SQL} SELECT group_id, pos, {rsql('x0 + t * (x1 - x0)', 'x')}, {rsql('y0 + t * (y1 - y0)', 'y')} FROM ih WHERE hit"),
    Query("segment_distance", lambda s, sf: rounded(_pairs(s, sf).select("group_id", "pos", _both(g.segment_distance).alias("distance"))),
          PE + f", {PAIR_SQL} SELECT group_id, pos, {rsql('CASE WHEN hit THEN 0.0 ELSE least(' + ', '.join([_pd('x0', 'y0', 'u0', 'v0', 'u1', 'v1'), _pd('x1', 'y1', 'u0', 'v0', 'u1', 'v1'), _pd('u0', 'v0', 'x0', 'y0', 'x1', 'y1'), _pd('u1', 'v1', 'x0', 'y0', 'x1', 'y1')]) + ') END', 'distance')} FROM ih"),
    Query("max_chord_deviation", on_paths(lambda: [g.max_chord_deviation(P()).alias("deviation")]),
          PE + f", {ENDS} SELECT p.group_id, {rsql('max(' + _pd('x', 'y', 'ax', 'ay', 'bx', chr(34) + 'by' + chr(34)) + ')', 'deviation')} FROM path_points p JOIN ends USING (group_id) WHERE pos BETWEEN 1 AND 30 GROUP BY 1"),
    Query("densify", _densify,
          fx.with_views("strokes") + """, n AS (SELECT *, greatest(ceil(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) / 2.0), 1)::BIGINT AS n FROM strokes)
          SELECT DISTINCT sample_id, round_even(x0 + (x1 - x0) * i / n, 0)::BIGINT AS x, round_even(y0 + (y1 - y0) * i / n, 0)::BIGINT AS y FROM n, LATERAL (SELECT unnest(range(n + 1)) AS i) r"""),
    Query("rescale_clamp", lambda s, sf: rounded(fx.paths(s, sf).select("group_id", F.posexplode(g.clamp_points(g.rescale_points(P(), F.lit(0.5), F.lit(2.0)), F.lit(60.0), F.lit(90.0))).alias("pos", "p")).select("group_id", c("pos").cast("long").alias("pos"), "p.x", "p.y")),
          PE + f"SELECT group_id, pos, {rsql('greatest(0, least(59, x * 0.5))', 'x')}, {rsql('greatest(0, least(89, y * 2.0))', 'y')} FROM path_points"),
    Query("dedupe_consecutive", lambda s, sf: fx.paths(s, sf).select("group_id", F.size(g.dedupe_consecutive(F.transform(P(), lambda p: g.point(F.rint(p.x / 200), F.rint(p.y / 200))))).cast("long").alias("points")),
          PE + """, q AS (SELECT group_id, pos, round_even(x / 200, 0) + 0.0 AS x, round_even(y / 200, 0) + 0.0 AS y FROM path_points), l AS (SELECT *, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM q WINDOW w AS (PARTITION BY group_id ORDER BY pos))
          SELECT group_id, count_if(lx IS NULL OR x <> lx OR y <> ly) AS points FROM l GROUP BY 1"""),
    Query("border_distance", on_paths(lambda: [g.border_distance(P(), F.lit(500.0), F.lit(400.0)).alias("border_distance"), g.mean_point(P()).x.alias("mean_x"), g.mean_point(P()).y.alias("mean_y")]),
          PE + f"SELECT group_id, {rsql('min(least(x, y, 499 - x, 399 - y))', 'border_distance')}, {rsql('avg(x)', 'mean_x')}, {rsql('avg(y)', 'mean_y')} FROM path_points GROUP BY 1"),
    Query("box_overlap", _boxes,
          fx.with_views("boxes") + f""", o AS (SELECT *, (x2 - x1) * (y2 - y1) AS a, (x2 + 3 - x1 - 2) * (y2 + 2 - y1 - 1) AS b, greatest(least(x2, x2 + 3) - greatest(x1, x1 + 2), 0) * greatest(least(y2, y2 + 2) - greatest(y1, y1 + 1), 0) AS i FROM boxes)
          SELECT view, box_id, {rsql('a', 'area')}, {rsql('i', 'intersection')}, {rsql('i / least(a, b)', 'overlap')}, {rsql('i / (a + b - i)', 'iou')}, {rsql('(x1 + x2) / 2', 'cx')}, {rsql('(y1 + y2) / 2', 'cy')} FROM o"""),
    Query("axial_stats", _axial,
          f"""WITH t AS (SELECT label::BIGINT AS label, {theta_sql(0)} AS th FROM embeddings), m AS (SELECT label, count(*) AS n, avg(cos(2 * th)) AS x, avg(sin(2 * th)) AS y FROM t GROUP BY 1)
          SELECT label, n, {rsql('CASE WHEN n < 2 THEN 0.5 ELSE sqrt(x * x + y * y) END', 'consistency_r')}, n >= 2 AND sqrt(x * x + y * y) >= 0.6 AS is_consistent,
          {rsql('CASE WHEN n < 2 THEN 0 ELSE degrees(CASE WHEN 0.5 * atan2(y, x) < 0 THEN 0.5 * atan2(y, x) + pi() ELSE 0.5 * atan2(y, x) END) END', 'mean_direction_deg')} FROM m"""),
    Query("principal_axis", _axis,
          fx.with_views("pixels") + f""", m AS (SELECT sample_id, layer, count(*) AS n, var_pop(x) * count(*) AS xx, var_pop(y) * count(*) AS yy, covar_pop(x, y) * count(*) AS xy FROM pixels GROUP BY ALL),
          d AS (SELECT *, sqrt(greatest((xx + yy) ** 2 - 4 * (xx * yy - xy * xy), 0)) AS r, CASE WHEN abs(xy) < 1e-10 THEN CASE WHEN xx >= yy THEN 0 ELSE pi() / 2 END ELSE 0.5 * atan2(2 * xy, xx - yy) END AS a FROM m),
          u AS (SELECT *, xx * yy - xy * xy > 0 AND xx + yy > 0 AND (xx + yy - r) / 2 >= 1e-10 AS ok FROM d)
          SELECT sample_id, layer, n AS points, {rsql('CASE WHEN ok THEN CASE WHEN a < 0 THEN a + pi() ELSE a END END', 'axis_angle')}, {rsql('CASE WHEN ok THEN sqrt((xx + yy + r) / (xx + yy - r)) END', 'aspect_ratio')} FROM u"""),
    Query("directed_orientation", _directed,
          PE + f""", w AS (SELECT group_id, """ + ", ".join(f"max({v}) FILTER (pos = {i}) AS {v}{i}" for i in range(4) for v in "xy") + f""" FROM path_points GROUP BY 1),
          v AS (SELECT *, abs(x2) / 3 AS da, abs(y2) / 3 AS db, abs(x3) / 300 AS sc, 1 + abs(y3) / 100 AS ar, sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2) AS ln, abs(x2) <= abs(y2) AS af FROM w),
          u AS (SELECT *, sc * exp(-least(da, db) / 36.0) * greatest(0, least(1, abs(da - db) / greatest(ln * 0.35, 2))) * (0.3 + 0.7 * greatest(0, least(1, (ar - 1) / 1.2))) AS cf FROM v),
          t AS (SELECT *, CASE WHEN least(da, db) > 48 THEN 'far_from_skeleton' WHEN ln < 4 THEN 'short_axis' WHEN cf < 0.05 THEN 'ambiguous_polarity' ELSE '' END AS why FROM u)
          SELECT group_id, {rsql('CASE WHEN af THEN x0 ELSE x1 END', 'base_x')}, {rsql('CASE WHEN af THEN y0 ELSE y1 END', 'base_y')}, {rsql('CASE WHEN af THEN x1 ELSE x0 END', 'tip_x')}, {rsql('CASE WHEN af THEN y1 ELSE y0 END', 'tip_y')},
          {rsql('(CASE WHEN af THEN x1 - x0 ELSE x0 - x1 END) / greatest(ln, 1e-6)', 'vx')}, {rsql('(CASE WHEN af THEN y1 - y0 ELSE y0 - y1 END) / greatest(ln, 1e-6)', 'vy')}, {rsql('least(da, db)', 'attachment_distance')}, {rsql('cf', 'confidence')}, why AS failure_reason, why = '' AS is_reliable FROM t"""),
    Query("validate_angles", _angles,
          f"""WITH t AS (SELECT vec_id, {theta_sql(0)} AS a, CASE WHEN vec_id % 5 <> 0 THEN {theta_sql(2)} END AS t, {theta_sql(4)} AS n FROM embeddings),
          d AS (SELECT vec_id, coalesce(least(abs(a - t), pi() - abs(a - t)), pi() / 2) AS td, least(abs(a - n), pi() - abs(a - n)) AS nd FROM t),
          e AS (SELECT *, CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 0.3 END * (greatest(0, 1 - least(td, pi() - td) / (pi() / 3)) + greatest(0, 1 - least(nd, pi() - nd) / (pi() / 4))) AS sc FROM d)
          SELECT vec_id, {rsql('td', 'tangent_difference')}, {rsql('nd', 'normal_difference')}, {rsql('sc', 'consistency_score')}, sc >= 0.5 AS is_consistent FROM e"""),
    Query("max_false_run", lambda s, sf: fx.paths(s, sf).select("group_id", g.max_false_run(F.transform(P(), lambda p: p.x > 0)).cast("long").alias("longest")),
          PE + """, f AS (SELECT group_id, pos, pos - row_number() OVER (PARTITION BY group_id ORDER BY pos) AS isl FROM path_points WHERE NOT x > 0), k AS (SELECT group_id, isl, count(*) AS n FROM f GROUP BY ALL)
          SELECT group_id, coalesce((SELECT max(n) FROM k WHERE k.group_id = g.group_id), 0) AS longest FROM (SELECT DISTINCT group_id FROM path_points) g"""),
    Query("exit_islands", _islands,
          PE + """, f AS (SELECT group_id, pos, pos - row_number() OVER (PARTITION BY group_id ORDER BY pos) AS isl FROM path_points WHERE x > 20) SELECT group_id, min(pos) AS first, max(pos) AS last FROM f GROUP BY group_id, isl"""),
    Query("tail_penalty", lambda s, sf: rounded(fx.lines(s, sf).select("sample_id", "segment_id", g.lower_tail_penalty(c("l_quantity"), F.lit(12.5), c("l_tax")).alias("penalty"), g.robust_distance(c("l_quantity"), F.lit(25.0), c("l_tax")).alias("robust"))),
          fx.with_views("lines") + f"SELECT sample_id, segment_id, {rsql('greatest(12.5 - l_quantity, 0) / greatest(l_tax, 0.05)', 'penalty')}, {rsql('abs(l_quantity - 25.0) / greatest(l_tax, 0.05)', 'robust')} FROM lines"),
    Query("path_profile", _profile,
          PE + f""", r AS (SELECT group_id, pos, x, y, abs(x + y) + 1 AS r FROM path_points), l AS (SELECT group_id, sum(len) AS arc FROM path_edges GROUP BY 1),
          m AS (SELECT group_id, greatest({Q}(r, 0.5), 1e-6) AS md, {Q}(r, 0.25) AS q, {Q}(r, 0.5) FILTER (pos < 10) AS lo, {Q}(r, 0.5) FILTER (pos >= 22) AS hi, {Q}(r, 0.5) FILTER (pos >= 29) AS te, max(y) FILTER (pos = 31) AS ly, max(y) FILTER (pos = 0) AS ry, min(y) AS my, max(x) - min(x) AS sp FROM r GROUP BY 1)
          SELECT group_id, {rsql('md', 'median_radius_px')}, {rsql('q', 'p25_radius_px')}, {rsql('q / md', 'sustained_to_median_ratio')}, {rsql('hi / greatest(lo, 1e-6)', 'upper_to_lower_radius_ratio')}, {rsql('te / md', 'terminal_to_median_radius_ratio')},
          {rsql('(ly + 400) / 800', 'terminal_below_component_top_norm_height')}, {rsql('arc / greatest(ry - my, 1)', 'tortuosity')}, {rsql('sp / 1000', 'lateral_drift_norm_width')} FROM m JOIN l USING (group_id)"""),
    Query("object_center", _centers,
          fx.with_views("boxes") + f"""SELECT sample_id, box_id, {rsql('greatest(0, least(59, round_even(CASE WHEN partkey % 3 = 0 THEN (x1 + x2 + x2 + 7) / 3 ELSE (x1 + x2) / 2 END, 0)))', 'cx')},
          {rsql('greatest(0, least(39, round_even(CASE WHEN partkey % 3 = 0 THEN y1 ELSE (y1 + y2) / 2 END, 0)))', 'cy')} FROM boxes"""),
]
