"""Pixel metric queries: layer R as prediction, layer A as truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, rsql
from stemweave.operators import pixels

c = F.col


def sides(s, sf):
    px = fx.pixels(s, sf)
    return px.filter("layer = 'R'").drop("layer"), px.filter("layer = 'A'").drop("layer")


def lined(df):
    return df.filter("(x + y) % 3 = 0")


def grouped(s, sf):
    p, q = sides(s, sf)
    return p.withColumn("group_id", c("x") % 4), q.withColumn("group_id", F.floor(c("x") / 16))


def stripes(s, sf):
    """Line pixels and group edges, drawn together so that they leave parts of the image uncovered."""
    p, q = sides(s, sf)
    x, y = (c("x") % 20).cast("double"), (c("y") - c("y") % 4).cast("double")
    edges = q.select("sample_id", x.alias("x0"), y.alias("y0"), (x + 3.0).alias("x1"), (y + 1.0).alias("y1"))
    return p.withColumn("component_label", F.floor(c("x") / 8)), edges


PG = fx.with_views("pixels", extra="p AS (SELECT sample_id, x, y FROM pixels WHERE layer = 'R'), g AS (SELECT sample_id, x, y FROM pixels WHERE layer = 'A')")
DIST = """dpg AS (SELECT p.sample_id, p.x, p.y, min(sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y))) AS d FROM p JOIN g ON p.sample_id = g.sample_id GROUP BY ALL),
 dgp AS (SELECT g.sample_id, g.x, g.y, min(sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y))) AS d FROM g JOIN p ON p.sample_id = g.sample_id GROUP BY ALL)"""
TOL = pixels.TOLERANCES

QUERIES = [
    Query("mask_metrics", lambda s, sf: rounded(pixels.mask_metrics(*sides(s, sf))),
          PG + f""", m AS (SELECT coalesce(p.sample_id, g.sample_id) AS sample_id, count_if(p.x IS NOT NULL AND g.x IS NOT NULL) AS tp, count_if(g.x IS NULL) AS fp, count_if(p.x IS NULL) AS fn FROM p FULL JOIN g ON p.sample_id = g.sample_id AND p.x = g.x AND p.y = g.y GROUP BY 1)
          SELECT sample_id, tp, fp, fn, {rsql('tp / (tp + fp + fn)', 'iou')}, {rsql('2 * tp / (2 * tp + fp + fn)', 'dice')}, {rsql('tp / (tp + fp)', 'precision')}, {rsql('tp / (tp + fn)', 'recall')} FROM m"""),
    Query("cldice", lambda s, sf: rounded(pixels.cldice(*sides(s, sf), lined(sides(s, sf)[0]), lined(sides(s, sf)[1]))),
          PG + f""", a AS (SELECT p.sample_id, avg((EXISTS (SELECT 1 FROM g WHERE g.sample_id = p.sample_id AND g.x = p.x AND g.y = p.y))::INT) AS a FROM p WHERE (x + y) % 3 = 0 GROUP BY 1),
          b AS (SELECT g.sample_id, avg((EXISTS (SELECT 1 FROM p WHERE g.sample_id = p.sample_id AND g.x = p.x AND g.y = p.y))::INT) AS b FROM g WHERE (x + y) % 3 = 0 GROUP BY 1)
          SELECT sample_id, {rsql('a', 'topology_precision')}, {rsql('b', 'topology_sensitivity')}, {rsql('CASE WHEN a + b > 0 THEN 2 * a * b / (a + b) ELSE 0 END', 'cldice')} FROM a JOIN b USING (sample_id)"""),
    # every layer of a sample is a picture of its own
    Query("floating_components", lambda s, sf: pixels.floating_components(fx.pixels(s, sf).select(F.concat_ws("-", "sample_id", "layer").alias("sample_id"), "x", "y"))),
    Query("line_metrics", lambda s, sf: rounded(pixels.line_metrics(*sides(s, sf), 2.0)),
          PG + f""", {DIST}, a AS (SELECT sample_id, avg((d <= 2)::INT) AS p, avg(d) AS m FROM dpg GROUP BY 1), b AS (SELECT sample_id, avg((d <= 2)::INT) AS r, avg(d) AS n FROM dgp GROUP BY 1)
          SELECT sample_id, {rsql('p', 'precision')}, {rsql('r', 'recall')}, {rsql('2 * p * r / (p + r + 1e-6)', 'f1')}, {rsql('(m + n) / 2', 'chamfer')} FROM a JOIN b USING (sample_id)"""),
    Query("line_metrics_sweep", lambda s, sf: rounded(pixels.line_metrics_sweep(*sides(s, sf))),
          PG + f", {DIST}, t AS (SELECT unnest([{', '.join(f'{t}::DOUBLE' for t in TOL)}]) AS t), a AS (SELECT sample_id, t, avg((d <= t)::INT) AS p FROM dpg, t GROUP BY ALL), b AS (SELECT sample_id, t, avg((d <= t)::INT) AS r FROM dgp, t GROUP BY ALL)"
          ", j AS (SELECT *, 2 * p * r / (p + r + 1e-6) AS f, lag(p) OVER w AS p0, lag(r) OVER w AS r0 FROM a JOIN b USING (sample_id, t) WINDOW w AS (PARTITION BY sample_id ORDER BY r, p)) SELECT sample_id, "
          + ", ".join(rsql(f"max({v}) FILTER (t = {t})", f"{n}_{int(t)}px") for t in TOL for v, n in (("f", "f1"), ("p", "p"), ("r", "r"))) + f", {rsql('sum((r - r0) * (p0 + p) * 0.5)', 'pr_auc')} FROM j GROUP BY 1"),
    Query("hausdorff", lambda s, sf: rounded(pixels.hausdorff(*sides(s, sf))),
          PG + f", {DIST} SELECT sample_id, {rsql('quantile_cont(d, 0.95)', 'hausdorff_95')}, {rsql('max(d)', 'hausdorff_max')} FROM (SELECT sample_id, d FROM dpg UNION ALL SELECT sample_id, d FROM dgp) u GROUP BY 1"),
    Query("group_consistency", lambda s, sf: rounded(pixels.group_consistency(*grouped(s, sf))),
          PG + f""", a AS (SELECT *, x % 4 AS pg FROM p), b AS (SELECT *, x // 16 AS gg FROM g), i AS (SELECT a.sample_id, pg, gg, count(*) AS n FROM a JOIN b ON a.sample_id = b.sample_id AND a.x = b.x AND a.y = b.y GROUP BY ALL),
          pp AS (SELECT sample_id, avg(coalesce(m, 0) / ar) AS v FROM (SELECT a.sample_id, a.pg, count(*) AS ar, (SELECT max(n) FROM i WHERE i.sample_id = a.sample_id AND i.pg = a.pg) AS m FROM a GROUP BY a.sample_id, a.pg) z GROUP BY 1),
          rr AS (SELECT sample_id, avg(coalesce(m, 0) / ar) AS v FROM (SELECT b.sample_id, b.gg, count(*) AS ar, (SELECT max(n) FROM i WHERE i.sample_id = b.sample_id AND i.gg = b.gg) AS m FROM b GROUP BY b.sample_id, b.gg) z GROUP BY 1)
          SELECT pp.sample_id, {rsql('pp.v', 'group_precision')}, {rsql('rr.v', 'group_recall')}, 0.0::DOUBLE AS group_overlap_ratio, {rsql('2 * pp.v * rr.v / greatest(pp.v + rr.v, 1e-6)', 'group_f1')} FROM pp JOIN rr ON rr.sample_id = pp.sample_id"""),
    Query("group_topology", lambda s, sf: rounded(pixels.group_topology(*grouped(s, sf), 2.0)),
          PG + f""", a AS (SELECT *, x % 4 AS gid FROM p), b AS (SELECT *, x // 16 AS gid FROM g), nr AS (SELECT a.sample_id, a.x AS ax, a.y AS ay, a.gid AS ag, b.x AS bx, b.y AS "by", b.gid AS bg FROM a JOIN b ON a.sample_id = b.sample_id AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 2),
          u AS (SELECT sample_id, sum(m) AS m FROM (SELECT sample_id, ag, max(n) AS m FROM (SELECT sample_id, ag, bg, count(DISTINCT (ax, ay)) AS n FROM nr GROUP BY ALL) q GROUP BY ALL) z GROUP BY 1),
          v AS (SELECT sample_id, sum(m) AS m FROM (SELECT sample_id, bg, max(n) AS m FROM (SELECT sample_id, ag, bg, count(DISTINCT (bx, "by")) AS n FROM nr GROUP BY ALL) q GROUP BY ALL) z GROUP BY 1),
          k AS (SELECT u.sample_id, u.m / (SELECT count(*) FROM p WHERE p.sample_id = u.sample_id) AS pr, v.m / (SELECT count(*) FROM g WHERE g.sample_id = u.sample_id) AS rc FROM u JOIN v ON u.sample_id = v.sample_id)
          SELECT sample_id, {rsql('pr', 'precision')}, {rsql('rc', 'recall')}, {rsql('2 * pr * rc / greatest(pr + rc, 1e-6)', 'f1')} FROM k"""),
    Query("coverage", lambda s, sf: rounded(pixels.coverage(*stripes(s, sf), 24.0, 5.0, 16)),
          PG + f""", e AS (SELECT DISTINCT sample_id, x % 20 AS x0, y - y % 4 AS y0 FROM g), f AS (SELECT p.sample_id, p.x, p.y, e.x0, e.y0, greatest(0.0, least(1.0, ((p.x - x0) * 3.0 + (p.y - y0) * 1.0) / 10.0)) AS f FROM p JOIN e ON e.sample_id = p.sample_id),
          d AS (SELECT sample_id, x, y, min(sqrt((x - (x0 + f * 3.0)) ** 2 + (y - (y0 + f)) ** 2)) AS d FROM f GROUP BY ALL), k AS (SELECT p.sample_id, p.x // 8 AS cl, count(*) AS n, count_if(d <= 24) AS w, count_if(d <= 5) AS t FROM p LEFT JOIN d ON d.sample_id = p.sample_id AND d.x = p.x AND d.y = p.y GROUP BY ALL)
          SELECT sample_id, {rsql('sum(w) / sum(n)', 'coverage_wide')}, {rsql('sum(t) / sum(n)', 'coverage_tight')}, count_if(n >= 16 AND w / n < 0.9) AS long_components_below FROM k GROUP BY 1"""),
]
