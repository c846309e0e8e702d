"""Suppression, matching, thinning and clustering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, table
from stemweave.operators import clusters, graph, greedy
from stemweave.plans.durable import written

c = F.col


def boxes(s, sf):
    b = fx.boxes(s, sf)
    return b.select(c("tree_id").alias("sample_id"), F.concat_ws("/", c("view").cast("string"), "box_id").alias("box_id"), "x1", "y1", "x2", "y2", "score", "label")


BX = fx.with_views("boxes", extra="""b AS (SELECT tree_id AS sample_id, concat(view, '/', box_id) AS box_id, x1, y1, x2, y2, score, label FROM boxes),
 pr AS (SELECT f.sample_id, f.box_id AS f, l.box_id AS l, f.score >= l.score AS w FROM b f JOIN b l ON f.sample_id = l.sample_id AND f.label = 0 AND l.label = 1 AND least(f.x2, l.x2) > greatest(f.x1, l.x1) AND least(f.y2, l.y2) > greatest(f.y1, l.y1)
   AND (least(f.x2, l.x2) - greatest(f.x1, l.x1)) * (least(f.y2, l.y2) - greatest(f.y1, l.y1)) / least((f.x2 - f.x1) * (f.y2 - f.y1), (l.x2 - l.x1) * (l.y2 - l.y1)) > 0.5),
 gn AS (SELECT sample_id, l, min(f) AS t FROM pr WHERE w GROUP BY ALL),
 lost AS (SELECT DISTINCT pr.sample_id, pr.f FROM pr LEFT JOIN gn ON gn.sample_id = pr.sample_id AND gn.l = pr.l WHERE NOT w AND (t IS NULL OR t > pr.f))""")


def all_points(s, sf):
    return boxes(s, sf).select("sample_id", c("box_id").alias("point_id"), c("x1").alias("x"), c("y1").alias("y"), "label")


def points(s, sf, label: int):
    return all_points(s, sf).filter(c("label") == label).drop("label")


def _contacts(s, sf):
    """Pixels of every path against the edges of the first path of its sample."""
    p = fx.groups(s, sf).filter("group_id % 8 > 0")
    pts = p.select("sample_id", "group_id", (c("group_id") - c("group_id") % 8).alias("parent_id"), F.explode("points").alias("q")).select("sample_id", "group_id", "parent_id", "q.x", "q.y").distinct()
    e = graph.group_edges(fx.groups(s, sf).filter("group_id % 8 = 0"))
    edges = e.select("sample_id", c("group_id").alias("parent_id"), *[f(c(n)).cast("double").alias(a) for a, f, n in (("x0", graph.node_x, "src"), ("y0", graph.node_y, "src"), ("x1", graph.node_x, "dst"), ("y1", graph.node_y, "dst"))])
    return clusters.contact_count(pts, edges, 1.5)


def _junctions(s, sf):
    nodes, edges = graph.build_graph(fx.groups(s, sf))
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    owners = graph.group_vertices(fx.groups(s, sf)).join(fx.groups(s, sf).select("sample_id", "group_id", "group_type"), ["sample_id", "group_id"])
    kinds = graph.typed_nodes(nodes, edges, owners).select("sample_id", "node_id", (c("node_type") == "trunk").alias("is_trunk"))
    j = graph.degrees(nodes, edges).filter("degree >= 3").join(kinds, ["sample_id", "node_id"])
    none = nodes.select("sample_id", "node_id").limit(0)
    links = graph.segment_table(graph.segment_edges(graph.trace_segments(nodes, edges, none)))
    return clusters.cluster_junctions(written(j, "junctions"), links, 2.0)


def _detection(s, sf):
    return rounded(greedy.point_detection(points(s, sf, 0), points(s, sf, 1), 3.0))


QUERIES = [
    Query("nms", lambda s, sf: greedy.nms(boxes(s, sf).drop("label"), 0.5, 8.0).select("sample_id", "box_id")),
    Query("suppress_cross_class", lambda s, sf: greedy.suppress_cross_class(boxes(s, sf), 0.5, 8.0).select("sample_id", "box_id"),
          BX + "SELECT b.sample_id, b.box_id FROM b LEFT JOIN gn ON gn.sample_id = b.sample_id AND gn.l = b.box_id LEFT JOIN lost ON lost.sample_id = b.sample_id AND lost.f = b.box_id WHERE gn.l IS NULL AND lost.f IS NULL"),
    Query("sparsify", lambda s, sf: greedy.sparsify(all_points(s, sf).drop("label"), 4.0, 20).select("sample_id", "point_id")),
    Query("match_points", lambda s, sf: rounded(greedy.match_points(points(s, sf, 0), points(s, sf, 1), 3.0))),
    Query("branch_detection", _detection),
    Query("contact_count", _contacts),
    Query("cluster_junctions", _junctions),
]
