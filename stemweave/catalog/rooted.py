"""Rooted trees over the annotated groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, rsql
from stemweave.operators import graph, rooted
from stemweave.plans.durable import written

SHIFT, FULL = graph.SHIFT, graph.FULL_TURN
V = fx.with_views("vertices", "gedges").replace("WITH ", "WITH RECURSIVE ", 1).rstrip()
SQUARE = f"((src // {SHIFT} - dst // {SHIFT}) ** 2 + (src % {SHIFT} - dst % {SHIFT}) ** 2)"
# an edge belongs to the minimum spanning forest unless shorter edges connect its ends
FOREST = f"""ge AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {SQUARE}, src, dst) AS rk FROM gedges),
 gh AS (SELECT group_id, src, dst, rk FROM ge UNION ALL SELECT group_id, dst, src, rk FROM ge),
 conn AS (SELECT group_id, rk, src AS node FROM ge UNION SELECT k.group_id, k.rk, h.dst FROM conn k JOIN gh h ON h.group_id = k.group_id AND h.src = k.node AND h.rk < k.rk),
 mst AS (SELECT * FROM ge WHERE NOT EXISTS (SELECT 1 FROM conn k WHERE k.group_id = ge.group_id AND k.rk = ge.rk AND k.node = ge.dst)),
 mh AS (SELECT sample_id, group_id, src, dst FROM mst UNION ALL SELECT sample_id, group_id, dst, src FROM mst),
 md AS (SELECT group_id, src AS node, count(*) AS degree FROM mh GROUP BY ALL)"""
TRUNK = """gv AS (SELECT sample_id, group_id, node_id, min(pos) AS pos, any_value(x) AS x, any_value(y) AS y FROM vertices GROUP BY ALL),
 far AS (SELECT a.sample_id, a.node_id, min(sqrt(((a.x - t.x) ** 2 + (a.y - t.y) ** 2)::DOUBLE)) AS px FROM (SELECT DISTINCT sample_id, node_id, x, y FROM gv) a JOIN gv t ON t.sample_id = a.sample_id AND t.group_id % 8 = 0 GROUP BY ALL)"""
TOPOLOGY = f"""{TRUNK}, anchor AS (SELECT group_id, arg_min(node_id, (CASE WHEN group_id % 8 = 0 THEN -y::DOUBLE ELSE px END, pos)) AS node_id FROM gv JOIN far USING (sample_id, node_id) GROUP BY group_id),
 size AS (SELECT group_id, count(*) AS n FROM gv GROUP BY ALL), gh AS (SELECT group_id, src, dst FROM gedges UNION ALL SELECT group_id, dst, src FROM gedges),
 bf AS (SELECT group_id, node_id, 0::BIGINT AS d FROM anchor UNION SELECT b.group_id, h.dst, d + 1 FROM bf b JOIN gh h ON h.group_id = b.group_id AND h.src = b.node_id JOIN size s ON s.group_id = b.group_id WHERE d < s.n),
 dp AS (SELECT group_id, node_id, min(d) AS depth FROM bf GROUP BY ALL),
 topo AS (SELECT v.sample_id, v.group_id, CASE WHEN v.group_id % 8 = 0 THEN 'trunk' ELSE 'branch' END AS group_type, v.node_id, v.x, v.y, dp.depth,
   (SELECT min(h.dst) FROM gh h JOIN dp u ON u.group_id = h.group_id AND u.node_id = h.dst WHERE h.group_id = v.group_id AND h.src = v.node_id AND u.depth = dp.depth - 1) AS parent, coalesce(dp.depth = 0, false) AS is_anchor
   FROM gv v LEFT JOIN dp ON dp.group_id = v.group_id AND dp.node_id = v.node_id)"""
# all groups of the view are connected, so the first point is the only root
LEVELS = """walk AS (SELECT v.sample_id, v.group_id, node_id, NULL::BIGINT AS parent, 0::BIGINT AS above, (coalesce(degree, 0) >= 3)::BIGINT AS forks FROM vertices v LEFT JOIN md ON md.group_id = v.group_id AND md.node = v.node_id WHERE pos = 0
   UNION ALL SELECT w.sample_id, w.group_id, mh.dst, w.node_id, w.forks, w.forks + (md.degree >= 3)::BIGINT FROM walk w JOIN mh ON mh.group_id = w.group_id AND mh.src = w.node_id AND mh.dst IS DISTINCT FROM w.parent JOIN md ON md.group_id = mh.group_id AND md.node = mh.dst),
 pt AS (SELECT *, unnest(range(0, n + 1)) AS i FROM (SELECT *, greatest(ceil(sqrt((node_id // 4194304 - parent // 4194304) ** 2 + (node_id % 4194304 - parent % 4194304) ** 2) / 3.0), 1)::BIGINT AS n FROM walk WHERE parent IS NOT NULL))"""
DIAGNOSE = f"""{TRUNK}, br AS (SELECT DISTINCT sample_id, group_id FROM vertices WHERE group_id % 8 > 0),
 top AS (SELECT mh.group_id, arg_min(mh.src, (px, mh.src)) AS node_id FROM mh JOIN far ON far.sample_id = mh.sample_id AND far.node_id = mh.src GROUP BY mh.group_id),
 walk AS (SELECT mh0.sample_id, top.group_id, top.node_id, NULL::BIGINT AS parent, (degree >= 3)::BIGINT AS forks, px AS peak, 0.0::DOUBLE AS fall FROM top JOIN md ON md.group_id = top.group_id AND md.node = top.node_id
     JOIN br mh0 ON mh0.group_id = top.group_id JOIN far ON far.sample_id = mh0.sample_id AND far.node_id = top.node_id
   UNION ALL SELECT w.sample_id, w.group_id, mh.dst, w.node_id, w.forks + (md.degree >= 3)::BIGINT, greatest(w.peak, px), greatest(w.fall, greatest(w.peak, px) - px) FROM walk w JOIN mh ON mh.group_id = w.group_id AND mh.src = w.node_id AND mh.dst IS DISTINCT FROM w.parent
     JOIN md ON md.group_id = mh.group_id AND md.node = mh.dst JOIN far ON far.sample_id = w.sample_id AND far.node_id = mh.dst),
 ch AS (SELECT w.group_id, parent, node_id, (round(atan2((node_id % {SHIFT} - parent % {SHIFT})::DOUBLE, (node_id // {SHIFT} - parent // {SHIFT})::DOUBLE) * 1e9)::BIGINT + {FULL}) % {FULL} AS t FROM walk w JOIN md ON md.group_id = w.group_id AND md.node = w.parent WHERE md.degree >= 3),
 an AS (SELECT a.group_id, max(least(abs(a.t - b.t), {FULL} - abs(a.t - b.t))) * 360.0 / {FULL} AS widest FROM ch a JOIN ch b ON a.group_id = b.group_id AND a.parent = b.parent AND a.node_id < b.node_id GROUP BY ALL),
 wk AS (SELECT group_id, max(forks) AS forks, max(fall) AS fall FROM walk GROUP BY ALL)"""



def _union(s, sf):
    nodes, edges = graph.build_graph(fx.groups(s, sf))
    return written(nodes, "nodes"), written(edges.select("sample_id", "src", "dst"), "edges")


def _cycles(s, sf):
    """Edges of the cyclic blocks near the trunk; junctions of one column are a cluster."""
    nodes, edges = _union(s, sf)
    far = rooted.trunk_distances(nodes, graph.group_vertices(fx.groups(s, sf).filter("group_type = 'trunk'")))
    clusters = graph.degrees(nodes, edges).filter("degree >= 3").select("sample_id", F.col("x").alias("cluster_id"), "node_id")
    return rooted.trunk_cycles(edges, far, clusters)


QUERIES = [
    Query("blocks", lambda s, sf: rooted.blocks(_union(s, sf)[1])),
    # an edge is a bridge if nothing else connects its ends
    Query("bridges", lambda s, sf: rooted.blocks(_union(s, sf)[1]).filter("size = 1").select("sample_id", "src", "dst"),
          fx.with_views("gedges", "uedges").replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, ue AS (SELECT *, row_number() OVER () AS e FROM uedges), uh AS (SELECT sample_id, src, dst, e FROM ue UNION ALL SELECT sample_id, dst, src, e FROM ue),
          rr AS (SELECT sample_id, e, src AS node FROM ue UNION SELECT rr.sample_id, rr.e, uh.dst FROM rr JOIN uh ON uh.sample_id = rr.sample_id AND uh.src = rr.node AND uh.e <> rr.e)
          SELECT sample_id, src, dst FROM ue WHERE NOT EXISTS (SELECT 1 FROM rr WHERE rr.e = ue.e AND rr.node = ue.dst)"""),
    Query("trunk_cycle_edges", lambda s, sf: _cycles(s, sf)[0]),
    Query("trunk_cycle_stats", lambda s, sf: _cycles(s, sf)[2]),
    Query("spanning_forest", lambda s, sf: rooted.spanning_forest(graph.group_edges(fx.groups(s, sf))), V + f", {FOREST} SELECT sample_id, group_id, src, dst FROM mst"),
    Query("directed_topology", lambda s, sf: rooted.directed_topology(fx.groups(s, sf)), V + f", {TOPOLOGY} SELECT * FROM topo"),
    Query("topology_counts", lambda s, sf: rooted.topology_counts(rooted.directed_topology(fx.groups(s, sf))),
          V + f", {TOPOLOGY} SELECT sample_id, count(*) AS num_nodes, count(parent) AS num_edges, true AS is_dag FROM topo GROUP BY sample_id"),
    Query("hierarchy_levels", lambda s, sf: rounded(rooted.hierarchy_levels(fx.groups(s, sf))),
          V + f""", {FOREST}, {LEVELS} SELECT sample_id, group_id, node_id, i, {rsql('parent // 4194304 - 1048576 + (node_id // 4194304 - parent // 4194304) * (i::DOUBLE / n)', 'x')},
          {rsql('parent % 4194304 - 1048576 + (node_id % 4194304 - parent % 4194304) * (i::DOUBLE / n)', 'y')}, least(above, 3) AS level FROM pt"""),
    Query("group_diagnostics", lambda s, sf: rounded(rooted.group_diagnostics(fx.groups(s, sf)).withColumn("max_child_angle_deg", F.round("max_child_angle_deg", 4))),
          V + f""", {FOREST}, {DIAGNOSE} SELECT br.sample_id, br.group_id, coalesce(forks, 0)::BIGINT AS fork_depth, round(coalesce(widest, 0.0), 4) AS max_child_angle_deg, {rsql('coalesce(fall, 0.0)', 'max_return_to_trunk_px')}
          FROM br LEFT JOIN wk ON wk.group_id = br.group_id LEFT JOIN an ON an.group_id = br.group_id"""),
]
