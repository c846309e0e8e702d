"""Graph queries over the annotated groups."""

from __future__ import annotations


from pyspark.sql import functions as F

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, rsql
from stemweave.operators import graph
from stemweave.plans.durable import written

c = F.col
V = fx.with_views("vertices", "gedges", "uedges", "unodes")
H = """h AS (SELECT sample_id, src, dst FROM uedges UNION ALL SELECT sample_id, dst, src FROM uedges),
 dg AS (SELECT n.*, coalesce(d, 0) AS degree FROM unodes n LEFT JOIN (SELECT sample_id, src, count(*) AS d FROM h GROUP BY ALL) k ON k.sample_id = n.sample_id AND k.src = n.node_id)"""
# closure of every node, its smallest member and the lowest node of each component
COMP = """reach AS (SELECT sample_id, node_id, node_id AS root FROM unodes UNION SELECT r.sample_id, h.dst, r.root FROM reach r JOIN h ON h.sample_id = r.sample_id AND h.src = r.node_id),
 comp AS (SELECT sample_id, node_id, min(root) AS component_id FROM reach GROUP BY ALL),
 root AS (SELECT sample_id, component_id, arg_max(node_id, (t, y, -node_id)) AS node_id FROM (SELECT comp.*, y, EXISTS (SELECT 1 FROM vertices v WHERE v.sample_id = comp.sample_id AND v.node_id = comp.node_id AND v.group_id % 8 = 0) AS t
   FROM comp JOIN unodes USING (sample_id, node_id)) z GROUP BY sample_id, component_id)"""
VR = V.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f", {H}, {COMP}"
TRACE = """ky AS (SELECT sample_id, node_id, degree <> 2 OR (sample_id, node_id) IN (SELECT (sample_id, node_id) FROM root) AS k FROM dg),
 walk AS (SELECT h.sample_id, h.src AS start_node, h.dst AS first_node, 0::BIGINT AS pos, h.src, h.dst FROM h JOIN ky ON ky.sample_id = h.sample_id AND ky.node_id = h.src AND k
   UNION ALL SELECT w.sample_id, start_node, first_node, pos + 1, h.src, h.dst FROM walk w JOIN ky ON ky.sample_id = w.sample_id AND ky.node_id = w.dst AND NOT k JOIN h ON h.sample_id = w.sample_id AND h.src = w.dst AND h.dst <> w.src),
 lastw AS (SELECT sample_id, start_node, first_node, max(pos) AS n, arg_max(dst, pos) AS end_node, arg_max(src, pos) AS last_node FROM walk GROUP BY ALL),
 tr AS (SELECT w.*, end_node FROM walk w JOIN lastw l USING (sample_id, start_node, first_node) WHERE (start_node, first_node) <= (end_node, last_node)),
 seg AS (SELECT sample_id, concat(start_node, '-', first_node) AS segment_id, start_node, end_node, count(*) AS n_edges,
   sum(sqrt((floor(src / 4194304) - floor(dst / 4194304)) ** 2 + (src % 4194304 - dst % 4194304) ** 2)) AS length_px FROM tr GROUP BY sample_id, start_node, first_node, end_node)"""


def base(s, sf):
    """Nodes and edges, written once: every graph operator reads them several times."""
    nodes, edges = graph.build_graph(fx.groups(s, sf))
    return written(nodes, "nodes"), written(edges, "edges")


def trunk_nodes(s, sf):
    return graph.group_vertices(fx.groups(s, sf).filter("group_type = 'trunk'"))


def rooted(s, sf):
    nodes, edges = base(s, sf)
    labels = graph.components(nodes, edges)
    return nodes, edges, labels, graph.choose_roots(nodes, labels, trunk_nodes(s, sf))


def traced(s, sf):
    nodes, edges, _, roots = rooted(s, sf)
    return graph.trace_segments(nodes, edges, roots), roots, nodes


def segments(s, sf):
    t, roots, nodes = traced(s, sf)
    return written(graph.segment_table(graph.segment_edges(t)), "segments"), roots, nodes


def _landmarks(s, sf):
    nodes, edges, _, roots = rooted(s, sf)
    return graph.landmarks(nodes, edges, roots).select("sample_id", "node_id", "degree", F.concat_ws(",", "types").alias("types"))


def _split(s, sf):
    seg, _, _ = segments(s, sf)
    events = seg.select("sample_id", "segment_id", F.explode(F.array(*[
        F.struct((c("length_px") * f).alias("arc"), F.lit(i).alias("event_id")) for i, f in enumerate([0.01, 0.31, 0.33, 0.36, 0.7])])).alias("e")).select("sample_id", "segment_id", "e.*")
    return rounded(graph.split_at_events(seg, events))


SPLIT_SQL = """ev AS (SELECT sample_id, segment_id, 0.0::DOUBLE AS arc, 0 AS kind, 'start' AS eid FROM seg UNION ALL SELECT sample_id, segment_id, length_px, 2, 'end' FROM seg
   UNION ALL SELECT sample_id, segment_id, length_px * f, 1, CAST(i AS VARCHAR) FROM seg, (VALUES (0, 0.01::DOUBLE), (1, 0.31::DOUBLE), (2, 0.33::DOUBLE), (3, 0.36::DOUBLE), (4, 0.7::DOUBLE)) v(i, f)),
 nv AS (SELECT *, row_number() OVER (PARTITION BY sample_id, segment_id ORDER BY arc, kind, eid) AS r FROM ev),
 fold AS (SELECT sample_id, segment_id, r, arc, eid, arc AS k_arc, eid AS k_eid FROM nv WHERE r = 1
   UNION ALL SELECT n.sample_id, n.segment_id, n.r, n.arc, n.eid, CASE WHEN n.arc - f.k_arc <= 0.5 THEN f.k_arc ELSE n.arc END, CASE WHEN n.arc - f.k_arc <= 0.5 THEN f.k_eid ELSE n.eid END
   FROM fold f JOIN nv n ON n.sample_id = f.sample_id AND n.segment_id = f.segment_id AND n.r = f.r + 1),
 kept AS (SELECT sample_id, segment_id, k_arc AS arc, k_eid AS eid, count(*) - 1 AS merged FROM fold GROUP BY ALL),
 pc AS (SELECT *, row_number() OVER w AS piece, lead(arc) OVER w AS e_arc, lead(eid) OVER w AS e_eid, lead(merged) OVER w AS e_m FROM kept WINDOW w AS (PARTITION BY sample_id, segment_id ORDER BY arc))"""


def _types(s, sf):
    marks = [F.when(c("l_linenumber") % (i + 2) == 0, F.lit(n)) for i, n in enumerate(["bud", "junction", "endpoint", "root"])]
    other = [F.when(c("l_partkey") % (i + 2) == 0, F.lit(n)) for i, n in enumerate(["bud", "junction", "endpoint", "root"])]
    l = fx.lines(s, sf).select("sample_id", "segment_id", F.array_compact(F.array(*marks)).alias("a"), F.array_compact(F.array(*other)).alias("b"))
    return l.select("sample_id", "segment_id", graph.candidate_type(c("a"), c("b")).alias("built"), graph.candidate_type(c("a"), c("b"), True).alias("exported"))


def _type_sql(root: bool) -> str:
    has = lambda col, i: f"({col} % {i + 2} = 0)"
    A, B = "l_linenumber", "l_partkey"
    j = lambda col: f"({has(col, 1)} OR {has(col, 3)})" if root else has(col, 1)
    bud, end = (lambda x: has(x, 0)), (lambda x: has(x, 2))
    e = lambda f, g: f"(({f(A)} AND {g(B)}) OR ({f(B)} AND {g(A)}))"
    return (f"CASE WHEN {bud(A)} AND {bud(B)} THEN 'bud--bud' WHEN {e(bud, j)} THEN 'junction--bud' WHEN {e(bud, end)} THEN 'bud--endpoint' WHEN {e(j, end)} THEN 'junction--endpoint' WHEN {j(A)} AND {j(B)} THEN 'junction--junction' END")


def _depth(s, sf):
    seg, roots, _ = segments(s, sf)
    return graph.bfs_depth(seg, roots)


def _distance(s, sf):
    seg, roots, _ = segments(s, sf)
    return rounded(graph.root_distance(seg.select("sample_id", c("start_node").alias("src"), c("end_node").alias("dst"), "length_px"), roots))


def _orient(s, sf):
    seg, roots, _ = segments(s, sf)
    d = graph.root_distance(seg.select("sample_id", c("start_node").alias("src"), c("end_node").alias("dst"), "length_px"), roots)
    return graph.orient(seg, d)


def _fate(s, sf):
    seg, roots, nodes = segments(s, sf)
    cut = seg.filter("n_edges % 3 = 0").select("sample_id", "segment_id")
    return graph.propagate_fate(seg, cut, nodes.filter("y > 14"))


def family(s, sf):
    """Groups as a forest: every vector hangs on the one with half its number inside the sample."""
    g = c("group_id") % 8
    return fx.groups(s, sf).select("sample_id", "group_id", "group_type", F.when(g > 0, c("group_id") - g + F.floor(g / 2)).alias("parent_group_id"))


def _budless(s, sf):
    att = fx.paths(s, sf).select("sample_id", "group_id", F.abs(F.get("poly", 0).x).alias("distance"))
    return graph.prune_budless(family(s, sf), att.filter("group_id % 8 > 2"), 60.0)


def _validity(s, sf):
    nodes, edges = base(s, sf)
    return graph.tree_validity(nodes, edges, graph.components(nodes, edges))


def _core(s, sf):
    return graph.two_core(base(s, sf)[1])


def _dag(s, sf):
    e = graph.group_edges(fx.groups(s, sf))
    turned = e.select("sample_id", F.when(c("group_id") % 8 == 0, c("src")).otherwise(c("dst")).alias("src"), F.when(c("group_id") % 8 == 0, c("dst")).otherwise(c("src")).alias("dst"))
    return graph.is_dag(turned)


def _owners(s, sf):
    nodes, edges = base(s, sf)
    anchors = fx.groups(s, sf).filter("group_id % 8 IN (1, 3, 5)").select("sample_id", graph.node_key(F.get("points", 0).x, F.get("points", 0).y).alias("node_id"), c("group_id").alias("owner"))
    return graph.assign_owners(nodes, edges, anchors)


def _contract(s, sf):
    t, _, _ = traced(s, sf)
    e = graph.segment_edges(t)
    owners = graph.group_edges(fx.groups(s, sf))
    keyed = e.select("sample_id", "segment_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    sg = keyed.join(owners, ["sample_id", "src", "dst"]).select("sample_id", "segment_id", "group_id").distinct()
    return graph.contract(sg, graph.segment_table(e))


def _typed(s, sf):
    nodes, edges = base(s, sf)
    owners = graph.group_vertices(fx.groups(s, sf)).join(fx.groups(s, sf).select("sample_id", "group_id", "group_type"), ["sample_id", "group_id"])
    return graph.typed_nodes(nodes, edges, owners)


def _anchor(s, sf):
    g = fx.groups(s, sf).withColumn("edges", graph.linear_chain(c("points")))
    a = g.filter("group_id % 3 = 0").select("sample_id", "group_id", F.lit(99.0).alias("x"), F.lit(98.0).alias("y"), (c("group_id") % 5).cast("int").alias("attach_pos"))
    return graph.group_edges(graph.prepend_anchor(g, a))


def _families(s, sf):
    e = graph.group_edges(fx.groups(s, sf)).withColumn("group_id", F.concat_ws("_root_", F.floor(c("group_id") / 2).cast("string"), (c("group_id") % 2).cast("string")))
    return graph.merge_families(e)


def _uncross(s, sf):
    nodes, edges = base(s, sf)
    d = graph.degrees(nodes, edges)
    members = d.filter("degree >= 4").select("sample_id", "node_id", (c("x") + 200).alias("cluster_id"))
    outside = d.filter("degree < 4 AND y > 0").select("sample_id", c("node_id").alias("arm_node"))
    touching = graph.half_edges(edges.select("sample_id", "src", "dst")).join(members.withColumnRenamed("node_id", "src"), ["sample_id", "src"]).select("sample_id", "cluster_id", c("dst").alias("arm_node")).distinct()
    pairings = touching.join(outside, ["sample_id", "arm_node"], "left_semi").withColumn("pair_no", c("arm_node") % 3)
    return graph.uncross(edges, members, pairings)


ANG = """av AS (SELECT h.sample_id, h.src AS node_id, h.dst AS other, round(atan2((dst % 4194304 - src % 4194304)::DOUBLE, (floor(dst / 4194304) - floor(src / 4194304))::DOUBLE) * 1e9)::BIGINT AS t0 FROM h),
 aw AS (SELECT *, (t0 + 6283185308) % 6283185308 AS t FROM av),
 pr AS (SELECT a.sample_id, a.node_id, least(abs(a.t - b.t), 6283185308 - abs(a.t - b.t)) AS d FROM aw a JOIN aw b ON a.sample_id = b.sample_id AND a.node_id = b.node_id AND a.other < b.other)"""

QUERIES = [
    Query("graph_nodes", lambda s, sf: graph.build_graph(fx.groups(s, sf))[0], V + "SELECT sample_id, node_id, any_value(x) AS x, any_value(y) AS y, count(DISTINCT group_id) AS groups FROM vertices GROUP BY sample_id, node_id"),
    Query("graph_edges", lambda s, sf: graph.build_graph(fx.groups(s, sf))[1], V + "SELECT sample_id, src, dst, count(*) AS groups FROM gedges GROUP BY ALL"),
    Query("components", lambda s, sf: graph.components(*base(s, sf)), VR + " SELECT * FROM comp"),
    Query("choose_roots", lambda s, sf: rooted(s, sf)[3], VR + " SELECT * FROM root"),
    Query("landmarks", _landmarks, VR + """ SELECT sample_id, node_id, degree, CASE WHEN concat_ws(',', CASE WHEN degree <= 1 THEN 'endpoint' END, CASE WHEN degree >= 3 THEN 'junction' END, CASE WHEN r THEN 'root' END) = '' THEN 'anchor'
        ELSE concat_ws(',', CASE WHEN degree <= 1 THEN 'endpoint' END, CASE WHEN degree >= 3 THEN 'junction' END, CASE WHEN r THEN 'root' END) END AS types
        FROM (SELECT dg.*, EXISTS (SELECT 1 FROM root WHERE root.sample_id = dg.sample_id AND root.node_id = dg.node_id) AS r FROM dg) z WHERE degree <> 2 OR r"""),
    Query("trace_segments", lambda s, sf: traced(s, sf)[0], VR + f", {TRACE} SELECT * FROM tr"),
    Query("segment_table", lambda s, sf: rounded(segments(s, sf)[0]), VR + f", {TRACE} SELECT sample_id, segment_id, start_node, end_node, n_edges, {rsql('length_px', 'length_px')}, {rsql('sqrt((floor(start_node / 4194304) - floor(end_node / 4194304)) ** 2 + (start_node % 4194304 - end_node % 4194304) ** 2)', 'chord_px')} FROM seg"),
    Query("candidate_type", _types, fx.with_views("lines") + f"SELECT sample_id, segment_id, {_type_sql(False)} AS built, {_type_sql(True)} AS exported FROM lines"),
    Query("split_at_events", _split, VR + f", {TRACE}, {SPLIT_SQL} SELECT sample_id, segment_id, piece, {rsql('arc', 'start_arc_px')}, {rsql('e_arc', 'end_arc_px')}, eid AS start_event, e_eid AS end_event, merged AS start_merged, e_m AS end_merged FROM pc WHERE e_arc - arc > 1e-6"),
    Query("line_graph_degrees", lambda s, sf: graph.line_graph_degrees(segments(s, sf)[0]),
          VR + f""", {TRACE}, inc AS (SELECT DISTINCT sample_id, segment_id, unnest([start_node, end_node]) AS node FROM seg), adj AS (SELECT DISTINCT a.sample_id, a.segment_id, b.segment_id AS other FROM inc a JOIN inc b ON a.sample_id = b.sample_id AND a.node = b.node AND a.segment_id <> b.segment_id)
          SELECT s.sample_id, s.segment_id, count(other) AS neighbors FROM seg s LEFT JOIN adj ON adj.sample_id = s.sample_id AND adj.segment_id = s.segment_id GROUP BY ALL"""),
    Query("bfs_depth", _depth,
          VR + f""", {TRACE}, inc AS (SELECT DISTINCT sample_id, segment_id, unnest([start_node, end_node]) AS node FROM seg), adj AS (SELECT DISTINCT a.sample_id, a.segment_id, b.segment_id AS other FROM inc a JOIN inc b ON a.sample_id = b.sample_id AND a.node = b.node AND a.segment_id <> b.segment_id),
          bf AS (SELECT DISTINCT inc.sample_id, segment_id, 0::BIGINT AS d FROM inc JOIN root ON root.sample_id = inc.sample_id AND root.node_id = inc.node UNION SELECT b.sample_id, adj.other, d + 1 FROM bf b JOIN adj ON adj.sample_id = b.sample_id AND adj.segment_id = b.segment_id WHERE d < 40),
          sh AS (SELECT sample_id, segment_id, min(d) AS d FROM bf GROUP BY ALL)
          SELECT seg.sample_id, seg.segment_id, coalesce(sh.d, (SELECT max(d) + 1 FROM sh q WHERE q.sample_id = seg.sample_id)) AS depth FROM seg LEFT JOIN sh ON sh.sample_id = seg.sample_id AND sh.segment_id = seg.segment_id"""),
    Query("root_distance", _distance),
    Query("orient_segments", _orient),
    Query("propagate_fate", _fate),
    Query("prune_budless", _budless,
          V.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + """, fam AS (SELECT DISTINCT sample_id, group_id, CASE WHEN group_id % 8 = 0 THEN 'trunk' ELSE 'branch' END AS group_type, CASE WHEN group_id % 8 > 0 THEN group_id - group_id % 8 + (group_id % 8) // 2 END AS parent FROM vertices),
          bud AS (SELECT vec_id AS group_id FROM embeddings WHERE vec_id % 8 > 2 AND abs(embedding[1]::DOUBLE * 1000) <= 60),
          up AS (SELECT group_id FROM bud UNION SELECT parent FROM up JOIN fam USING (group_id) WHERE parent IS NOT NULL)
          SELECT sample_id, group_id, group_type, group_id IN (SELECT group_id FROM up) AS has_bud, group_type = 'trunk' OR group_id IN (SELECT group_id FROM up) AS keep FROM fam"""),
    Query("tree_validity", _validity,
          VR + """, n AS (SELECT d.sample_id, count(*) AS nodes, max(degree) AS max_degree, count_if(d.node_id = component_id) AS components, count_if(degree = 0) AS isolated_nodes, count_if(degree >= 3) AS junctions, count_if(degree = 1) AS endpoints FROM dg d JOIN comp USING (sample_id, node_id) GROUP BY 1),
          e AS (SELECT sample_id, count(*) AS edges FROM uedges GROUP BY 1) SELECT n.sample_id, nodes, edges, components, edges - nodes + components AS cycle_rank, max_degree, isolated_nodes, junctions, endpoints, components = 1 AND edges = nodes - 1 AS is_tree FROM n JOIN e USING (sample_id)"""),
    Query("two_core", _core),
    Query("is_dag", _dag),
    Query("assign_owners", _owners,
          V.replace("WITH ", "WITH RECURSIVE ", 1).rstrip() + f""", {H}, anc AS (SELECT sample_id, node_id, min(group_id) AS owner FROM vertices WHERE pos = 0 AND group_id % 8 IN (1, 3, 5) GROUP BY ALL),
          fl AS (SELECT sample_id, node_id, owner, 0::BIGINT AS hops FROM anc UNION SELECT f.sample_id, h.dst, owner, hops + 1 FROM fl f JOIN h ON h.sample_id = f.sample_id AND h.src = f.node_id WHERE hops < 45),
          b AS (SELECT sample_id, node_id, arg_min(owner, (hops, owner)) AS owner, min(hops) AS hops FROM fl GROUP BY ALL) SELECT n.sample_id, n.node_id, owner, hops FROM unodes n LEFT JOIN b ON b.sample_id = n.sample_id AND b.node_id = n.node_id"""),
    Query("contract_groups", _contract,
          VR + f""", {TRACE}, sg AS (SELECT DISTINCT tr.sample_id, start_node, first_node, end_node, group_id FROM tr JOIN gedges g ON g.sample_id = tr.sample_id AND g.src = least(tr.src, tr.dst) AND g.dst = greatest(tr.src, tr.dst)),
          meet AS (SELECT DISTINCT sample_id, unnest([start_node, end_node]) AS node, group_id FROM sg) SELECT DISTINCT a.sample_id, a.group_id AS group_a, b.group_id AS group_b FROM meet a JOIN meet b ON a.sample_id = b.sample_id AND a.node = b.node AND a.group_id < b.group_id"""),
    Query("typed_nodes", _typed,
          V + f"""SELECT * FROM (WITH {H}, o AS (SELECT sample_id, node_id, bool_and(group_id % 8 = 0) AS t FROM vertices GROUP BY ALL)
          SELECT dg.sample_id, dg.node_id, degree, CASE WHEN t THEN 'trunk' WHEN degree >= 3 THEN 'junction' WHEN degree <= 1 THEN 'endpoint' ELSE 'path' END AS node_type FROM dg JOIN o USING (sample_id, node_id)) z"""),
    Query("prepend_anchor", _anchor,
          V + """SELECT sample_id, group_id, src, dst FROM gedges UNION SELECT sample_id, group_id, least(node_id, 1048675 * 4194304::BIGINT + 1048674), greatest(node_id, 1048675 * 4194304::BIGINT + 1048674) FROM vertices WHERE group_id % 3 = 0 AND pos = group_id % 5"""),
    Query("merge_families", _families, V + "SELECT DISTINCT sample_id, CAST(group_id // 2 AS VARCHAR) AS group_id, src, dst FROM gedges"),
    Query("uncross", _uncross,
          V + f"""SELECT * FROM (WITH {H}, mb AS (SELECT sample_id, node_id, x + 200 AS cl FROM dg WHERE degree >= 4), o AS (SELECT sample_id, node_id FROM dg WHERE degree < 4 AND y > 0),
          e AS (SELECT u.*, a.cl AS ca, b.cl AS cb FROM uedges u LEFT JOIN mb a ON a.sample_id = u.sample_id AND a.node_id = src LEFT JOIN mb b ON b.sample_id = u.sample_id AND b.node_id = dst),
          x AS (SELECT DISTINCT sample_id, coalesce(ca, cb) AS cl, CASE WHEN ca IS NULL THEN src ELSE dst END AS arm FROM e WHERE (ca IS NULL) <> (cb IS NULL)),
          n AS (SELECT x.sample_id, arm, cl, CASE WHEN o.node_id IS NOT NULL THEN arm % 3 END AS pair FROM x LEFT JOIN o ON o.sample_id = x.sample_id AND o.node_id = arm)
          SELECT sample_id, src, dst, NULL::BIGINT AS cluster_id, NULL::BIGINT AS pair_no FROM e WHERE ca IS NULL AND cb IS NULL UNION ALL SELECT DISTINCT sample_id, arm, NULL::BIGINT, cl, pair FROM n) z"""),
    Query("angle_priors", lambda s, sf: rounded(graph.fit_angle_priors(base(s, sf)[1]).withColumns({"mean_deg": F.round("mean_deg", 4), "std_deg": F.round("std_deg", 4)})),
          V + f"""SELECT * FROM (WITH {H}, {ANG}, k AS (SELECT CASE WHEN d >= round(120.0 * 6283185308 / 360) THEN 'crossing' WHEN d >= round(15.0 * 6283185308 / 360) THEN 'branching' END AS kind, d * 360.0 / 6283185308 AS a FROM pr)
          SELECT kind, count(*) AS pairs, round(avg(a), 4) AS mean_deg, round(greatest(stddev_pop(a), 1), 4) AS std_deg FROM k WHERE kind IS NOT NULL GROUP BY kind) z"""),
    Query("incident_angles", lambda s, sf: rounded(graph.incident_angles(base(s, sf)[1])),
          V + f"""SELECT * FROM (WITH {H}, {ANG} SELECT sample_id, node_id, {rsql('min(d) * 360.0 / 6283185308', 'min_angle')}, {rsql('max(d) * 360.0 / 6283185308', 'max_angle')} FROM pr GROUP BY ALL) z"""),
]
