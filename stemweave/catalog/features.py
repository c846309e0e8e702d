"""Feature, region, context and overlay queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, rsql, table
from stemweave.operators import features, graph
from stemweave.plans.durable import written

c = F.col
NUM = ["l_quantity", "l_extendedprice", "l_discount"]
DIAG = math.hypot(1000, 800)
TYPES = ["bud", "junction", "endpoint", "root"]


def kinds(v, shift: int):
    return F.array_compact(F.array(*[F.when((v + shift) % (i + 2) == 0, F.lit(n)) for i, n in enumerate(TYPES)]))


def segments(s, sf):
    """Embeddings as segments with polylines, landmarks, groups and labels that follow their number."""
    v = c("group_id")
    p = fx.paths(s, sf).select(
        "sample_id", v.alias("segment_id"), F.transform("poly", lambda q: F.struct((q.x + 500).alias("x"), (q.y + 400).alias("y"))).alias("polyline"),
        (F.floor(v % 8 / 2)).alias("start_node"), (v % 3 + 2).alias("end_node"), kinds(v, 0).alias("start_types"), kinds(v, 1).alias("end_types"),
        F.array(F.concat(F.lit("a"), (v % 4).cast("string")), F.concat(F.lit("b"), (v % 3).cast("string"))).alias("group_ids"),
        (v % 7 != 0).cast("int").alias("is_candidate"), (v % 5 != 0).cast("int").alias("label_mask"), (v % 3 == 0).cast("int").alias("is_cut_segment"),
    )
    from stemweave.functions.geometry import poly_length

    return p.withColumn("candidate_type", graph.candidate_type(c("start_types"), c("end_types"), True)).withColumn("length_px", poly_length(c("polyline")))


def buds(s, sf):
    at = F.explode(F.sequence(F.lit(0), (c("group_id") % 5).cast("int"))).alias("i")
    q = fx.paths(s, sf).filter("group_id % 6 <> 0").select("sample_id", c("group_id").alias("segment_id"), "poly", at)
    p = F.get("poly", c("i"))
    return q.select(
        "sample_id", "segment_id", (c("i") % 2).alias("label"), (F.abs(p.x) / 300).alias("score"), F.when(c("i") != 3, F.abs(p.y)).alias("distance"),
        (c("i") % 2 == 0).alias("is_reliable"), F.lit(0.6).alias("vx"), F.lit(0.8).alias("vy"),
    )


def _full(s, sf):
    seg = written(segments(s, sf), "segments")
    images = seg.select("sample_id").distinct().select("sample_id", F.lit(1000).alias("width"), F.lit(800).alias("height"))
    depths = seg.select("sample_id", "segment_id", (c("segment_id") % 4).alias("depth"))
    branches = seg.select("sample_id", F.explode("group_ids").alias("group_id")).distinct().filter("group_id LIKE 'a%'").select(
        "sample_id", "group_id", (c("sample_id") % 7 / 10.0).alias("local_crowding"), (F.substring("group_id", 2, 1).cast("double") / 5).alias("relative_height"), F.lit(0.25).alias("bud_density"))
    return features.segment_features(seg, images, depths, buds(s, sf), branches)


def _small(s, sf):
    seg = segments(s, sf)
    return rounded(features.segment_features_min(seg, seg.select("sample_id").distinct().select("sample_id", F.lit(1000).alias("width"), F.lit(800).alias("height"))))


def type_has(v: str, i: int) -> str:
    return f"(({v}) % {i + 2} = 0)"


A, B = "group_id", "group_id + 1"
HAS = {side: {n: type_has(v, i) for i, n in enumerate(TYPES)} for side, v in (("start", A), ("end", B))}
J = {side: f"({HAS[side]['junction']} OR {HAS[side]['root']})" for side in HAS}


def both(x: str, y: str) -> str:
    pick = lambda side, n: J[side] if n == "junction" else HAS[side][n]
    return f"(({pick('start', x)} AND {pick('end', y)}) OR ({pick('end', x)} AND {pick('start', y)}))"


CT = f"CASE WHEN {HAS['start']['bud']} AND {HAS['end']['bud']} THEN 'bud--bud' WHEN {both('bud', 'junction')} THEN 'junction--bud' WHEN {both('bud', 'endpoint')} THEN 'bud--endpoint' WHEN {both('junction', 'endpoint')} THEN 'junction--endpoint' WHEN {J['start']} AND {J['end']} THEN 'junction--junction' ELSE '' END"
FULL_SQL = fx.with_views("path_points", "path_edges") + f""", pp AS (SELECT sample_id, group_id, arg_min(x, pos) + 500 AS ax, arg_min(y, pos) + 400 AS ay, arg_max(x, pos) + 500 AS bx, arg_max(y, pos) + 400 AS cy, avg(x) + 500 AS mx, avg(y) + 400 AS my,
   min(x) + 500 AS x_lo, max(x) + 500 AS x_hi, min(y) + 400 AS y_lo, max(y) + 400 AS y_hi FROM path_points GROUP BY ALL),
 ln AS (SELECT group_id, sum(len) AS len FROM path_edges GROUP BY 1),
 tn AS (SELECT group_id, x1 - x0 AS dx, y1 - y0 AS dy, len, lead(x1 - x0) OVER w AS ex, lead(y1 - y0) OVER w AS ey, lead(len) OVER w AS elen FROM path_edges WINDOW w AS (PARTITION BY group_id ORDER BY pos)),
 ta AS (SELECT group_id, avg(a) AS cm, max(a) AS cx FROM (SELECT group_id, acos(greatest(-1.0, least(1.0, (dx * ex + dy * ey) / (len * elen)))) AS a FROM tn WHERE elen > 0 AND len > 0) q GROUP BY 1),
 sg AS (SELECT pp.*, len, cm, cx, group_id % 8 // 2 AS sn, group_id % 3 + 2 AS en, sqrt((bx - ax) ** 2 + (cy - ay) ** 2) AS ch, {CT} AS ct FROM pp JOIN ln USING (group_id) JOIN ta USING (group_id)),
 inc AS (SELECT sample_id, group_id, sn AS node FROM sg UNION ALL SELECT sample_id, group_id, en FROM sg),
 adj AS (SELECT DISTINCT a.sample_id, a.group_id, b.group_id AS other FROM inc a JOIN inc b ON a.sample_id = b.sample_id AND a.node = b.node AND a.group_id <> b.group_id),
 nb AS (SELECT adj.sample_id, adj.group_id, count(*) AS n, sum((other % 5 <> 0)::INT) AS cn, avg(len) AS ml FROM adj JOIN ln ON ln.group_id = other GROUP BY ALL),
 dgr AS (SELECT sample_id, node, count(*) AS d FROM inc GROUP BY ALL),
 dp AS (SELECT sample_id, max(group_id % 4) AS md, count(*) AS ns FROM sg GROUP BY 1),
 og AS (SELECT sample_id, group_id, concat('a', group_id % 4) AS g FROM sg UNION ALL SELECT sample_id, group_id, concat('b', group_id % 3) FROM sg),
 gs AS (SELECT sample_id, g, count(*) AS n FROM og GROUP BY ALL),
 gm AS (SELECT og.sample_id, group_id, max(n) AS gsz, avg(CASE WHEN og.g LIKE 'a%' THEN og.sample_id % 7 / 10.0 END) AS lc, avg(CASE WHEN og.g LIKE 'a%' THEN substr(og.g, 2, 1)::DOUBLE / 5 END) AS rh, avg(CASE WHEN og.g LIKE 'a%' THEN 0.25 END) AS bd FROM og JOIN gs ON gs.sample_id = og.sample_id AND gs.g = og.g GROUP BY ALL),
 bd AS (SELECT p.group_id, count(*) AS n, count_if(pos % 2 = 0) AS fl, avg(abs(x) / 300) AS sm, avg(CASE WHEN pos <> 3 THEN abs(y) ELSE 0 END) AS dm, count_if(pos % 2 = 0) AS rl,
   avg(CASE WHEN pos % 2 = 0 THEN abs((bx - ax) / ch * 0.6 + (cy - ay) / ch * 0.8) END) AS al FROM path_points p JOIN sg ON sg.group_id = p.group_id WHERE p.group_id % 6 <> 0 AND pos <= p.group_id % 5 GROUP BY 1)
 SELECT sg.sample_id, sg.group_id AS segment_id, ct AS candidate_type, concat('a', sg.group_id % 4, ';b', sg.group_id % 3) AS group_ids, (sg.group_id % 3 = 0)::INT AS is_cut_segment, (sg.group_id % 5 <> 0 AND sg.group_id % 7 <> 0)::INT AS label_mask,
 """ + ", ".join([
    rsql(f"len / {DIAG}", "length_norm"), rsql(f"ch / {DIAG}", "chord_norm"), rsql("len / greatest(ch, 1)", "tortuosity"), rsql("cm", "curvature_mean"), rsql("cx", "curvature_max"),
    rsql("mx / 1000", "mid_x_norm"), rsql("1 - my / 800", "relative_height"), rsql("(bx - ax) / ch", "orientation_x"), rsql("(cy - ay) / ch", "orientation_y"),
    rsql(f"greatest(least(x_lo, y_lo, 999 - x_hi, 799 - y_hi), 0) / {DIAG}", "image_edge_distance_norm"), "0.0::DOUBLE AS roi_edge_distance_norm",
    rsql("(sg.group_id % 4) / (CASE WHEN md > 0 THEN md ELSE 1 END)", "root_depth_norm"), rsql("coalesce(nb.n, 0)", "neighbor_count"), rsql("coalesce(cn, 0)", "candidate_neighbor_count"), rsql(f"coalesce(ml, 0) / {DIAG}", "neighbor_length_mean_norm"),
    rsql("gsz / ns", "same_group_segment_count_norm"), rsql("d1.d", "start_degree"), rsql("d2.d", "end_degree"),
    *[rsql(f"({(J if n == 'junction' else {k: HAS[k][n] for k in HAS})[side].replace('group_id', 'sg.group_id')})::INT", f"{side}_{n}") for n in ("bud", "junction", "endpoint") for side in ("start", "end")],
    *[rsql(f"(ct = '{t}')::INT", "candidate_" + t.replace("--", "_")) for t in ("bud--bud", "junction--bud", "bud--endpoint", "junction--endpoint", "junction--junction")],
    rsql("coalesce(bd.n, 0) / 10.0", "bud_count_norm"), rsql("coalesce(bd.n, 0) / greatest(len, 1) * 100", "bud_density_norm"), rsql("coalesce(fl, 0) / greatest(coalesce(bd.n, 0), 1)", "flower_bud_ratio"), rsql("coalesce(sm, 0)", "bud_score_mean"),
    rsql(f"coalesce(dm, 0) / {DIAG}", "bud_attachment_distance_norm"), rsql("coalesce(rl, 0) / greatest(coalesce(bd.n, 0), 1)", "reliable_direction_ratio"), rsql("coalesce(al, 0)", "bud_direction_alignment"),
    rsql("lc", "local_crowding"), rsql("rh", "group_relative_height"), rsql("gm.bd", "group_bud_density"),
]) + """ FROM sg LEFT JOIN nb ON nb.group_id = sg.group_id JOIN dp ON dp.sample_id = sg.sample_id JOIN gm ON gm.group_id = sg.group_id LEFT JOIN bd ON bd.group_id = sg.group_id
 JOIN dgr d1 ON d1.sample_id = sg.sample_id AND d1.node = sn JOIN dgr d2 ON d2.sample_id = sg.sample_id AND d2.node = en"""


def rows(s, sf):
    """Lines as a segment table: groups are brand and type of the part, joined by a semicolon."""
    parts = table(s, sf, "part").select(c("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    l = fx.lines(s, sf)
    kind = F.when(c("l_linenumber") % 3 == 0, "junction--bud").when(c("l_linenumber") % 3 == 1, "bud--bud").otherwise("junction--junction")
    return l.join(parts, "l_partkey").select(
        "tree_id", (c("sample_id") % 3).alias("view"), "sample_id", "segment_id", kind.alias("candidate_type"), c("label").alias("is_cut_segment"),
        F.when(c("tree_id") % 5 == 0, "test").otherwise("train").alias("split"), F.concat_ws(";", F.when(c("l_linenumber") % 4 == 0, "trunk").otherwise(c("p_brand")), "p_type").alias("group_ids"), *NUM)


ROWS = """rw AS (SELECT tree_id, sample_id % 3 AS view, sample_id, segment_id, CASE l_linenumber % 3 WHEN 0 THEN 'junction--bud' WHEN 1 THEN 'bud--bud' ELSE 'junction--junction' END AS candidate_type, label AS is_cut_segment,
  CASE WHEN tree_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN l_linenumber % 4 = 0 THEN 'trunk' ELSE p_brand END AS g1, p_type AS g2, l_quantity, l_extendedprice, l_discount FROM lines JOIN part ON p_partkey = l_partkey),
 ex AS (SELECT *, g1 AS group_id FROM rw WHERE g1 <> 'trunk' UNION ALL SELECT *, g2 FROM rw)"""


def _branch(s, sf):
    p = fx.paths(s, sf)
    at = F.transform(F.sequence(F.lit(0), F.size("poly") - 2), lambda i: F.array(i, i + 1))
    groups = p.select("sample_id", "group_id", F.when(c("group_id") % 8 == 0, "trunk").otherwise("branch").alias("group_type"), c("poly").alias("points"), at.alias("edges"))
    b = buds(s, sf).select("sample_id", c("segment_id").alias("group_id"), "label")
    images = p.select("sample_id").distinct().select("sample_id", F.lit(1000).alias("width"), F.lit(800).alias("height"))
    crowd = p.filter("group_id % 2 = 0").select("sample_id", "group_id", (c("group_id") % 9 / 10.0).alias("crowding"))
    return rounded(features.branch_features(groups, b, images, crowd))


def _neighbors(s, sf):
    seg = segments(s, sf)
    return rounded(features.neighbor_mean(seg.select("sample_id", "segment_id", "length_px", (c("segment_id") % 5).cast("double").alias("v")), seg, ["length_px", "v"]))


def _embedding(s, sf):
    docs = table(s, sf, "documents").select(c("doc_id").alias("segment_id"), "lang")
    emb = table(s, sf, "embeddings").filter("label <> 3").select(c("vec_id").alias("segment_id"), "embedding")
    out = features.append_embedding(docs, emb, ["segment_id"], 64)
    return rounded(out.select("segment_id", "lang", F.size("embedding").cast("long").alias("dim"), F.get("embedding", 5).alias("v5"), F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v).alias("total")))


def _aspect(s, sf):
    b = fx.boxes(s, sf)
    df = b.select(c("view").alias("sample_id"), c("box_id").alias("segment_id"))
    values = features.mean_aspect(b.select(c("view").alias("sample_id"), "label", (c("x2") - c("x1")).alias("aspect_ratio")), ["sample_id"])
    return rounded(features.append_feature(df, values, ["sample_id"], "mean_aspect", 1.0))


def _overlay(s, sf):
    l = fx.lines(s, sf)
    seg = l.select("sample_id", "segment_id", c("label").cast("int").alias("is_cut_segment"), (c("l_linenumber") % 2).cast("int").alias("is_candidate"), F.lit(0).alias("label_mask"))
    active = l.filter("label = 1").select("sample_id", c("l_partkey").alias("cut_id")).distinct()
    assign = l.filter("label = 1 AND l_linenumber < 6 OR l_suppkey = 7").select("sample_id", c("l_partkey").alias("cut_id"), "segment_id")
    return features.apply_overlay(seg, active, assign)


OV = """av AS (SELECT DISTINCT sample_id, l_partkey AS cut_id FROM lines WHERE label = 1), asg AS (SELECT sample_id, l_partkey AS cut_id, segment_id FROM lines WHERE label = 1 AND l_linenumber < 6 OR l_suppkey = 7),
 tk AS (SELECT sample_id, segment_id, min(cut_id) AS cut_id, count(*) AS n FROM asg GROUP BY ALL),
 ac AS (SELECT sample_id, cut_id, count(*) AS n FROM asg GROUP BY ALL)"""


def _attach_stats(s, sf):
    from stemweave.catalog.spatial import eds, pts
    from stemweave.operators import spatial

    return rounded(features.attachment_stats(spatial.assign_nearest(pts(s, sf), eds(s, sf).drop("group_id"), 16.0)))


QUERIES = [
    Query("segment_features", lambda s, sf: rounded(_full(s, sf)), FULL_SQL),
    Query("segment_features_min", _small,
          FULL_SQL.split(" SELECT sg.sample_id")[0] + f" SELECT sample_id, group_id AS segment_id, (group_id % 3 = 0)::INT AS is_cut_segment, (group_id % 5 <> 0 AND group_id % 7 <> 0)::INT AS label_mask, {rsql(f'len / {DIAG}', 'length_norm')}, (group_id % 7 <> 0)::INT::DOUBLE AS is_candidate, "
          + ", ".join(f"{HAS[side][t]}::INT::DOUBLE AS {side}_{t}" for t in features.END_TYPES for side in ("start", "end")) + " FROM sg"),
    Query("branch_features", _branch,
          fx.with_views("path_points", "path_edges") + f""", l AS (SELECT group_id, sum(len) AS len FROM path_edges GROUP BY 1), p AS (SELECT sample_id, group_id, avg(y) AS cy FROM path_points WHERE group_id % 8 <> 0 GROUP BY ALL),
          b AS (SELECT *, CASE WHEN group_id % 6 <> 0 THEN group_id % 5 + 1 ELSE 0 END AS n, CASE WHEN group_id % 6 <> 0 THEN group_id % 5 // 2 + 1 ELSE 0 END AS fl FROM p JOIN l USING (group_id))
          SELECT sample_id, group_id, {rsql(f'len / {DIAG}', 'branch_length_norm')}, {rsql('cy / 800', 'relative_height')}, n AS bud_count, {rsql('n / greatest(len, 1)', 'bud_density')}, {rsql('CASE WHEN n > 0 THEN fl / n END', 'flower_bud_ratio')}, {rsql('CASE WHEN group_id % 2 = 0 THEN group_id % 9 / 10.0 ELSE 0 END', 'local_crowding')} FROM b"""),
    Query("region_features", lambda s, sf: rounded(features.region_features(rows(s, sf), NUM)),
          fx.with_views("lines", extra=ROWS) + "SELECT tree_id, view, group_id, min(sample_id) AS sample_id, min(split) AS split, max(is_cut_segment) AS region_label, count(*) AS n_segments, sum(is_cut_segment)::BIGINT AS n_positive_segments, "
          + ", ".join(f"{rsql(f'avg({m})', f'{m}_mean')}, {rsql(f'max({m})', f'{m}_max')}" for m in NUM)
          + ", " + ", ".join(f"count_if(candidate_type = '{t}') AS cand_{t.replace('--', '_')}" for t in features.CANDIDATE_TYPES) + " FROM ex GROUP BY tree_id, view, group_id"),
    Query("neighbor_mean", _neighbors,
          FULL_SQL.split(",\n dgr AS")[0] + f" SELECT sg.sample_id, sg.group_id AS segment_id, {rsql('coalesce(avg(l2.len), 0)', 'length_px')}, {rsql('coalesce(avg(other % 5), 0)', 'v')} FROM sg LEFT JOIN adj ON adj.group_id = sg.group_id LEFT JOIN ln l2 ON l2.group_id = other GROUP BY ALL"),
    Query("view_context", lambda s, sf: rounded(features.view_context(rows(s, sf).select("sample_id", "segment_id", "l_quantity", "l_discount"), ["l_quantity", "l_discount"])),
          fx.with_views("lines") + f"SELECT sample_id, segment_id, {rsql('l_quantity', 'l_quantity')}, {rsql('l_discount', 'l_discount')}, {rsql('avg(l_quantity) OVER (PARTITION BY sample_id)', 'view_l_quantity')}, {rsql('avg(l_discount) OVER (PARTITION BY sample_id)', 'view_l_discount')} FROM lines"),
    Query("append_embedding", _embedding,
          f"SELECT doc_id AS segment_id, lang, 64::BIGINT AS dim, {rsql('coalesce(embedding[6]::DOUBLE, 0)', 'v5')}, {rsql('coalesce(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 0)', 'total')} FROM documents LEFT JOIN (SELECT * FROM embeddings WHERE label <> 3) e ON vec_id = doc_id"),
    Query("append_feature", _aspect,
          fx.with_views("boxes") + f"SELECT view AS sample_id, box_id AS segment_id, {rsql('coalesce(avg(CASE WHEN label = 1 THEN x2 - x1 END) OVER (PARTITION BY view), 1.0)', 'mean_aspect')} FROM boxes"),
    Query("missing_keys", lambda s, sf: features.missing_keys(rows(s, sf).filter("is_cut_segment = 1"), table(s, sf, "orders").select(c("o_orderkey").alias("sample_id")), ["sample_id"]),
          fx.with_views("lines") + "SELECT o_orderkey AS sample_id FROM orders WHERE o_orderkey NOT IN (SELECT sample_id FROM lines WHERE label = 1)"),
    Query("standardize", lambda s, sf: rounded(features.standardize(rows(s, sf).select("sample_id", "segment_id", "split", *NUM), NUM, c("split") == "train")),
          fx.with_views("lines") + ", st AS (SELECT " + ", ".join(f"avg({m}) AS m_{m}, stddev_samp({m}) AS s_{m}" for m in NUM) + " FROM lines WHERE tree_id % 5 <> 0) SELECT sample_id, segment_id, CASE WHEN tree_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, "
          + ", ".join(rsql(f"({m} - m_{m}) / greatest(s_{m}, 1e-6)", m) for m in NUM) + " FROM lines, st"),
    Query("attachment_stats", _attach_stats,
          fx.with_views("marks", "edges") + f""", e AS (SELECT *, (x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0) AS sq FROM edges), f AS (SELECT m.mark_id, m.px, m.py, e.*, CASE WHEN sq > 1e-6 THEN greatest(0.0, least(1.0, ((px - x0) * (x1 - x0) + (py - y0) * (y1 - y0)) / sq)) ELSE 0 END AS fr FROM marks m JOIN e ON e.sample_id = m.sample_id),
          d AS (SELECT mark_id, min(sqrt((px - x0 - fr * (x1 - x0)) ** 2 + (py - y0 - fr * (y1 - y0)) ** 2)) AS d FROM f GROUP BY 1)
          SELECT sample_id, count(*) AS buds, count(d) AS attached, count(*) - count(d) AS unattached, {rsql('count(d) / count(*)', 'attachment_rate')}, {rsql('avg(d)', 'mean_distance')} FROM marks LEFT JOIN d USING (mark_id) GROUP BY sample_id"""),
    Query("overlay_labels", lambda s, sf: _overlay(s, sf)[0],
          fx.with_views("lines", extra=OV) + "SELECT l.sample_id, l.segment_id, (tk.n IS NOT NULL)::INT AS is_cut_segment, CASE WHEN tk.n IS NOT NULL THEN 1 ELSE l_linenumber % 2 END AS is_candidate, CASE WHEN tk.n IS NOT NULL THEN 1 ELSE l_linenumber % 2 END AS label_mask, tk.cut_id FROM lines l LEFT JOIN tk ON tk.sample_id = l.sample_id AND tk.segment_id = l.segment_id"),
    Query("overlay_problems", lambda s, sf: _overlay(s, sf)[1],
          fx.with_views("lines", extra=OV) + """SELECT coalesce(av.sample_id, ac.sample_id) AS sample_id, CAST(coalesce(av.cut_id, ac.cut_id) AS VARCHAR) AS item, CASE WHEN n IS NULL THEN 'unassigned_cut' WHEN av.cut_id IS NULL THEN 'inactive_cut' ELSE 'cut_assigned_twice' END AS problem
          FROM av FULL JOIN ac ON ac.sample_id = av.sample_id AND ac.cut_id = av.cut_id WHERE n IS NULL OR av.cut_id IS NULL OR n > 1 UNION ALL SELECT sample_id, segment_id, 'segment_with_several_cuts' FROM tk WHERE n > 1"""),
]
