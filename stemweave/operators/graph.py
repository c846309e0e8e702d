"""Graphs of many samples as edge tables.

``nodes(sample_id, node_id, x, y)``, ``edges(sample_id, src, dst)`` with ``src < dst``. A node is a
rounded coordinate, its id packs both numbers, so ids need no sorting and are the same everywhere.
Memberships stay in long form (one row per node or edge and group): a vertex shared by very many
groups is many small rows, never one long array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.functions.geometry import linear_chain, norm
from stemweave.plans.durable import written
from stemweave.plans.fixpoint import fixpoint, rounds
from stemweave.plans.skew import attach_groups, running_totals
from stemweave.plans.slices import LIMIT, fit_whole, in_tasks, local_chains, local_labels, local_owners, sliced

S = ["sample_id"]
# fixed values: coordinates are packed with 22 bits each and must stay below 2^20 in size
OFFSET = 1 << 20
SHIFT = 1 << 22


def node_key(x: Column, y: Column) -> Column:
    """One 64-bit number for a pixel."""
    rx, ry = F.rint(x).cast("long"), F.rint(y).cast("long")
    fits = (F.abs(rx) < OFFSET) & (F.abs(ry) < OFFSET)
    return F.when(fits, (rx + OFFSET) * SHIFT + (ry + OFFSET)).otherwise(F.raise_error(F.lit("coordinate out of range")).cast("long"))


def node_x(node: Column) -> Column:
    return F.floor(node / SHIFT).cast("long") - OFFSET


def node_y(node: Column) -> Column:
    return node % SHIFT - OFFSET


def group_vertices(groups: DataFrame) -> DataFrame:
    """``(sample_id, group_id, node_id)``, distinct, from ``groups(sample_id, group_id, points, edges)``."""
    return groups.select("sample_id", "group_id", F.explode("points").alias("p")).select(
        "sample_id", "group_id", node_key(F.col("p.x"), F.col("p.y")).alias("node_id")
    ).distinct()


def group_edges(groups: DataFrame) -> DataFrame:
    """``(sample_id, group_id, src, dst)``, distinct; bad indices and self loops are dropped."""
    pairs = F.when(F.coalesce(F.size("edges"), F.lit(0)) > 0, F.col("edges")).otherwise(linear_chain(F.col("points")))
    ends = groups.withColumn("_e", F.explode(pairs)).select(
        "sample_id", "group_id", F.get("points", F.get("_e", F.lit(0))).alias("a"), F.get("points", F.get("_e", F.lit(1))).alias("b")
    ).filter("a IS NOT NULL AND b IS NOT NULL")
    keyed = ends.select("sample_id", "group_id", node_key(F.col("a.x"), F.col("a.y")).alias("a"), node_key(F.col("b.x"), F.col("b.y")).alias("b"))
    return keyed.filter("a <> b").select("sample_id", "group_id", F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def build_graph(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and undirected edges of every sample with how many groups own them."""
    nodes = group_vertices(groups).groupBy("sample_id", "node_id").agg(F.count(F.lit(1)).alias("groups"))
    nodes = nodes.select("sample_id", "node_id", node_x(F.col("node_id")).alias("x"), node_y(F.col("node_id")).alias("y"), "groups")
    edges = group_edges(groups).groupBy("sample_id", "src", "dst").agg(F.count(F.lit(1)).alias("groups"))
    return nodes, edges


def half_edges(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    both = F.explode(F.array(F.struct(F.col("src").alias("u"), F.col("dst").alias("v")), F.struct(F.col("dst").alias("u"), F.col("src").alias("v"))))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.withColumn("_h", both).select(*rest, F.col("_h.u").alias("src"), F.col("_h.v").alias("dst"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    d = half_edges(edges.select("sample_id", "src", "dst")).groupBy("sample_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(d, ["sample_id", "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def landmarks(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Key nodes with their types root, junction, endpoint; anchor where none applies."""
    marked = degrees(nodes, edges).join(roots.select("sample_id", "node_id").distinct().withColumn("_root", F.lit(True)), ["sample_id", "node_id"], "left")
    is_root, d = F.col("_root").isNotNull(), F.col("degree")
    types = F.array_compact(F.array(F.when(d <= 1, F.lit("endpoint")), F.when(d >= 3, F.lit("junction")), F.when(is_root, F.lit("root"))))
    kept = marked.filter((d != 2) | is_root)
    return kept.select("sample_id", "node_id", "x", "y", "degree", F.when(F.size(types) > 0, types).otherwise(F.array(F.lit("anchor"))).alias("types"))


def components(nodes: DataFrame, edges: DataFrame, keys: Sequence[str] = ("sample_id",), max_rounds: int | None = None) -> DataFrame:
    """``(keys, node_id, component_id)``: the smallest node id that can be reached.

    Samples of ordinary size are labelled inside a task. Of a sample cut into slices only the
    labels that share a node remain to be connected, by rounds over that smaller graph.
    """
    keys = list(keys)
    cut, heavy = sliced(edges.select(*keys, "src", "dst"), keys)
    types = dict(edges.dtypes)
    schema = ", ".join([f"{k} {types[k]}" for k in keys] + ["node_id bigint", "label bigint"])
    local = written(cut.mapInPandas(local_labels(keys), schema), "labels")
    low = local.groupBy(*keys, "node_id").agg(F.min("label").alias("component_id"))
    if heavy.limit(1).count():
        low = written(low, "lowest")
        links = local.join(low, [*keys, "node_id"]).filter("label <> component_id").select(*keys, F.col("component_id").alias("src"), F.col("label").alias("dst")).distinct()
        marks = local.select(*keys, F.col("label").alias("node_id")).distinct()
        joined = _spread_labels(marks, links, keys, max_rounds).select(*keys, F.col("node_id").alias("component_id"), F.col("component_id").alias("_final"))
        low = low.join(joined, [*keys, "component_id"]).select(*keys, "node_id", F.col("_final").alias("component_id"))
    return nodes.select(*keys, "node_id").distinct().join(low, [*keys, "node_id"], "left").select(*keys, "node_id", F.coalesce("component_id", "node_id").alias("component_id"))


def _spread_labels(nodes: DataFrame, edges: DataFrame, keys: list[str], max_rounds: int | None) -> DataFrame:
    """Smallest reachable node by rounds.

    Labels spread to neighbours and then jump along the label's own label, which shortens long
    chains exponentially. A hub only feeds a minimum, which is partly taken before the shuffle.
    """
    hops = written(half_edges(edges.select(*keys, "src", "dst")), "hops")
    start = nodes.select(*keys, "node_id", F.col("node_id").alias("component_id")).distinct()

    def spread(state: DataFrame) -> DataFrame:
        seen = hops.join(state.select(*keys, F.col("node_id").alias("dst"), F.col("component_id").alias("_n")), [*keys, "dst"])
        lowest = seen.groupBy(*keys, F.col("src").alias("node_id")).agg(F.min("_n").alias("_n"))
        lowered = state.join(lowest, [*keys, "node_id"], "left").select(
            *keys, "node_id", F.col("component_id").alias("_old"), F.least("component_id", F.coalesce("_n", "component_id")).alias("component_id")
        )
        jump = state.select(*keys, F.col("node_id").alias("component_id"), F.col("component_id").alias("_j"))
        return lowered.join(jump, [*keys, "component_id"], "left").select(
            *keys, "node_id", F.least("component_id", F.coalesce("_j", "component_id")).alias("component_id"),
            (F.least("component_id", F.coalesce("_j", "component_id")) < F.col("_old")).alias("_changed"),
        )

    return fixpoint(start, spread, max_rounds=max_rounds, tag="components")


def choose_roots(nodes: DataFrame, labels: DataFrame, trunk_nodes: DataFrame | None = None) -> DataFrame:
    """Lowest trunk node of each component (largest y), else its lowest node; ties by node id."""
    joined = nodes.select("sample_id", "node_id", "y").join(labels, ["sample_id", "node_id"])
    if trunk_nodes is not None:
        joined = joined.join(trunk_nodes.select("sample_id", "node_id").distinct().withColumn("_t", F.lit(1)), ["sample_id", "node_id"], "left")
    else:
        joined = joined.withColumn("_t", F.lit(None).cast("int"))
    place = F.struct(F.coalesce("_t", F.lit(0)).alias("t"), F.col("y"), (-F.col("node_id")).alias("neg"))
    return joined.groupBy("sample_id", "component_id").agg(F.max(place).alias("b")).select("sample_id", "component_id", (-F.col("b.neg")).alias("node_id"))


def trace_segments(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Edges of the graph with the degree-2 chain they belong to.

    Every directed edge that enters a degree-2 node points to the edge leaving it; pointer doubling
    finds the last edge of each chain and its distance in a logarithmic number of rounds. Seen from
    the reversed edge this is the chain's first edge and the position in it. Of the two directions
    the one with the smaller first edge is kept. A ring without a root has no end and gives no segment.

    Result: ``(sample_id, start_node, first_node, pos, src, dst)``; (start_node, first_node) names
    the chain and ``pos`` counts its edges from 0.
    """
    marked = written(degrees(nodes, edges).join(roots.select("sample_id", "node_id").distinct().withColumn("_root", F.lit(True)), ["sample_id", "node_id"], "left").select(
        "sample_id", "node_id", ((F.col("degree") != 2) | F.col("_root").isNotNull()).alias("is_key")
    ), "keys")
    hops = written(half_edges(edges.select("sample_id", "src", "dst")), "hops")
    out = hops.select("sample_id", F.col("src").alias("dst"), F.col("dst").alias("after"))
    entering = hops.join(marked.filter(~F.col("is_key")).select("sample_id", F.col("node_id").alias("dst")), ["sample_id", "dst"])
    follow = entering.join(out, ["sample_id", "dst"]).filter("after <> src").select("sample_id", "src", "dst", "after")
    start = hops.join(follow, ["sample_id", "src", "dst"], "left").select(
        "sample_id", "src", "dst",
        F.when(F.col("after").isNull(), F.col("src")).otherwise(F.col("dst")).alias("to_src"),
        F.when(F.col("after").isNull(), F.col("dst")).otherwise(F.col("after")).alias("to_dst"),
        F.when(F.col("after").isNull(), 0).otherwise(1).cast("long").alias("hops"),
    )

    most = 2 * edges.count()  # steps of a chain; what has taken more of them runs round a ring without a root

    def double(state: DataFrame) -> DataFrame:
        ahead = state.select("sample_id", F.col("src").alias("to_src"), F.col("dst").alias("to_dst"), F.col("to_src").alias("n_src"), F.col("to_dst").alias("n_dst"), F.col("hops").alias("n_hops"))
        joined = state.join(ahead, ["sample_id", "to_src", "to_dst"]).filter(F.col("hops") <= most)
        return joined.select("sample_id", "src", "dst", F.col("n_src").alias("to_src"), F.col("n_dst").alias("to_dst"), (F.col("hops") + F.col("n_hops")).alias("hops"), (F.col("n_hops") > 0).alias("_changed"))

    ends = fixpoint(_follow_locally(start, edges), double, max_rounds=max_rounds, tag="chains")
    back = ends.select("sample_id", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("to_dst").alias("start_node"), F.col("to_src").alias("first_node"), F.col("hops").alias("pos"))
    both = ends.select("sample_id", "src", "dst", F.col("to_src").alias("last_node"), F.col("to_dst").alias("end_node")).join(back, ["sample_id", "src", "dst"])
    own, other = F.struct("start_node", "first_node"), F.struct(F.col("end_node").alias("start_node"), F.col("last_node").alias("first_node"))
    return both.filter(own <= other).select("sample_id", "start_node", "first_node", "pos", "src", "dst", "end_node")


def _follow_locally(pointers: DataFrame, edges: DataFrame) -> DataFrame:
    """Follow the pointers inside slices first; rounds are left for chains that cross slices."""
    cut, _ = sliced(pointers, S)
    schema = f"sample_id {dict(edges.dtypes)['sample_id']}, src bigint, dst bigint, to_src bigint, to_dst bigint, hops bigint"
    return written(cut.mapInPandas(local_chains(S), schema), "followed")


def segment_key(start: Column, first: Column) -> Column:
    return F.concat_ws("-", start.cast("string"), first.cast("string"))


def segment_edges(traced: DataFrame) -> DataFrame:
    """Traced edges with their segment id and end coordinates."""
    c = F.col
    return traced.select(
        "sample_id", segment_key(c("start_node"), c("first_node")).alias("segment_id"), "pos", "start_node", "end_node", "src", "dst",
        node_x(c("src")).cast("double").alias("x0"), node_y(c("src")).cast("double").alias("y0"), node_x(c("dst")).cast("double").alias("x1"), node_y(c("dst")).cast("double").alias("y1"),
    )


def segment_table(seg_edges: DataFrame) -> DataFrame:
    """One row per segment: end nodes, number of edges, arc length and chord."""
    length = F.sum(norm(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    grouped = seg_edges.groupBy("sample_id", "segment_id", "start_node", "end_node").agg(F.count(F.lit(1)).alias("n_edges"), length.alias("length_px"))
    dx = node_x(F.col("end_node")) - node_x(F.col("start_node"))
    dy = node_y(F.col("end_node")) - node_y(F.col("start_node"))
    return grouped.withColumn("chord_px", norm(dx.cast("double"), dy.cast("double")))


def candidate_type(left: Column, right: Column, root_is_junction: bool = False) -> Column:
    """Kind of a segment from the type sets of its two ends, null when none applies."""
    has = F.array_contains

    def junction(types: Column) -> Column:
        return has(types, "junction") | has(types, "root") if root_is_junction else has(types, "junction")

    bud = lambda t: has(t, "bud")
    end = lambda t: has(t, "endpoint")
    either = lambda f, g: (f(left) & g(right)) | (f(right) & g(left))
    return (
        F.when(bud(left) & bud(right), "bud--bud")
        .when(either(bud, junction), "junction--bud")
        .when(either(bud, end), "bud--endpoint")
        .when(either(junction, end), "junction--endpoint")
        .when(junction(left) & junction(right), "junction--junction")
    )


def split_at_events(segments: DataFrame, events: DataFrame, merge: float = 0.5) -> DataFrame:
    """Cut segments at events on their arc.

    ``segments(sample_id, segment_id, length_px, start_node, end_node)``, ``events(sample_id,
    segment_id, arc, event_id)``. Both ends are events too. An event within ``merge`` of the last
    kept one joins it. Whether an event is farther than ``merge`` from the one before it is found
    over the sorted events of all segments; between two such gaps the kept events follow from a fold
    over that stretch alone. Pieces are (sample_id, segment_id, piece, start_arc_px, end_arc_px,
    start_event, end_event, start_merged, end_merged).
    """
    c = F.col
    ends = segments.select("sample_id", "segment_id", F.explode(F.array(
        F.struct(F.lit(0.0).alias("arc"), F.lit(0).alias("kind"), F.lit("start").alias("event_id")),
        F.struct(c("length_px").alias("arc"), F.lit(2).alias("kind"), F.lit("end").alias("event_id")),
    )).alias("e")).select("sample_id", "segment_id", "e.*")
    inner = events.join(segments.select("sample_id", "segment_id", "length_px"), ["sample_id", "segment_id"]).select(
        "sample_id", "segment_id", F.greatest(F.lit(0.0), F.least("arc", "length_px")).alias("arc"), F.lit(1).alias("kind"), c("event_id").cast("string").alias("event_id")
    )
    keys = ["sample_id", "segment_id"]
    order = [c("arc"), c("kind"), c("event_id")]
    behind = running_totals(ends.unionByName(inner), keys, order, {"_before": c("arc")}, exclusive=True, running="max")
    breaks = running_totals(behind, keys, order, {"run": F.when(c("arc") - c("_before") > merge, 1).otherwise(0).cast("long")})
    folded = breaks.groupBy(*keys, "run").agg(F.array_sort(F.collect_list(F.struct("arc", "kind", "event_id"))).alias("list"))
    nothing = F.array().cast("array<struct<arc:double,event_id:string,merged:int>>")

    def step(acc: Column, e: Column) -> Column:
        tail = F.get(acc, F.size(acc) - 1)
        near = (F.size(acc) > 0) & (e.arc - tail.arc <= merge)
        new = F.array_append(acc, F.struct(e.arc.alias("arc"), e.event_id.alias("event_id"), F.lit(0).alias("merged")))
        joined = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(tail.arc.alias("arc"), tail.event_id.alias("event_id"), (tail.merged + 1).alias("merged")))
        return F.when(near, joined).otherwise(new)

    kept = folded.select(*keys, F.explode(F.aggregate("list", nothing, step)).alias("k")).select(*keys, "k.*")
    numbered = running_totals(kept, keys, [c("arc")], {"n": F.lit(1).cast("long")})
    nxt = numbered.select(*keys, (c("n") - 1).alias("n"), c("arc").alias("end_arc_px"), c("event_id").alias("end_event"), c("merged").alias("end_merged"))
    return numbered.join(nxt, [*keys, "n"]).filter(c("end_arc_px") - c("arc") > 1e-6).select(
        *keys, c("n").alias("piece"), c("arc").alias("start_arc_px"), "end_arc_px", c("event_id").alias("start_event"), "end_event", c("merged").alias("start_merged"), "end_merged"
    )


# --- adjacency of segments through their end nodes ---------------------------------------------------


def incidence(segments: DataFrame, *carry: str) -> DataFrame:
    """(sample_id, node_id, segment_id): a segment at each of its end nodes, once for a loop."""
    return segments.select("sample_id", "segment_id", *carry, F.explode(F.array_distinct(F.array("start_node", "end_node"))).alias("node_id"))


def neighbor_sums(segments: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Number of adjacent segments and sums of their columns, without forming pairs.

    At an end node a segment sees everything there but itself. Segments that share both end nodes
    are seen twice, so what lies between the same two nodes is taken off once.
    """
    c = F.col
    at = incidence(segments, *columns)
    node = at.groupBy("sample_id", "node_id").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_s_{v}") for v in columns])
    seen = at.join(node, ["sample_id", "node_id"]).groupBy("sample_id", "segment_id").agg(
        F.sum(c("_n") - 1).alias("_n"), *[F.sum(c(f"_s_{v}") - c(v)).alias(f"_s_{v}") for v in columns]
    )
    pair = [F.least("start_node", "end_node").alias("_lo"), F.greatest("start_node", "end_node").alias("_hi")]
    open_ = segments.filter("start_node <> end_node").select("sample_id", "segment_id", *columns, *pair)
    twin = open_.groupBy("sample_id", "_lo", "_hi").agg(F.count(F.lit(1)).alias("_m"), *[F.sum(v).alias(f"_t_{v}") for v in columns]).filter("_m > 1")
    double = open_.join(twin, ["sample_id", "_lo", "_hi"]).select("sample_id", "segment_id", (c("_m") - 1).alias("_m"), *[(c(f"_t_{v}") - c(v)).alias(f"_t_{v}") for v in columns])
    joined = seen.join(double, ["sample_id", "segment_id"], "left")
    zero = F.lit(0)
    return joined.select(
        "sample_id", "segment_id", (c("_n") - F.coalesce("_m", zero)).alias("neighbors"), *[(c(f"_s_{v}") - F.coalesce(c(f"_t_{v}"), zero)).alias(f"sum_{v}") for v in columns]
    )


def line_graph_degrees(segments: DataFrame) -> DataFrame:
    """Number of distinct segments that share an end node with a segment."""
    return neighbor_sums(segments, [])


def bfs_depth(segments: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Hops from the segments at a root node; segments out of reach get the largest depth plus one.

    Depth passes through the nodes: a node knows the smallest depth at it, its segments take that
    plus one.
    """
    at = written(incidence(segments), "incidence")
    base = at.join(roots.select("sample_id", "node_id").distinct(), ["sample_id", "node_id"], "left_semi").select("sample_id", "segment_id").distinct().withColumn("depth", F.lit(0).cast("long"))
    start = segments.select("sample_id", "segment_id").join(base, ["sample_id", "segment_id"], "left")

    def step(state: DataFrame) -> DataFrame:
        node = at.join(state.filter("depth IS NOT NULL"), ["sample_id", "segment_id"]).groupBy("sample_id", "node_id").agg(F.min("depth").alias("_d"))
        seen = at.join(node, ["sample_id", "node_id"]).groupBy("sample_id", "segment_id").agg((F.min("_d") + 1).alias("_d"))
        better = F.col("_d").isNotNull() & (F.col("depth").isNull() | (F.col("_d") < F.col("depth")))
        return state.join(seen, ["sample_id", "segment_id"], "left").select("sample_id", "segment_id", F.when(better, F.col("_d")).otherwise(F.col("depth")).alias("depth"), better.alias("_changed"))

    done = fixpoint(start, step, max_rounds=max_rounds, tag="depth")
    top = done.groupBy("sample_id").agg(F.max("depth").alias("_top"))
    return attach_groups(done, top, S).select("sample_id", "segment_id", F.coalesce("depth", F.coalesce("_top", F.lit(-1)) + 1).alias("depth"))


def root_distance(edges: DataFrame, roots: DataFrame, weight: str = "length_px", max_rounds: int | None = None) -> DataFrame:
    """Shortest weighted distance of every reachable node from its roots.

    ``edges(sample_id, src, dst, weight)``; segments serve as edges between key nodes, which keeps
    the number of rounds at the number of segments on a path.
    """
    hops = written(half_edges(edges.select("sample_id", "src", "dst", F.col(weight).alias("w"))), "hops")
    start = roots.select("sample_id", "node_id").distinct().withColumn("distance", F.lit(0.0))

    def relax(state: DataFrame) -> DataFrame:
        reach = state.join(hops, (state.sample_id == hops.sample_id) & (state.node_id == hops.src)).select(
            state.sample_id, F.col("dst").alias("node_id"), (F.col("distance") + F.col("w")).alias("distance")
        )
        best = reach.unionByName(state.select("sample_id", "node_id", "distance")).groupBy("sample_id", "node_id").agg(F.min("distance").alias("distance"))
        old = state.select("sample_id", "node_id", F.col("distance").alias("_old"))
        return best.join(old, ["sample_id", "node_id"], "left").select("sample_id", "node_id", "distance", (F.col("_old").isNull() | (F.col("distance") < F.col("_old"))).alias("_changed"))

    return fixpoint(start, relax, max_rounds=max_rounds, tag="distance")


def orient(segments: DataFrame, distances: DataFrame) -> DataFrame:
    """Proximal and distal node of every segment and its parent segment.

    The proximal node is nearer to the root (the start on ties). The parent ends where the segment
    begins; of several the smallest id.
    """
    c = F.col
    a = distances.select("sample_id", c("node_id").alias("start_node"), c("distance").alias("d0"))
    b = distances.select("sample_id", c("node_id").alias("end_node"), c("distance").alias("d1"))
    joined = segments.join(a, ["sample_id", "start_node"], "left").join(b, ["sample_id", "end_node"], "left")
    forward = F.coalesce(c("d0") <= c("d1"), c("d0").isNotNull() | c("d1").isNull())
    turned = joined.select(
        "sample_id", "segment_id", F.when(forward, c("start_node")).otherwise(c("end_node")).alias("proximal_node"), F.when(forward, c("end_node")).otherwise(c("start_node")).alias("distal_node")
    )
    passing = turned.filter("proximal_node <> distal_node")
    above = passing.groupBy("sample_id", c("distal_node").alias("proximal_node")).agg(F.min("segment_id").alias("_parent"))
    return turned.join(above, ["sample_id", "proximal_node"], "left").select(
        "sample_id", "segment_id", "proximal_node", "distal_node", c("_parent").alias("parent_segment_id")
    )


def propagate_fate(segments: DataFrame, cut_ids: DataFrame, pruned_nodes: DataFrame) -> DataFrame:
    """What happens to every segment: the cut ones are pruned, and so is all that hangs together with a pruned node once
    they are gone; the rest is retained. ``is_cut`` tells the cut ones.

    ``pruned_nodes(sample_id, node_id)`` are the pruned ends of the crossed segments, also of cuts that cross several.
    """
    cut = cut_ids.select("sample_id", "segment_id").distinct()
    rest = segments.join(cut, ["sample_id", "segment_id"], "left_anti")
    edges = rest.select("sample_id", F.col("start_node").alias("src"), F.col("end_node").alias("dst"))
    nodes = segments.select("sample_id", F.explode(F.array("start_node", "end_node")).alias("node_id")).distinct()
    labels = components(nodes, edges)
    gone = labels.join(pruned_nodes.select("sample_id", "node_id").distinct(), ["sample_id", "node_id"], "left_semi").select("sample_id", "component_id").distinct().withColumn("_gone", F.lit(True))
    fate = labels.join(gone, ["sample_id", "component_id"], "left").select("sample_id", F.col("node_id").alias("start_node"), F.col("_gone").isNotNull().alias("_g"))
    joined = segments.join(fate, ["sample_id", "start_node"], "left").join(cut.withColumn("_cut", F.lit(True)), ["sample_id", "segment_id"], "left")
    is_cut = F.col("_cut").isNotNull()
    return joined.select("sample_id", "segment_id", F.when(is_cut | F.col("_g"), "pruned").otherwise("retained").alias("fate"), is_cut.cast("int").alias("is_cut"))


def fate_of_cuts(segments: DataFrame, checks: DataFrame) -> DataFrame:
    """``propagate_fate`` from the crossed segments of cuts (sample_id, cut_id, segment_id, exact, pruned_node): segments of exact cuts
    are cut; of a segment that several cuts cross the last cut's pruned end counts."""
    last = checks.groupBy("sample_id", "segment_id").agg(F.max(F.struct("cut_id", "pruned_node")).alias("l"), F.bool_or("exact").alias("_exact"))
    last = written(last.select("sample_id", "segment_id", F.col("l.pruned_node").alias("node_id"), "_exact"), "last")
    return propagate_fate(segments, last.filter("_exact"), last)


def prune_budless(groups: DataFrame, attachments: DataFrame, radius: float = 24.0, max_rounds: int | None = None) -> DataFrame:
    """Whether a group stays: trunks always, others when they or a descendant hold a close bud.

    ``groups(sample_id, group_id, group_type, parent_group_id?)``, ``attachments(sample_id,
    group_id, distance)``.
    """
    keys = ["sample_id", "group_id"]
    own = attachments.filter(F.col("distance") <= radius).select(*keys).distinct().withColumn("_b", F.lit(True))
    start = groups.join(own, keys, "left").select(*keys, "group_type", "parent_group_id", F.col("_b").isNotNull().alias("alive"))

    def up(state: DataFrame) -> DataFrame:
        fed = state.filter("alive AND parent_group_id IS NOT NULL").select("sample_id", F.col("parent_group_id").alias("group_id")).distinct().withColumn("_f", F.lit(True))
        joined = state.join(fed, keys, "left")
        new = F.col("_f").isNotNull() & ~F.col("alive")
        return joined.select(*keys, "group_type", "parent_group_id", (F.col("alive") | F.col("_f").isNotNull()).alias("alive"), new.alias("_changed"))

    done = fixpoint(start, up, max_rounds=max_rounds, tag="budless")
    return done.select(*keys, "group_type", F.col("alive").alias("has_bud"), (F.col("alive") | (F.col("group_type") == "trunk")).alias("keep"))


# --- validity and statistics ------------------------------------------------------------------------


def tree_validity(nodes: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per sample: nodes, edges, components, cycle rank, largest degree, whether it is a tree."""
    d = degrees(nodes, edges)
    per_node = d.join(labels, ["sample_id", "node_id"]).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("nodes"), F.max("degree").alias("max_degree"), F.count_if(F.col("node_id") == F.col("component_id")).alias("components"),
        F.count_if(F.col("degree") == 0).alias("isolated_nodes"), F.count_if(F.col("degree") >= 3).alias("junctions"), F.count_if(F.col("degree") == 1).alias("endpoints"),
    )
    per_edge = edges.groupBy("sample_id").agg(F.count(F.lit(1)).alias("edges"))
    e = F.coalesce("edges", F.lit(0))
    joined = per_node.join(per_edge, "sample_id", "left")
    return joined.select(
        "sample_id", "nodes", e.alias("edges"), "components", (e - F.col("nodes") + F.col("components")).alias("cycle_rank"), "max_degree", "isolated_nodes", "junctions", "endpoints",
        ((F.col("components") == 1) & (e == F.col("nodes") - 1)).alias("is_tree"),
    )


def two_core(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Edges left after edges at nodes of degree one are removed again and again: the cyclic part."""
    current = written(edges.select("sample_id", "src", "dst"), "core")
    for _ in rounds(max_rounds):
        loose = half_edges(current).groupBy("sample_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("d")).filter("d = 1").select("sample_id", "node_id")
        loose = written(loose, "loose")
        if not loose.limit(1).count():
            return current
        for end in ("src", "dst"):
            current = current.join(loose.withColumnRenamed("node_id", end), ["sample_id", end], "left_anti")
        current = written(current.select("sample_id", "src", "dst"), "core")
    raise RuntimeError("two_core: edges still peel after the last round")


def is_dag(edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Whether the directed edges of a sample hold no cycle, by removing nodes nobody points to."""
    samples = edges.select("sample_id").distinct()
    current = written(edges.select("sample_id", "src", "dst").distinct(), "dag")
    for _ in rounds(max_rounds):
        held = current.select("sample_id", F.col("dst").alias("src")).distinct()
        kept = written(current.join(held, ["sample_id", "src"], "left_semi"), "dag")
        before, after = current.count(), kept.count()
        current = kept
        if after == before:
            cyclic = current.select("sample_id").distinct().withColumn("_c", F.lit(True))
            return samples.join(cyclic, "sample_id", "left").select("sample_id", F.col("_c").isNull().alias("is_dag"))
    raise RuntimeError("is_dag: edges still peel after the last round")


def assign_owners(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Owner of every node: the anchor with the fewest hops, the smallest owner on ties.

    ``anchors(sample_id, node_id, owner)``.
    """
    none = F.lit(None).cast(anchors.schema["owner"].dataType)
    rows = nodes.select("sample_id", F.lit(0).alias("kind"), F.col("node_id").alias("src"), F.lit(None).cast("long").alias("dst"), none.alias("owner"))
    rows = rows.unionByName(edges.select("sample_id", F.lit(1).alias("kind"), "src", "dst", none.alias("owner")))
    rows = rows.unionByName(anchors.select("sample_id", F.lit(2).alias("kind"), F.col("node_id").alias("src"), F.lit(None).cast("long").alias("dst"), "owner"))
    rows = written(rows, "owned")
    odd = F.col("src").isNull() | ((F.col("kind") == 1) & F.col("dst").isNull()) | ((F.col("kind") == 2) & F.col("owner").isNull())
    few, many = fit_whole(rows, ["sample_id"], LIMIT, odd)
    types = dict(rows.dtypes)
    schema = f"sample_id {types['sample_id']}, node_id long, owner {types['owner']}, hops long"
    found = in_tasks(few, ["sample_id"], [F.col("kind"), F.col("src")], local_owners, schema)
    if many is None:
        return found
    part = lambda kind: many.filter(F.col("kind") == kind)
    return found.unionByName(_owners_by_rounds(part(0).withColumnRenamed("src", "node_id"), part(1), part(2).withColumnRenamed("src", "node_id"), max_rounds))


def _owners_by_rounds(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, max_rounds: int | None) -> DataFrame:
    """``assign_owners`` of samples of any size: owners spread by a hop a round."""
    hops = written(half_edges(edges.select("sample_id", "src", "dst")), "hops")
    seeds = anchors.groupBy("sample_id", "node_id").agg(F.min("owner").alias("owner")).withColumn("hops", F.lit(0).cast("long"))
    start = nodes.select("sample_id", "node_id").join(seeds, ["sample_id", "node_id"], "left")

    def step(state: DataFrame) -> DataFrame:
        ahead = state.filter("owner IS NOT NULL").select("sample_id", F.col("node_id").alias("src"), "hops", "owner")
        offered = hops.join(ahead, ["sample_id", "src"]).groupBy("sample_id", F.col("dst").alias("node_id")).agg(F.min(F.struct((F.col("hops") + 1).alias("hops"), "owner")).alias("o"))
        joined = state.join(offered, ["sample_id", "node_id"], "left")
        better = F.col("o").isNotNull() & (F.col("owner").isNull() | (F.col("o") < F.struct("hops", "owner")))
        return joined.select("sample_id", "node_id", F.when(better, F.col("o.owner")).otherwise(F.col("owner")).alias("owner"), F.when(better, F.col("o.hops")).otherwise(F.col("hops")).alias("hops"), better.alias("_changed"))

    return fixpoint(start, step, max_rounds=max_rounds, tag="owners")


def contract(segment_groups: DataFrame, segments: DataFrame) -> DataFrame:
    """Group graph: groups that share a segment or meet at a node, as (sample_id, group_a, group_b).

    ``segment_groups(sample_id, segment_id, group_id)``. Groups are first reduced to the distinct
    ones at a node; a segment's groups meet at its end nodes, so one join finds both kinds.
    """
    at = segment_groups.join(incidence(segments), ["sample_id", "segment_id"]).select("sample_id", "node_id", "group_id").distinct()
    other = at.withColumnRenamed("group_id", "group_b")
    return at.withColumnRenamed("group_id", "group_a").join(other, ["sample_id", "node_id"]).filter("group_a < group_b").select("sample_id", "group_a", "group_b").distinct()


def typed_nodes(nodes: DataFrame, edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Type of every node: junction, endpoint or path by degree, trunk where only trunks own it.

    ``owners(sample_id, node_id, group_type)``.
    """
    trunk = owners.groupBy("sample_id", "node_id").agg(F.bool_and(F.col("group_type") == "trunk").alias("_t"))
    d = degrees(nodes, edges).join(trunk, ["sample_id", "node_id"], "left")
    kind = F.when(F.coalesce("_t", F.lit(False)), "trunk").when(F.col("degree") >= 3, "junction").when(F.col("degree") <= 1, "endpoint").otherwise("path")
    return d.select("sample_id", "node_id", "degree", kind.alias("node_type"))


def prepend_anchor(groups: DataFrame, anchors: DataFrame) -> DataFrame:
    """Insert an anchor as point 0 with an edge to the vertex it attaches to.

    ``groups(sample_id, group_id, points, edges)``, ``anchors(sample_id, group_id, x, y, attach_pos)``.
    """
    joined = groups.join(anchors, ["sample_id", "group_id"], "left")
    shifted = F.transform("edges", lambda e: F.transform(e, lambda i: i + 1))
    has = F.col("attach_pos").isNotNull()
    head = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return joined.select(
        "sample_id", "group_id", F.when(has, F.concat(F.array(head), F.col("points"))).otherwise(F.col("points")).alias("points"),
        F.when(has, F.concat(F.array(F.array(F.lit(0), (F.col("attach_pos") + 1).cast("int"))), shifted)).otherwise(F.col("edges")).alias("edges"),
    )


def merge_families(edges: DataFrame) -> DataFrame:
    """Edges of a root family under one id: the part of the group id before ``_root_``."""
    family = F.element_at(F.split("group_id", "_root_"), 1)
    return edges.select("sample_id", family.alias("group_id"), "src", "dst").distinct()


def uncross(edges: DataFrame, members: DataFrame, pairings: DataFrame) -> DataFrame:
    """Replace each junction cluster by one node per paired arms and one for the rest.

    ``members(sample_id, node_id, cluster_id)``, ``pairings(sample_id, cluster_id, arm_node,
    pair_no)`` with arms named by their first node outside the cluster. A new node is known by
    (cluster_id, pair_no), null pair_no for the arms without a pair; an edge to it has the arm as
    src and no dst. Other edges have no cluster_id.
    """
    inside = members.select("sample_id", "node_id", "cluster_id").distinct()
    a = inside.select("sample_id", F.col("node_id").alias("src"), F.col("cluster_id").alias("ca"))
    b = inside.select("sample_id", F.col("node_id").alias("dst"), F.col("cluster_id").alias("cb"))
    marked = edges.select("sample_id", "src", "dst").join(a, ["sample_id", "src"], "left").join(b, ["sample_id", "dst"], "left")
    none = F.lit(None).cast("long")
    untouched = marked.filter("ca IS NULL AND cb IS NULL").select("sample_id", "src", "dst", none.alias("cluster_id"), none.alias("pair_no"))
    crossing = marked.filter("(ca IS NULL) <> (cb IS NULL)").select(
        "sample_id", F.coalesce("ca", "cb").alias("cluster_id"), F.when(F.col("ca").isNull(), F.col("src")).otherwise(F.col("dst")).alias("arm_node")
    ).distinct()
    linked = crossing.join(pairings, ["sample_id", "cluster_id", "arm_node"], "left")
    new = linked.select("sample_id", F.col("arm_node").alias("src"), none.alias("dst"), F.col("cluster_id").cast("long"), F.col("pair_no").cast("long"))
    return untouched.unionByName(new.distinct())


# --- angles at nodes --------------------------------------------------------------------------------

# fixed values: a full turn in nano-radians, rounded to an even number
FULL_TURN = 6283185308
HALF_TURN = FULL_TURN // 2


def node_directions(edges: DataFrame) -> DataFrame:
    """Direction of every edge leaving a node as an integer angle: (sample_id, node_id, t)."""
    h = half_edges(edges.select("sample_id", "src", "dst"))
    dx, dy = node_x(F.col("dst")) - node_x(F.col("src")), node_y(F.col("dst")) - node_y(F.col("src"))
    return h.select("sample_id", F.col("src").alias("node_id"), F.pmod(F.round(F.atan2(dy.cast("double"), dx.cast("double")) * 1e9).cast("long"), F.lit(FULL_TURN)).alias("t"))


def pair_angle_sums(directions: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Count, sum and sum of squares of pairwise angles per node and class, in degrees.

    ``bounds`` are rising limits in degrees; class i holds angles in [bounds[i], bounds[i+1]), the
    last one includes 180. Directions are laid out over two turns; each direction asks for the
    running sums at its own angle plus every bound, so the sums over all later directions inside a
    class are differences of running sums. Nothing is paired, a hub costs as much as many nodes.
    """
    c = F.col
    rad = [int(round(b * FULL_TURN / 360.0)) for b in bounds]
    top = rad[-1] if bounds[-1] < 180.0 else None
    counted = directions.groupBy("sample_id", "node_id", "t").agg(F.count(F.lit(1)).alias("m"))
    data = counted.select("sample_id", "node_id", F.explode(F.array(c("t"), c("t") + FULL_TURN)).alias("at"), F.lit(0).alias("q"), F.lit(None).cast("long").alias("t"), "m", F.lit(-1).alias("bound"))
    asks = [F.struct((c("t") + r).alias("at"), F.lit(-1).alias("q"), F.lit(i).alias("bound")) for i, r in enumerate(rad)]
    if top is None:
        asks[-1] = F.struct((c("t") + HALF_TURN).alias("at"), F.when(c("t") < HALF_TURN, 1).otherwise(-1).alias("q"), F.lit(len(rad) - 1).alias("bound"))
    query = counted.select("sample_id", "node_id", "t", "m", F.explode(F.array(*asks)).alias("a")).select("sample_id", "node_id", "a.at", "a.q", "t", "m", "a.bound")
    merged = data.unionByName(query)
    is_data = c("bound") < 0
    deg = c("at") * (360.0 / FULL_TURN)
    zero = F.lit(0.0)
    run = running_totals(
        merged, ["sample_id", "node_id"], [c("at"), c("q"), c("bound"), c("t")],
        {"_n": F.when(is_data, c("m")).otherwise(0), "_s": F.when(is_data, c("m") * deg).otherwise(zero), "_ss": F.when(is_data, c("m") * deg * deg).otherwise(zero)},
    ).filter("bound >= 0")
    own = c("t") * (360.0 / FULL_TURN)
    sums = run.select("sample_id", "node_id", "bound", (c("m") * c("_n")).alias("n"), (c("m") * (c("_s") - c("_n") * own)).alias("s"), (c("m") * (c("_ss") - 2 * own * c("_s") + c("_n") * own * own)).alias("ss"))
    parts = F.explode(F.array(*[x for i in range(len(rad)) for x in ([F.struct(F.lit(i).alias("cls"), F.lit(-1).alias("sign"), F.lit(i).alias("b"))] if i < len(rad) - 1 else []) + ([F.struct(F.lit(i - 1).alias("cls"), F.lit(1).alias("sign"), F.lit(i).alias("b"))] if i > 0 else [])]))
    spread = sums.withColumn("p", parts).filter("bound = p.b")
    return spread.groupBy("sample_id", "node_id", c("p.cls").alias("angle_class")).agg(
        F.sum(c("n") * c("p.sign")).alias("pairs"), F.sum(c("s") * c("p.sign")).alias("angle_sum"), F.sum(c("ss") * c("p.sign")).alias("angle_sq")
    )


def fit_angle_priors(edges: DataFrame) -> DataFrame:
    """Mean and population deviation (at least one degree) of branching and crossing angles.

    Pairs of edges at a node of 15 up to 120 degrees branch, of 120 and more cross.
    """
    c = F.col
    sums = pair_angle_sums(node_directions(edges), [15.0, 120.0, 180.0])
    total = sums.groupBy("angle_class").agg(F.sum("pairs").alias("pairs"), F.sum("angle_sum").alias("s"), F.sum("angle_sq").alias("ss"))
    mean = c("s") / c("pairs")
    std = F.greatest(F.sqrt(F.greatest(c("ss") / c("pairs") - mean * mean, F.lit(0.0))), F.lit(1.0))
    return total.filter("pairs > 0").select(F.when(c("angle_class") == 0, "branching").otherwise("crossing").alias("kind"), "pairs", mean.alias("mean_deg"), std.alias("std_deg"))


def incident_angles(edges: DataFrame) -> DataFrame:
    """Smallest and largest angle between two edges of a node, from the sorted directions.

    The smallest lies between neighbours, the largest next to the opposite of a direction; both
    are running maxima over the directions of a node laid out over two turns.
    """
    return angle_range(node_directions(edges))


def angle_range(directions: DataFrame) -> DataFrame:
    """``incident_angles`` of given directions (sample_id, node_id, t)."""
    c = F.col
    d = directions.groupBy("sample_id", "node_id", "t").agg(F.count(F.lit(1)).alias("m"))
    data = d.select("sample_id", "node_id", F.explode(F.array(c("t"), c("t") + FULL_TURN)).alias("at"), F.lit(0).alias("q"), F.lit(None).cast("long").alias("t"), "m")
    far = d.select("sample_id", "node_id", (c("t") + HALF_TURN).alias("at"), F.lit(2).alias("q"), "t", "m")
    near = d.select("sample_id", "node_id", (c("t") + FULL_TURN).alias("at"), F.lit(-1).alias("q"), "t", "m")
    merged = data.unionByName(far).unionByName(near)
    run = running_totals(merged, ["sample_id", "node_id"], [c("at"), c("q"), c("t")], {"_last": F.when(c("t").isNull(), c("at"))}, running="max").filter("t IS NOT NULL AND _last IS NOT NULL")
    turn = 360.0 / FULL_TURN
    gap = F.when(c("q") == -1, c("at") - c("_last"))
    wide = F.when((c("q") == 2) & (c("_last") > c("t")), c("_last") - c("t"))
    folded = F.least(gap, F.lit(FULL_TURN) - gap)
    lone = F.max("m") > 1
    return run.groupBy("sample_id", "node_id").agg(
        F.when(lone, 0.0).otherwise(F.min(folded) * turn).alias("min_angle"), F.max(F.greatest(wide, folded)).alias("_w"),
        F.sum(F.when(c("q") == -1, c("m"))).alias("_edges"),
    ).filter("_edges > 1").drop("_edges").withColumn("max_angle", F.coalesce(c("_w"), F.lit(0)) * turn).drop("_w")
