"""Rooted trees of very many groups: spanning forests, orientation, and aggregates along root paths.

A group is a sample and a group id; its nodes are pixel keys, its edges ``(sample_id, group_id, src, dst)`` with
``src < dst``. Whatever the shape of a tree (a path of any length, a star, both), every step takes a number of
rounds that grows with the logarithm of its size: forests grow by joining trees, a tree is oriented along its Euler
tour, and what adds up along root paths is found by pointer doubling. Rows that have reached their root leave the rounds.
Groups that fit a task (``slices.LIMIT``) are solved there, all that a task holds together, without rounds between tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.functions.geometry import norm
from stemweave.operators import graph
from stemweave.plans.durable import written
from stemweave.plans.grid import as_edges, nearest
from stemweave.plans.skew import running_totals
from stemweave.plans.slices import LIMIT, fit_whole, in_tasks, local_blocks, local_forest, local_paths, local_search

G = ["sample_id", "group_id"]
c = F.col


def edge_length(src: Column, dst: Column) -> Column:
    return norm((graph.node_x(src) - graph.node_x(dst)).cast("double"), (graph.node_y(src) - graph.node_y(dst)).cast("double"))


def group_nodes(edges: DataFrame, keys: Sequence[str] = G) -> DataFrame:
    return edges.select(*keys, F.explode(F.array("src", "dst")).alias("node_id")).distinct()


def _odd(*ends: str) -> Column:
    """Edges that a task is not given: without one of their ends, or not from the smaller to the larger node."""
    a, b = (c(e) for e in ends)
    return a.isNull() | b.isNull() | (a >= b)


def _types(df: DataFrame, keys: Sequence[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def most(a, b):
    """The larger one, of columns or of arrays."""
    return F.greatest(a, b) if isinstance(a, Column) else np.maximum(a, b)


def least(a, b):
    return F.least(a, b) if isinstance(a, Column) else np.minimum(a, b)


def _searched(edges: DataFrame, roots: DataFrame, keys: list[str]) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """(keys, node_id, depth, parent) of the groups that fit a task, and edges and roots of the others, if there are any."""
    rows = edges.select(*keys, F.lit(0).alias("kind"), "src", "dst").unionByName(roots.select(*keys, F.lit(1).alias("kind"), c("node_id").alias("src"), c("node_id").alias("dst")))
    rows = written(rows, "searched")
    few, many = fit_whole(rows, keys, LIMIT, c("src").isNull() | ((c("kind") == 0) & _odd("src", "dst")))
    found = in_tasks(few, keys, [c("kind"), c("src")], local_search(keys), f"{_types(rows, keys)}, node_id long, depth long, parent long")
    if many is None:
        return found, None
    return found, (many.filter("kind = 0").select(*keys, "src", "dst"), many.filter("kind = 1").select(*keys, c("src").alias("node_id")))


def spanning_forest(edges: DataFrame, keys: Sequence[str] = G) -> DataFrame:
    """The edges of the minimum spanning forest of every group, by (length, src, dst).

    Components with one edge fewer than nodes are trees as they are. In the others every tree takes its shortest edge to
    another one; trees joined by these edges become one, so their number halves at least in a round.
    """
    keys = list(keys)
    named = written(edges.select(*keys, "src", "dst").withColumn("w", edge_length(c("src"), c("dst"))), "weighted")
    few, many = fit_whole(named, keys, LIMIT, _odd("src", "dst"))
    found = in_tasks(few, keys, [c("w"), c("src"), c("dst")], local_forest(keys), f"{_types(named, keys)}, src long, dst long")
    return found if many is None else found.unionByName(_forest_by_rounds(many.distinct(), keys))


def _forest_by_rounds(named: DataFrame, keys: list[str]) -> DataFrame:
    """``spanning_forest`` of groups of any size."""
    named = written(named, "weighted")
    nodes = group_nodes(named, keys)
    labels = written(graph.components(nodes, named, keys), "labels")
    place = lambda end, name: labels.select(*keys, c("node_id").alias(end), c("component_id").alias(name))
    sizes = labels.groupBy(*keys, "component_id").agg(F.count(F.lit(1)).alias("_nodes"))
    owned = named.join(place("src", "component_id"), [*keys, "src"])
    cyclic = owned.groupBy(*keys, "component_id").agg(F.count(F.lit(1)).alias("_edges")).join(sizes, [*keys, "component_id"]).filter("_edges >= _nodes").select(*keys, "component_id")
    marked = written(owned.join(cyclic.withColumn("_c", F.lit(True)), [*keys, "component_id"], "left"), "marked")
    forest = marked.filter("_c IS NULL").select(*keys, "src", "dst")
    open_ = marked.filter("_c").select(*keys, "src", "dst", "w")
    chosen: DataFrame | None = None
    while not (open_ := written(open_, "open")).isEmpty():
        own = group_nodes(open_, keys) if chosen is None else group_nodes(open_.select(*keys, "src", "dst").unionByName(chosen), keys)
        if chosen is None:
            trees = own.withColumn("component_id", c("node_id"))
        else:
            trees = written(graph.components(own, chosen, keys), "trees")
        at = lambda end, name, t=trees: t.select(*keys, c("node_id").alias(end), c("component_id").alias(name))
        across = written(open_.join(at("src", "a"), [*keys, "src"]).join(at("dst", "b"), [*keys, "dst"]).filter("a <> b"), "across")
        asked = across.select(*keys, "src", "dst", "w", F.explode(F.array("a", "b")).alias("tree"))
        best = asked.groupBy(*keys, "tree").agg(F.min(F.struct("w", "src", "dst")).alias("e")).select(*keys, "e.src", "e.dst").distinct()
        chosen = written(best if chosen is None else chosen.unionByName(best).distinct(), "chosen")
        open_ = across.select(*keys, "src", "dst", "w").join(chosen, [*keys, "src", "dst"], "left_anti")
    return forest if chosen is None else forest.unionByName(chosen)


def oriented(forest: DataFrame, roots: DataFrame, keys: Sequence[str] = G) -> DataFrame:
    """(keys, node_id, parent) of every node of the trees that hold a root; the parent of a root is null."""
    found, many = _searched(forest, roots, list(keys))
    found = written(found.select(*keys, "node_id", "parent"), "parents")
    return found if many is None else found.unionByName(toured(*many, keys).select(*keys, "node_id", "parent"))


def toured(forest: DataFrame, roots: DataFrame, keys: Sequence[str] = G) -> DataFrame:
    """(keys, node_id, parent, enter, leave): when a walk around the tree comes to a node first and leaves it last. All
    below a node, and nothing else, is entered between the two.

    ``forest`` must not hold cycles, ``roots(keys, node_id)`` one node a tree. Every half-edge u -> v is followed by
    the one that leaves v behind the half-edge back to u, in order of neighbours; from a root this walks around the whole
    tree. Doubling the steps gives every half-edge its distance to the end of the walk, and of the two half-edges
    of an edge the one that is walked first leads away from the root.
    """
    keys = list(keys)
    both = written(graph.half_edges(forest.select(*keys, "src", "dst")), "half")
    ranked = written(running_totals(both, [*keys, "src"], [c("dst")], {"turn": F.lit(1).cast("long")}, whole={"turns": "turn"}), "turns")
    follows = ranked.select(*keys, c("src").alias("mid"), c("dst").alias("back"), F.when(c("turn") == c("turns"), 1).otherwise(c("turn") + 1).alias("next_turn"))
    leaves = ranked.select(*keys, c("src").alias("mid"), c("dst").alias("to"), c("turn").alias("next_turn"))
    after = follows.join(leaves, [*keys, "mid", "next_turn"]).select(*keys, c("back").alias("src"), c("mid").alias("dst"), "to", "next_turn")
    # the walk of a root ends where it would take the root's first half-edge again
    ends = roots.select(*keys, c("node_id").alias("dst")).distinct().withColumn("_root", F.lit(True))
    state = after.join(ends, [*keys, "dst"], "left").select(
        *keys, "src", "dst", F.when(~(c("_root").isNotNull() & (c("next_turn") == 1)), c("dst")).alias("n_src"),
        F.when(~(c("_root").isNotNull() & (c("next_turn") == 1)), c("to")).alias("n_dst"), F.lit(1).cast("long").alias("left"),
    )
    state = written(state, "tour")
    done: list[DataFrame] = []
    while True:
        settled = state.filter("n_src IS NULL")
        moving = state.filter("n_src IS NOT NULL")
        if moving.isEmpty():
            break
        ahead = state.select(*keys, c("src").alias("n_src"), c("dst").alias("n_dst"), c("n_src").alias("f_src"), c("n_dst").alias("f_dst"), c("left").alias("more"))
        moved = moving.join(ahead, [*keys, "n_src", "n_dst"]).select(*keys, "src", "dst", c("f_src").alias("n_src"), c("f_dst").alias("n_dst"), (c("left") + c("more")).alias("left"))
        # a walk without a root never ends: what has gone farther than there are half-edges is let go
        new = written(moved.unionByName(settled), "tour")
        if new.filter("n_src IS NULL").count() == settled.count():
            state = settled
            break
        state = new
    walked = state.filter("n_src IS NULL").select(*keys, "src", "dst", "left")
    back = walked.select(*keys, c("src").alias("dst"), c("dst").alias("src"), c("left").alias("_back"))
    # counted from the end of the walk, so the sign turns the order round
    down = walked.join(back, [*keys, "src", "dst"]).filter("left > _back").select(*keys, c("dst").alias("node_id"), c("src").alias("parent"), (-c("left")).alias("enter"), (-c("_back")).alias("leave"))
    forever = F.lit((1 << 63) - 1)
    tops = roots.select(*keys, "node_id").distinct().select(*keys, "node_id", F.lit(None).cast("long").alias("parent"), (-forever).alias("enter"), forever.alias("leave"))
    return written(down.unionByName(tops), "parents")


def along_root_paths(
    parents: DataFrame, start: Mapping[str, Column], merge: Callable[[Callable[[str], Column], Callable[[str], Column]], Mapping[str, Column]], keys: Sequence[str] = G,
    arrays: bool = False,
) -> DataFrame:
    """Aggregates over the path from the root to every node, both included.

    ``parents(keys, node_id, parent, ...)`` is a table of trees, ``start`` the values of a single node, and ``merge`` gives
    the values of a path from those of its upper and its lower part (functions from a name to its column), which has to
    be associative. A row knows the part from below ``up`` to its node; a round puts the part that ends at ``up``
    before it, so parts double. Rows whose part begins at the root are done and only looked up. Where ``merge`` takes ``arrays`` as
    well as columns, groups that fit a task double there.
    """
    keys = list(keys)
    names = list(start)
    state = written(parents.select(*keys, "node_id", c("parent").alias("up"), *[start[n].alias(n) for n in names]), "paths")
    if arrays:
        few, many = fit_whole(state, keys, LIMIT, reduce(Column.__or__, [c(n).isNull() for n in ["node_id", *names]]))
        found = in_tasks(few, keys, [c("node_id")], local_paths(keys, names, merge), _types(state, [*keys, "node_id", *names]))
        return found if many is None else found.unionByName(_paths_by_rounds(many, merge, names, keys))
    return _paths_by_rounds(state, merge, names, keys)


def _paths_by_rounds(state: DataFrame, merge: Callable, names: list[str], keys: list[str]) -> DataFrame:
    """``along_root_paths`` of groups of any size."""
    while True:
        moving = state.filter("up IS NOT NULL")
        if moving.isEmpty():
            return state.select(*keys, "node_id", *names)
        above = state.select(*keys, c("node_id").alias("up"), c("up").alias("_up"), *[c(n).alias(f"_u_{n}") for n in names])
        joined = moving.join(above, [*keys, "up"])
        values = merge(lambda n: c(f"_u_{n}"), lambda n: c(n))
        longer = joined.select(*keys, "node_id", c("_up").alias("up"), *[values[n].alias(n) for n in names])
        state = written(longer.unionByName(state.filter("up IS NULL")), "paths")


def tree_degrees(forest: DataFrame, keys: Sequence[str] = G) -> DataFrame:
    return graph.half_edges(forest.select(*keys, "src", "dst")).groupBy(*keys, c("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))


def _roots_by(candidates: DataFrame, labels: DataFrame, order: Sequence[str], keys: Sequence[str] = G) -> DataFrame:
    """Per component the node that comes first by ``order``, then by its id."""
    place = F.struct(*[c(o) for o in order], c("node_id"))
    joined = candidates.join(labels, [*keys, "node_id"])
    return joined.groupBy(*keys, "component_id").agg(F.min(place).alias("p")).select(*keys, c("p.node_id").alias("node_id"))


def first_positions(groups: DataFrame) -> DataFrame:
    """(sample_id, group_id, node_id, pos): where a vertex first stands among the points of its group."""
    points = groups.select("sample_id", "group_id", F.posexplode("points").alias("pos", "p"))
    return points.select("sample_id", "group_id", "pos", graph.node_key(c("p.x"), c("p.y")).alias("node_id")).groupBy(*G, "node_id").agg(F.min("pos").alias("pos"))


def hierarchy_levels(groups: DataFrame, spacing: float = 3.0, most: int = 3) -> DataFrame:
    """Points along the edges of every group's spanning trees with their level: (sample_id, group_id, node_id, i, x, y, level).

    A component's root is its first point. The level of an edge is the number of forks (tree degree of three or more)
    above its lower end ``node_id``, at most ``most``. An edge has points at most ``spacing`` apart, ends included.
    """
    edges = written(graph.group_edges(groups), "edges")
    forest = written(spanning_forest(edges), "forest")
    labels = graph.components(group_nodes(edges), edges, G)
    parents = oriented(forest, _roots_by(first_positions(groups), labels, ["pos"]))
    forks = parents.join(tree_degrees(forest), [*G, "node_id"], "left").withColumn("fork", (F.coalesce("degree", F.lit(0)) >= 3).cast("long"))
    counted = along_root_paths(forks, {"forks": c("fork"), "own": c("fork")}, lambda up, low: {"forks": up("forks") + low("forks"), "own": low("own")}, arrays=True)
    lower = parents.filter("parent IS NOT NULL").join(counted, [*G, "node_id"])
    n = F.greatest(F.ceil(edge_length(c("parent"), c("node_id")) / spacing), F.lit(1)).cast("long")
    xy = lambda f: (f(c("parent")).cast("double"), f(c("node_id")).cast("double"))
    (x0, x1), (y0, y1) = xy(graph.node_x), xy(graph.node_y)
    return lower.withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), c("n")))).select(
        *G, "node_id", "i", (x0 + (x1 - x0) * c("i") / c("n")).alias("x"), (y0 + (y1 - y0) * c("i") / c("n")).alias("y"),
        F.least(c("forks") - c("own"), F.lit(most)).alias("level"),
    )


def trunk_distances(nodes: DataFrame, trunk: DataFrame, radius: float = 8.0) -> DataFrame:
    """(sample_id, node_id, trunk_px): distance of every node to the nearest trunk vertex of its sample, null without a trunk."""
    spot = nodes.select("sample_id", "node_id").distinct().select("sample_id", "node_id", graph.node_x(c("node_id")).cast("double").alias("px"), graph.node_y(c("node_id")).cast("double").alias("py"))
    target = trunk.select("sample_id", c("node_id").alias("trunk_node")).distinct().select("sample_id", "trunk_node", graph.node_x(c("trunk_node")).alias("x"), graph.node_y(c("trunk_node")).alias("y"))
    hits = nearest(spot, as_edges(target), ["sample_id"], radius, ["trunk_node"])
    return spot.join(hits.select("sample_id", "px", "py", c("distance").alias("trunk_px")), ["sample_id", "px", "py"], "left").select("sample_id", "node_id", "trunk_px")


def group_diagnostics(groups: DataFrame) -> DataFrame:
    """Per group without the trunks: deepest number of forks on a root path, largest angle between two children of a
    fork in degrees, and the largest way back toward the trunk along a root path in pixels.

    A component's root is its node nearest to the trunk, its tree the minimum spanning tree; a group has the extremes
    of its components. A group without edges has zeros.
    """
    branches = groups.filter("group_type <> 'trunk'")
    trunk = graph.group_vertices(groups.filter("group_type = 'trunk'"))
    edges = written(graph.group_edges(branches), "edges")
    nodes = written(group_nodes(edges), "nodes")
    far = written(trunk_distances(nodes, trunk).withColumn("trunk_px", F.coalesce("trunk_px", F.lit(0.0))), "far")
    forest = written(spanning_forest(edges), "forest")
    placed = nodes.join(far, ["sample_id", "node_id"])
    parents = oriented(forest, _roots_by(placed, graph.components(nodes, edges, G), ["trunk_px"]))
    degree = tree_degrees(forest)
    full = written(parents.join(degree, [*G, "node_id"], "left").join(far, ["sample_id", "node_id"]), "full")
    fork = (c("degree") >= 3).cast("long")
    walked = along_root_paths(
        full, {"forks": fork, "high": c("trunk_px"), "low": c("trunk_px"), "fall": F.lit(0.0)},
        lambda up, low: {"forks": up("forks") + low("forks"), "high": most(up("high"), low("high")), "low": least(up("low"), low("low")),
                         "fall": most(most(up("fall"), low("fall")), up("high") - low("low"))},
        arrays=True,
    )
    deep = walked.groupBy(*G).agg(F.max("forks").alias("fork_depth"), F.max("fall").alias("max_return_to_trunk_px"))
    # directions of the children of forks; one text names the group, as the angles are found per sample
    child = full.select(*G, "node_id", "parent").filter("parent IS NOT NULL").join(degree.filter("degree >= 3").select(*G, c("node_id").alias("parent")), [*G, "parent"])
    key = F.to_json(F.struct("sample_id", "group_id"))
    dx, dy = graph.node_x(c("node_id")) - graph.node_x(c("parent")), graph.node_y(c("node_id")) - graph.node_y(c("parent"))
    turn = F.pmod(F.round(F.atan2(dy.cast("double"), dx.cast("double")) * 1e9).cast("long"), F.lit(graph.FULL_TURN))
    widest = graph.angle_range(child.select(key.alias("sample_id"), c("parent").alias("node_id"), turn.alias("t"))).groupBy(c("sample_id").alias("_key")).agg(F.max("max_angle").alias("max_child_angle_deg"))
    every = branches.select(*G).distinct().withColumn("_key", key)
    joined = every.join(deep, G, "left").join(widest, "_key", "left")
    zero = F.lit(0.0)
    return joined.select(*G, F.coalesce("fork_depth", F.lit(0)).cast("long").alias("fork_depth"), F.coalesce("max_child_angle_deg", zero).alias("max_child_angle_deg"),
                         F.coalesce("max_return_to_trunk_px", zero).alias("max_return_to_trunk_px"))


def over_subtrees(parents: DataFrame, start: Mapping[str, Column], gather: Mapping[str, Callable[[str], Column]], keys: Sequence[str] = G) -> DataFrame:
    """Aggregates over every node and all that hangs below it.

    ``gather`` has an aggregate function per name (``F.sum``, ``F.max``, ...). After k rounds a node has gathered
    what is less than 2^k steps below it and knows its ancestor 2^k steps up, to which it hands that on.
    """
    keys = list(keys)
    names = list(start)
    state = written(parents.select(*keys, "node_id", c("parent").alias("up"), *[start[n].alias(n) for n in names]), "subtrees")
    while not state.filter("up IS NOT NULL").isEmpty():
        handed = state.filter("up IS NOT NULL").select(*keys, c("up").alias("node_id"), *names)
        summed = state.select(*keys, "node_id", *names).unionByName(handed).groupBy(*keys, "node_id").agg(*[gather[n](n).alias(n) for n in names])
        above = state.select(*keys, c("node_id").alias("up"), c("up").alias("_up"))
        ups = state.select(*keys, "node_id", "up").join(above, [*keys, "up"], "left").select(*keys, "node_id", c("_up").alias("up"))
        state = written(summed.join(ups, [*keys, "node_id"]), "subtrees")
    return state.select(*keys, "node_id", *names)


def breadth_first(edges: DataFrame, roots: DataFrame, keys: Sequence[str] = G) -> DataFrame:
    """(keys, node_id, depth, parent): hops from the root (``roots(keys, node_id)``, one a group) and the neighbour that is
    one hop nearer, the smallest of several; nodes that a root does not reach are left out.

    Chains of nodes of degree two are traced first and count as one step of their length, so the rounds are as many as
    there are forks on a path; inside a chain the depth follows from both ends.
    """
    keys = list(keys)
    found, many = _searched(edges, roots, keys)
    return found if many is None else found.unionByName(_breadth_by_rounds(*many, keys))


def _breadth_by_rounds(edges: DataFrame, roots: DataFrame, keys: list[str]) -> DataFrame:
    """``breadth_first`` of groups of any size."""
    edges = edges.distinct()
    key = F.to_json(F.struct(*keys))
    labels = graph.components(group_nodes(edges, keys), edges, keys)
    held = labels.join(roots, [*keys, "node_id"], "left_semi").select(*keys, "component_id").distinct()
    own = labels.join(held, [*keys, "component_id"], "left_semi").select(*keys, c("node_id").alias("src"))
    near = written(edges.join(own, [*keys, "src"], "left_semi").select(key.alias("sample_id"), "src", "dst"), "reached")
    tops = written(roots.select(key.alias("sample_id"), "node_id").distinct(), "tops")
    names = edges.select(*keys).distinct().withColumn("sample_id_", key)
    traced = written(graph.trace_segments(group_nodes(near, ["sample_id"]), near, tops), "traced")
    chain = ["sample_id", "start_node", "first_node"]
    whole = written(traced.groupBy(*chain, "end_node").agg(F.count(F.lit(1)).alias("n")), "chains")
    known = written(graph.root_distance(whole.select("sample_id", c("start_node").alias("src"), c("end_node").alias("dst"), c("n").cast("double").alias("n")), tops, "n"), "known")
    at = lambda end, name: known.select("sample_id", c("node_id").alias(end), c("distance").alias(name))
    ends = whole.join(at("start_node", "_d0"), ["sample_id", "start_node"]).join(at("end_node", "_d1"), ["sample_id", "end_node"])
    inner = traced.select(*chain, "pos", c("dst").alias("node_id")).join(ends, chain).filter("pos < n - 1")
    depth = inner.select("sample_id", "node_id", F.least(c("_d0") + c("pos") + 1, c("_d1") + c("n") - c("pos") - 1).alias("depth"))
    depths = written(depth.unionByName(known.select("sample_id", "node_id", c("distance").alias("depth"))).unionByName(tops.withColumn("depth", F.lit(0.0))).distinct(), "depths")
    hops = graph.half_edges(near).join(depths.select("sample_id", c("node_id").alias("src"), c("depth").alias("_u")), ["sample_id", "src"])
    hops = hops.join(depths.select("sample_id", c("node_id").alias("dst"), c("depth").alias("_v")), ["sample_id", "dst"]).filter("_u = _v - 1")
    parents = hops.groupBy("sample_id", c("dst").alias("node_id")).agg(F.min("src").alias("parent"))
    found = depths.join(parents, ["sample_id", "node_id"], "left").withColumnRenamed("sample_id", "sample_id_")
    return found.join(names.unionByName(roots.select(*keys).distinct().withColumn("sample_id_", key)).distinct(), "sample_id_").select(*keys, "node_id", c("depth").cast("long").alias("depth"), "parent")


def anchors(groups: DataFrame) -> DataFrame:
    """(sample_id, group_id, node_id): the lowest point of a trunk, and of a branch the point nearest to the trunk (its lowest
    where the sample has no trunk); the first of the group's points on ties."""
    places = written(first_positions(groups).join(groups.select(*G, "group_type").distinct(), G), "places")
    trunk = places.filter("group_type = 'trunk'").select("sample_id", "node_id")
    far = trunk_distances(places.filter("group_type <> 'trunk'"), trunk)
    ranked = places.join(far, ["sample_id", "node_id"], "left")
    order = F.when((c("group_type") == "trunk") | c("trunk_px").isNull(), -graph.node_y(c("node_id")).cast("double")).otherwise(c("trunk_px"))
    return ranked.groupBy(*G).agg(F.min(F.struct(order.alias("by"), "pos", "node_id")).alias("p")).select(*G, c("p.node_id").alias("node_id"))


def directed_topology(groups: DataFrame) -> DataFrame:
    """Every node of every group with its depth below the group's anchor and the node that it is reached from (both null
    where the anchor does not reach): the rows with a parent are the directed edges."""
    found = breadth_first(written(graph.group_edges(groups), "edges"), written(anchors(groups), "anchors"))
    nodes = graph.group_vertices(groups).join(groups.select(*G, "group_type").distinct(), G)
    return nodes.join(found, [*G, "node_id"], "left").select(
        *G, "group_type", "node_id", graph.node_x(c("node_id")).alias("x"), graph.node_y(c("node_id")).alias("y"), "depth", "parent", (F.coalesce(c("depth") == 0, F.lit(False))).alias("is_anchor")
    )


def topology_counts(topology: DataFrame) -> DataFrame:
    """Per sample: nodes and directed edges over all groups, and whether the edges hold no cycle."""
    topology = written(topology, "topology")
    counts = topology.groupBy("sample_id").agg(F.count(F.lit(1)).alias("num_nodes"), F.count("parent").alias("num_edges"))
    above = topology.select(*G, c("node_id").alias("parent"), c("depth").alias("_above"))
    # an edge that always goes one step down cannot be part of a cycle
    steps = topology.filter("parent IS NOT NULL").join(above, [*G, "parent"], "left")
    falls = steps.groupBy("sample_id").agg(F.bool_and(F.coalesce(c("depth") == c("_above") + 1, F.lit(False))).alias("_falls"))
    return counts.join(falls, "sample_id", "left").select("sample_id", "num_nodes", "num_edges", F.coalesce("_falls", F.lit(True)).alias("is_dag"))


def blocks(edges: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """(keys, src, dst, block, size): the biconnected block of every edge; a bridge is a block of one edge.

    Of the spanning trees every node gathers the first and last time at which an edge outside the trees leads out of what hangs
    below it. Two tree edges are in one block where such an edge joins their unrelated ends, or where one hangs below the other and
    something below leads past it; the other edges belong to the block of their lower end. A block is named by its
    smallest lower end.
    """
    keys = list(keys)
    edges = written(edges.select(*keys, "src", "dst"), "edges")
    few, many = fit_whole(edges, keys, LIMIT, _odd("src", "dst"))
    found = in_tasks(few, keys, [c("src"), c("dst")], local_blocks(keys), f"{_types(edges, keys)}, src long, dst long, block long, size long")
    return found if many is None else found.unionByName(_blocks_by_rounds(many.distinct(), keys))


def _blocks_by_rounds(edges: DataFrame, keys: list[str]) -> DataFrame:
    """``blocks`` of groups of any size."""
    edges = written(edges, "edges")
    forest = written(_forest_by_rounds(edges.withColumn("w", edge_length(c("src"), c("dst"))), keys), "forest")
    labels = graph.components(group_nodes(edges, keys), edges, keys)
    tree = toured(forest, labels.filter("node_id = component_id").select(*keys, "node_id"), keys)
    when = tree.select(*keys, "node_id", "enter", "leave")
    at = lambda end, *names: when.select(*keys, c("node_id").alias(end), c("enter").alias(names[0]), c("leave").alias(names[1]))
    rest = written(edges.join(forest, [*keys, "src", "dst"], "left_anti").join(at("src", "e0", "l0"), [*keys, "src"]).join(at("dst", "e1", "l1"), [*keys, "dst"]), "rest")
    seen = rest.select(*keys, c("src").alias("node_id"), c("e1").alias("e")).unionByName(rest.select(*keys, c("dst").alias("node_id"), c("e0").alias("e")))
    reach = tree.join(seen.groupBy(*keys, "node_id").agg(F.min("e").alias("_low"), F.max("e").alias("_high")), [*keys, "node_id"], "left")
    below = over_subtrees(reach, {"low": F.least(c("enter"), c("_low")), "high": F.greatest(c("enter"), c("_high"))}, {"low": F.min, "high": F.max}, keys)
    # a tree edge is known by its lower end
    related = ((c("e0") < c("e1")) & (c("e1") < c("l0"))) | ((c("e1") < c("e0")) & (c("e0") < c("l1")))
    across = rest.filter(~related).select(*keys, "src", "dst")
    upper = tree.filter("parent IS NOT NULL").select(*keys, c("node_id").alias("parent"), c("enter").alias("_from"), c("leave").alias("_to"))
    past = tree.filter("parent IS NOT NULL").join(below, [*keys, "node_id"]).join(upper, [*keys, "parent"]).filter((c("low") < c("_from")) | (c("high") >= c("_to")))
    links = across.unionByName(past.select(*keys, c("parent").alias("src"), c("node_id").alias("dst")))
    links = links.select(*keys, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    lower = tree.filter("parent IS NOT NULL").select(*keys, "node_id", "parent")
    named = written(graph.components(lower.select(*keys, "node_id"), links, keys).withColumnRenamed("component_id", "block"), "named")
    of_tree = lower.join(named, [*keys, "node_id"]).select(*keys, F.least("node_id", "parent").alias("src"), F.greatest("node_id", "parent").alias("dst"), "block")
    deeper = rest.select(*keys, "src", "dst", F.when(c("e0") > c("e1"), c("src")).otherwise(c("dst")).alias("node_id")).join(named, [*keys, "node_id"])
    every = written(of_tree.unionByName(deeper.select(*keys, "src", "dst", "block")), "blocks")
    return every.join(every.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("size")), [*keys, "block"]).select(*keys, "src", "dst", "block", "size")


def trunk_cycles(edges: DataFrame, trunk_px: DataFrame, clusters: DataFrame, near: float = 12.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cyclic blocks with two or more nodes within ``near`` of the trunk.

    ``trunk_px(sample_id, node_id, trunk_px)``, ``clusters(sample_id, cluster_id, node_id)`` of junctions. Gives the edges of these
    blocks as ``trunk`` (both ends near) or ``branch``; the pairs of a block and a cluster that share two nodes or more; and per sample
    of the edges the number of blocks, of those with a cluster, and of those without.
    """
    cyclic = written(blocks(edges).filter("size > 1"), "cyclic")
    close = trunk_px.filter(c("trunk_px") <= near).select("sample_id", "node_id").distinct()
    members = written(cyclic.select("sample_id", "block", F.explode(F.array("src", "dst")).alias("node_id")).distinct(), "members")
    chosen = members.join(close, ["sample_id", "node_id"], "left_semi").groupBy("sample_id", "block").agg(F.count(F.lit(1)).alias("near_nodes")).filter("near_nodes >= 2")
    chosen = written(chosen, "chosen")
    side = lambda end: close.select("sample_id", c("node_id").alias(end), F.lit(True).alias(f"_{end}"))
    marked = cyclic.join(chosen, ["sample_id", "block"]).join(side("src"), ["sample_id", "src"], "left").join(side("dst"), ["sample_id", "dst"], "left")
    kinds = marked.select("sample_id", "block", "src", "dst", F.when(c("_src") & c("_dst"), "trunk").otherwise("branch").alias("kind"))
    shared = members.join(chosen, ["sample_id", "block"], "left_semi").join(clusters.distinct(), ["sample_id", "node_id"]).groupBy("sample_id", "block", "cluster_id").agg(F.count(F.lit(1)).alias("shared_nodes"))
    mapped = written(shared.filter("shared_nodes >= 2"), "mapped")
    explained = chosen.join(mapped.select("sample_id", "block").distinct().withColumn("_e", F.lit(1)), ["sample_id", "block"], "left")
    counts = explained.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.count("_e").alias("e"))
    zero = F.lit(0)
    stats = edges.select("sample_id").distinct().join(counts, "sample_id", "left").select(
        "sample_id", F.coalesce("n", zero).alias("trunk_cycles_total"), F.coalesce("e", zero).alias("trunk_cycles_junction_related"), F.coalesce(c("n") - c("e"), zero).alias("trunk_cycles_unexplained"))
    return kinds, mapped, stats
