"""Rooted trees against plain searches, on random graphs, a long path and a star."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stemweave.operators import graph, rooted

KEY = lambda x, y: (x + (1 << 20)) * (1 << 22) + y + (1 << 20)
XY = lambda n: np.array([(n >> 22) - (1 << 20), (n & ((1 << 22) - 1)) - (1 << 20)], dtype=float)
GROUP = "sample_id long, group_id string, group_type string, points array<struct<x:double,y:double>>, edges array<array<int>>"


def random_groups(seed, n=14, forks=True):
    rnd = random.Random(seed)
    rows = [(1, "t", "trunk", [(0.0, float(y)) for y in range(0, 40, 4)], [[i, i + 1] for i in range(9)])]
    for g in range(n):
        points = [(float(rnd.randrange(1, 12)), float(rnd.randrange(40))) for _ in range(rnd.randrange(2, 16))]
        size = len(points)
        edges = [[rnd.randrange(i), i] for i in range(1, size)] if forks else [[i, i + 1] for i in range(size - 1)]
        edges += [[rnd.randrange(size), rnd.randrange(size)] for _ in range(rnd.randrange(4))]
        rows.append((1 + g % 2, f"g{g}", "branch", points, edges))
    return rows


def local(row):
    """Nodes with their first place, and undirected edges, of a group."""
    nodes = [KEY(int(x), int(y)) for x, y in row[3]]
    first = {}
    for i, n in enumerate(nodes):
        first.setdefault(n, i)
    return first, {(min(nodes[a], nodes[b]), max(nodes[a], nodes[b])) for a, b in row[4] if nodes[a] != nodes[b]}


def shortest_forest(edges):
    label, kept = {}, []
    find = lambda x: x if label.setdefault(x, x) == x else find(label[x])
    for a, b in sorted(edges, key=lambda e: (np.hypot(*(XY(e[0]) - XY(e[1]))), *e)):
        if find(a) != find(b):
            label[find(a)] = find(b)
            kept.append((a, b))
    return kept


def near_of(edges):
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def search(near, root):
    """Depth of every node that is reached, and its smallest neighbour one hop nearer."""
    depth, front = {root: 0}, [root]
    while front:
        nxt = sorted({m for n in front for m in near[n]} - depth.keys())
        depth |= {m: depth[front[0]] + 1 for m in nxt}
        front = nxt
    return {n: (d, min((m for m in near[n] if depth.get(m, d) == d - 1), default=None)) for n, d in depth.items()}


def test_spanning_forest(spark):
    rows = random_groups(1)
    got = defaultdict(set)
    for r in rooted.spanning_forest(graph.group_edges(spark.createDataFrame(rows, GROUP))).collect():
        got[r.sample_id, r.group_id].add((r.src, r.dst))
    for row in rows:
        assert got[row[0], row[1]] == set(shortest_forest(local(row)[1]))


@pytest.mark.parametrize("kind", ["path", "star", "comb"])
def test_any_shape_takes_few_rounds(spark, kind):
    n = 2000
    edges = {"path": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "comb": [(i, i + 1) for i in range(n // 2)] + [(i, n + i) for i in range(n // 2)]}[kind]
    df = spark.createDataFrame([(1, "g", a, b) for a, b in edges], "sample_id long, group_id string, src long, dst long")
    roots = spark.createDataFrame([(1, "g", 0)], "sample_id long, group_id string, node_id long")
    parents = rooted.oriented(df, roots)
    assert {r.node_id: r.parent for r in parents.collect()} == {0: None} | {b: a for a, b in edges}
    depth = rooted.along_root_paths(parents, {"n": F.lit(1), "top": F.col("node_id")}, lambda up, low: {"n": up("n") + low("n"), "top": F.greatest(up("top"), low("top"))})
    want = {0: 0}
    for a, b in edges:
        want[b] = want[a] + 1
    assert {r.node_id: r.n - 1 for r in depth.collect()} == want
    below = rooted.over_subtrees(parents, {"n": F.lit(1), "low": F.col("node_id")}, {"n": F.sum, "low": F.min})
    size = dict.fromkeys(want, 1)
    for a, b in sorted(edges, key=lambda e: -want[e[1]]):
        size[a] += size[b]
    assert {r.node_id: (r.n, r.low) for r in below.collect()} == {k: (v, k) for k, v in size.items()}


def test_trees_without_a_root_are_left_out(spark):
    df = spark.createDataFrame([(1, "g", 0, 1), (1, "g", 5, 6), (1, "g", 6, 7), (2, "h", 1, 2)], "sample_id long, group_id string, src long, dst long")
    roots = spark.createDataFrame([(1, "g", 1)], "sample_id long, group_id string, node_id long")
    assert sorted(map(tuple, rooted.oriented(df, roots).collect()), key=str) == [(1, "g", 0, 1), (1, "g", 1, None)]


def test_directed_topology(spark):
    rows = random_groups(2) + [(1, "ring", "branch", [(50.0, 0.0), (52.0, 0.0), (52.0, 2.0), (50.0, 2.0), (60.0, 1.0), (61.0, 1.0), (61.0, 3.0), (70.0, 9.0)], [[0, 1], [1, 2], [2, 3], [3, 0], [4, 5], [5, 6], [6, 4]]),
                             (3, "alone", "branch", [(4.0, 4.0), (4.0, 9.0)], [[0, 1]])]
    topology = rooted.directed_topology(spark.createDataFrame(rows, GROUP))
    got = defaultdict(dict)
    for r in topology.collect():
        got[r.sample_id, r.group_id][r.node_id] = (r.depth, r.parent)
    trunk = {row[0]: [np.array(p) for p in row[3]] for row in rows if row[2] == "trunk"}
    edges_in = defaultdict(int)
    for row in rows:
        first, edges = local(row)
        if row[2] == "trunk" or row[0] not in trunk:
            root = min(first, key=lambda n: (-XY(n)[1], first[n]))
        else:
            root = min(first, key=lambda n: (min(np.hypot(*(XY(n) - p)) for p in trunk[row[0]]), first[n]))
        want = search(near_of(edges), root)
        assert got[row[0], row[1]] == {n: want.get(n, (None, None)) for n in first}
        edges_in[row[0]] += len(want) - 1
    counts = {r.sample_id: (r.num_edges, r.is_dag) for r in rooted.topology_counts(topology).collect()}
    assert counts == {s: (n, True) for s, n in edges_in.items()}


def test_hierarchy_levels(spark):
    rows = random_groups(3)
    got = defaultdict(list)
    for r in rooted.hierarchy_levels(spark.createDataFrame(rows, GROUP)).collect():
        got[r.sample_id, r.group_id].append((r.node_id, r.i, round(r.x, 6), round(r.y, 6), r.level))
    for row in rows:
        first, edges = local(row)
        near, want, seen = near_of(shortest_forest(edges)), [], set()
        for root in sorted(first, key=first.get):
            stack = [(root, None, 0)] if root not in seen else []
            while stack:
                node, parent, level = stack.pop()
                seen.add(node)
                if parent is not None:
                    a, b = XY(parent), XY(node)
                    n = max(1, int(np.ceil(np.hypot(*(b - a)) / 3.0)))
                    want += [(node, i, *(round(float(v), 6) for v in a + (b - a) * i / n), min(level, 3)) for i in range(n + 1)]
                stack += [(m, node, level + (len(near[node]) >= 3)) for m in near[node] if m != parent]
        assert sorted(got[row[0], row[1]]) == sorted(want)


def test_group_diagnostics(spark):
    rows = random_groups(4) + [(1, "none", "branch", [(3.0, 3.0)], [])]
    got = {(r.sample_id, r.group_id): r for r in rooted.group_diagnostics(spark.createDataFrame(rows, GROUP)).collect()}
    trunk = [np.array(p) for p in rows[0][3]]
    far = lambda s, n: min(np.hypot(*(XY(n) - p)) for p in trunk) if s == 1 else 0.0
    assert set(got) == {(row[0], row[1]) for row in rows[1:]}
    for row in rows[1:]:
        _, edges = local(row)
        near = near_of(shortest_forest(edges))
        forks, angle, fall, seen = 0, 0.0, 0.0, set()
        for root in sorted(near, key=lambda n: (far(row[0], n), n)):
            stack = [(root, None, 0, 0.0)] if root not in seen else []
            while stack:
                node, parent, k, peak = stack.pop()
                seen.add(node)
                k, peak = k + (len(near[node]) >= 3), max(peak, far(row[0], node))
                forks, fall = max(forks, k), max(fall, peak - far(row[0], node))
                children = [m for m in near[node] if m != parent]
                if len(near[node]) >= 3:
                    way = [(XY(m) - XY(node)) / np.hypot(*(XY(m) - XY(node))) for m in children]
                    angle = max([angle, *[np.degrees(np.arccos(np.clip(a @ b, -1, 1))) for i, a in enumerate(way) for b in way[i + 1:]]])
                stack += [(m, node, k, peak) for m in children]
        r = got[row[0], row[1]]
        assert r.fork_depth == forks and abs(r.max_child_angle_deg - angle) < 1e-4 and abs(r.max_return_to_trunk_px - fall) < 1e-9


def plain_blocks(edges):
    """Edge sets of biconnected blocks, by depth-first search with an explicit stack."""
    near, order, low, found, held = near_of(edges), {}, {}, [], []
    for root in sorted(near):
        if root in order:
            continue
        order[root] = low[root] = len(order)
        stack = [(root, None, iter(sorted(near[root])))]
        while stack:
            node, parent, others = stack[-1]
            for m in others:
                if m == parent:
                    continue
                if m not in order:
                    held.append((node, m))
                    order[m] = low[m] = len(order)
                    stack.append((m, node, iter(sorted(near[m]))))
                    break
                if order[m] < order[node]:
                    held.append((node, m))
                    low[node] = min(low[node], order[m])
            else:
                stack.pop()
                if parent is not None:
                    low[parent] = min(low[parent], low[node])
                    if low[node] >= order[parent]:
                        at = held.index((parent, node))
                        found.append(frozenset((min(e), max(e)) for e in held[at:]))
                        del held[at:]
    return set(found)


@pytest.mark.parametrize("seed", range(3))
def test_blocks(spark, seed):
    rnd = random.Random(40 + seed)
    samples = {s: {tuple(sorted(rnd.sample(range(14 + 6 * seed), 2))) for _ in range(rnd.randrange(8, 26))} for s in range(25)}
    # two rings joined by a path, and two rings that share a node
    ring = lambda b, n: {(min(b + i, b + (i + 1) % n), max(b + i, b + (i + 1) % n)) for i in range(n)}
    samples[90] = ring(0, 4) | ring(10, 5) | {(2, 20), (20, 21), (11, 21)}
    samples[91] = ring(0, 4) | {(0, 9), (9, 10), (0, 10)}
    df = spark.createDataFrame([(s, a, b) for s, es in samples.items() for a, b in es], "sample_id long, src long, dst long")
    got = defaultdict(set)
    for r in rooted.blocks(df).collect():
        got[r.sample_id, r.block].add((r.src, r.dst))
    for s, edges in samples.items():
        assert {frozenset(v) for (k, _), v in got.items() if k == s} == plain_blocks(edges)
    assert sorted(len(v) for (k, _), v in got.items() if k == 90) == [1, 1, 1, 4, 5] and sorted(len(v) for (k, _), v in got.items() if k == 91) == [3, 4]


def test_trunk_cycles(spark):
    ring = [(0, 1), (1, 2), (2, 3), (0, 3)]
    edges = spark.createDataFrame([(1, a, b) for a, b in [*ring, (3, 10), (10, 11), (11, 12), (10, 12)]] + [(2, 0, 1)], "sample_id long, src long, dst long")
    far = spark.createDataFrame([(1, 0, 1.0), (1, 1, 12.0), (1, 2, 12.5), (1, 3, 30.0), (1, 10, 3.0), (1, 11, 99.0), (2, 0, 0.0), (2, 1, 0.0)], "sample_id long, node_id long, trunk_px double")
    clusters = spark.createDataFrame([(1, 7, 1), (1, 7, 2), (1, 8, 3), (1, 8, 10), (1, 7, 2)], "sample_id long, cluster_id long, node_id long")
    kinds, mapped, stats = rooted.trunk_cycles(edges, far, clusters)
    assert {(r.src, r.dst): r.kind for r in kinds.collect()} == {(0, 1): "trunk", (1, 2): "branch", (2, 3): "branch", (0, 3): "branch"}
    assert [(r.cluster_id, r.shared_nodes) for r in mapped.collect()] == [(7, 2)]
    assert sorted(map(tuple, stats.collect())) == [(1, 1, 1, 0), (2, 0, 0, 0)]


def test_groups_that_fit_a_task_take_no_rounds(spark, monkeypatch):
    groups = spark.createDataFrame(random_groups(7, n=8), GROUP)
    edges = graph.group_edges(groups)
    with monkeypatch.context() as only:
        for name in ("_forest_by_rounds", "_paths_by_rounds", "_breadth_by_rounds", "_blocks_by_rounds", "toured"):
            only.setattr(rooted, name, None)
        got = sorted(map(tuple, rooted.spanning_forest(edges).collect()))
        for found in (rooted.blocks(graph.build_graph(groups)[1]), rooted.hierarchy_levels(groups), rooted.directed_topology(groups)):
            assert not found.isEmpty()
    monkeypatch.setattr(rooted, "LIMIT", 1)
    assert got == sorted(map(tuple, rooted.spanning_forest(edges).collect()))
