"""Graph operators on graphs whose answers are known, and with tiny slices against whole samples."""

from functools import partial

import networkless as nl
import numpy as np
import pytest
from pyspark.sql import functions as F

from stemweave.operators import graph
from stemweave.plans import slices


def edges_df(spark, edges, sample=1):
    rows = [(sample, min(a, b), max(a, b)) for a, b in edges]
    return spark.createDataFrame(rows, "sample_id long, src long, dst long")


def nodes_df(spark, nodes, sample=1):
    return spark.createDataFrame([(sample, n, 0, n) for n in nodes], "sample_id long, node_id long, x long, y long")


def random_edges(seed, n=60, m=55):
    rng = np.random.default_rng(seed)
    return {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b}


@pytest.mark.parametrize("limit", [slices.LIMIT, 5])
def test_components(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "sliced", partial(slices.sliced, limit=limit))
    edges = random_edges(3)
    got = {r.node_id: r.component_id for r in graph.components(nodes_df(spark, range(60)), edges_df(spark, edges)).collect()}
    assert got == nl.components(range(60), edges)


@pytest.mark.parametrize("limit", [slices.LIMIT, 4])
def test_trace_chain_ring_and_tail(spark, monkeypatch, limit):
    monkeypatch.setattr(graph, "sliced", partial(slices.sliced, limit=limit))
    chain = [(i, i + 1) for i in range(20)]
    ring = [(100, 101), (101, 102), (102, 103), (103, 100)]
    tail = [(10, 50), (50, 51)]
    edges = edges_df(spark, chain + ring + tail)
    nodes = nodes_df(spark, sorted({n for e in chain + ring + tail for n in e}))
    roots = spark.createDataFrame([(1, 100), (1, 0)], "sample_id long, node_id long")
    rows = graph.trace_segments(nodes, edges, roots).collect()
    assert len(rows) == len(chain) + len(ring) + len(tail)
    chains = {}
    for r in rows:
        chains.setdefault((r.start_node, r.first_node), []).append((r.pos, r.src, r.dst))
    walked = {k: [v[0][1]] + [d for _, _, d in v] for k, v in ((k, sorted(v)) for k, v in chains.items())}
    assert walked[(0, 1)] == list(range(11))
    assert walked[(10, 11)] == list(range(10, 21))
    assert walked[(10, 50)] == [10, 50, 51]
    assert walked[(100, 101)] == [100, 101, 102, 103, 100]
    assert len(walked) == 4


def test_two_core_and_dag(spark):
    ring = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4)]
    assert sorted((r.src, r.dst) for r in graph.two_core(edges_df(spark, ring)).collect()) == [(0, 1), (0, 2), (1, 2)]
    directed = spark.createDataFrame([(1, 0, 1), (1, 1, 2), (1, 2, 0), (2, 0, 1), (2, 0, 2), (2, 1, 2)], "sample_id long, src long, dst long")
    assert dict(graph.is_dag(directed).collect()) == {1: False, 2: True}


def segments_df(spark, rows):
    return spark.createDataFrame(rows, "sample_id long, segment_id string, start_node long, end_node long, length_px double")


def test_neighbours_with_twins_and_loop(spark):
    seg = segments_df(spark, [(1, "a", 1, 2, 1.0), (1, "b", 1, 2, 2.0), (1, "c", 2, 3, 4.0), (1, "d", 3, 3, 8.0), (1, "e", 9, 8, 16.0)])
    got = {r.segment_id: (r.neighbors, r.sum_length_px) for r in graph.neighbor_sums(seg, ["length_px"]).collect()}
    assert got == {"a": (2, 6.0), "b": (2, 5.0), "c": (3, 11.0), "d": (1, 4.0), "e": (0, 0.0)}


def test_depth_distance_orientation_and_fate(spark):
    seg = segments_df(spark, [(1, "a", 1, 2, 5.0), (1, "b", 2, 3, 2.0), (1, "c", 4, 3, 1.0), (1, "x", 7, 8, 1.0)])
    roots = spark.createDataFrame([(1, 1)], "sample_id long, node_id long")
    assert {r.segment_id: r.depth for r in graph.bfs_depth(seg, roots).collect()} == {"a": 0, "b": 1, "c": 2, "x": 3}
    d = graph.root_distance(seg.select("sample_id", F.col("start_node").alias("src"), F.col("end_node").alias("dst"), "length_px"), roots)
    assert {r.node_id: r.distance for r in d.collect()} == {1: 0.0, 2: 5.0, 3: 7.0, 4: 8.0}
    o = {r.segment_id: (r.proximal_node, r.distal_node, r.parent_segment_id) for r in graph.orient(seg, d).collect()}
    assert o["a"] == (1, 2, None) and o["b"] == (2, 3, "a") and o["c"] == (3, 4, "b")
    cut = spark.createDataFrame([(1, "b")], "sample_id long, segment_id string")
    tip = spark.createDataFrame([(1, 3)], "sample_id long, node_id long")
    assert {r.segment_id: (r.fate, r.is_cut) for r in graph.propagate_fate(seg, cut, tip).collect()} == {"a": ("retained", 0), "b": ("pruned", 1), "c": ("pruned", 0), "x": ("retained", 0)}


def test_fate_of_cuts(spark):
    seg = segments_df(spark, [(1, "a", 1, 2, 5.0), (1, "b", 2, 3, 2.0), (1, "c", 3, 4, 1.0), (1, "d", 2, 5, 1.0), (1, "e", 7, 8, 1.0), (1, "f", 8, 9, 1.0)])
    checks = spark.createDataFrame([(1, "k1", "b", True, 2), (1, "k2", "b", True, 3), (1, "k3", "e", False, 8), (1, "k3", "f", False, 8)], "sample_id long, cut_id string, segment_id string, exact boolean, pruned_node long")
    # k2 is the last cut of b, so what lies behind node 3 goes; the two segments of the ambiguous k3 go, but none of them is cut
    assert {r.segment_id: (r.fate, r.is_cut) for r in graph.fate_of_cuts(seg, checks).collect()} == {
        "a": ("retained", 0), "b": ("pruned", 1), "c": ("pruned", 0), "d": ("retained", 0), "e": ("pruned", 0), "f": ("pruned", 0)}


def test_split_joins_to_the_last_kept_event(spark):
    seg = segments_df(spark, [(1, "a", 1, 2, 10.0)])
    events = spark.createDataFrame([(1, "a", 0.4, "p"), (1, "a", 5.0, "q"), (1, "a", 5.4, "r"), (1, "a", 5.8, "s"), (1, "a", 9.8, "t")], "sample_id long, segment_id string, arc double, event_id string")
    rows = sorted((r.start_arc_px, r.end_arc_px, r.start_event, r.end_event) for r in graph.split_at_events(seg, events).collect())
    # 5.4 joins 5.0; 5.8 is 0.8 from the kept 5.0 and stays although it is 0.4 from 5.4
    assert rows == [(0.0, 5.0, "start", "q"), (5.0, 5.8, "q", "s"), (5.8, 9.8, "s", "t")]
    assert abs(sum(b - a for a, b, _, _ in rows) - 9.8) < 1e-9


def test_pair_angle_sums_equal_pairs(spark):
    rng = np.random.default_rng(2)
    centre = int((0 + (1 << 20)) * (1 << 22) + (1 << 20))
    pts = {(int(x), int(y)) for x, y in rng.integers(-6, 7, (12, 2)) if (x, y) != (0, 0)} | {(3, 0), (-3, 0), (0, 3), (0, -3)}
    key = lambda x, y: (x + (1 << 20)) * (1 << 22) + y + (1 << 20)
    edges = edges_df(spark, [(centre, key(x, y)) for x, y in pts])
    got = {r.angle_class: (r.pairs, r.angle_sum) for r in graph.pair_angle_sums(graph.node_directions(edges), [15.0, 120.0, 180.0]).filter(F.col("node_id") == centre).collect()}
    angles = []
    pts = sorted(pts)
    for i, (ax, ay) in enumerate(pts):
        for bx, by in pts[i + 1:]:
            angles.append(np.degrees(np.arccos(np.clip((ax * bx + ay * by) / np.hypot(ax, ay) / np.hypot(bx, by), -1, 1))))
    angles = np.array(angles)
    branch, cross = angles[(angles >= 15 - 1e-6) & (angles < 120 - 1e-6)], angles[angles >= 120 - 1e-6]
    assert got[0][0] == len(branch) and got[1][0] == len(cross)
    assert abs(got[0][1] - branch.sum()) < 1e-3 and abs(got[1][1] - cross.sum()) < 1e-3


def test_prepend_anchor_and_bad_edges(spark):
    g = spark.createDataFrame([(1, "g", [(0.0, 0.0), (5.0, 0.0), (5.0, 0.0)], [[0, 1], [1, 2], [0, 9]])], "sample_id long, group_id string, points array<struct<x:double,y:double>>, edges array<array<int>>")
    assert graph.group_edges(g).count() == 1
    a = spark.createDataFrame([(1, "g", 9.0, 9.0, 1)], "sample_id long, group_id string, x double, y double, attach_pos int")
    row = graph.prepend_anchor(g, a).collect()[0]
    assert row.edges[0] == [0, 2] and row.edges[1] == [1, 2] and row.points[0].x == 9.0


def test_registered_is_dag_reads_every_group(spark):
    from stemweave import fixtures as fx
    from stemweave.catalog import all_queries

    sf = "/root/testdata/sf0.001"
    after, groups = {}, set()
    for r in graph.group_edges(fx.groups(spark, sf)).collect():
        groups.add(r.group_id % 8)
        a, b = (r.src, r.dst) if r.group_id % 8 == 0 else (r.dst, r.src)
        after.setdefault(r.sample_id, {}).setdefault(a, set()).add(b)
        after[r.sample_id].setdefault(b, set())
    assert groups == set(range(8))
    want = {}
    for sample, nexts in after.items():
        left = dict(nexts)
        while leaves := [n for n, m in left.items() if not any(x in left for x in m)]:
            for n in leaves:
                del left[n]
        want[sample] = not left
    build = next(q.build for q in all_queries() if q.name == "is_dag")
    assert {r.sample_id: r.is_dag for r in build(spark, sf).collect()} == want


def test_owners_of_whole_samples_need_no_rounds(spark, monkeypatch):
    """Owners found in tasks are those of the rounds: ties, lone nodes, samples without an anchor, anchors off the graph."""
    rng = np.random.default_rng(8)
    edges = sorted({(int(i % 4), *sorted(map(int, e))) for i, e in enumerate(rng.integers(0, 60, (160, 2))) if e[0] != e[1]})
    nodes = sorted({(s, v) for s, a, b in edges for v in (a, b)} | {(1, 777), (9, 5)})
    anchors = [(int(s), int(v), f"o{k}") for k, (s, v) in enumerate(zip(rng.integers(0, 3, 12), rng.integers(0, 60, 12), strict=True))] + [(0, 999, "a"), (7, 1, "z")]
    frames = (
        spark.createDataFrame(nodes, "sample_id long, node_id long"),
        spark.createDataFrame(edges, "sample_id long, src long, dst long"),
        spark.createDataFrame(anchors, "sample_id long, node_id long, owner string"),
    )
    rows = lambda: sorted((r.sample_id, r.node_id, r.owner or "", -1 if r.owner is None else r.hops) for r in graph.assign_owners(*frames).collect())
    with monkeypatch.context() as m:
        m.setattr(graph, "fixpoint", None)
        whole = rows()
    monkeypatch.setattr(graph, "LIMIT", 0)
    assert rows() == whole
    assert (1, 777, "", -1) in whole and (9, 5, "", -1) in whole and len(whole) == len(nodes) and any(h > 1 for *_, h in whole)
