"""Grid joins against all pairs, near and far, and cut lines at the edges of the rules."""

import numpy as np

from stemweave.functions.geometry import project_point
from stemweave.operators import spatial
from stemweave.plans.grid import nearest, within

EDGE = "sample_id long, segment_id long, x0 double, y0 double, x1 double, y1 double"


def brute(p, e):
    dx, dy = e[4] - e[2], e[5] - e[3]
    sq = dx * dx + dy * dy
    f = 0.0 if sq <= 1e-6 else min(1.0, max(0.0, ((p[0] - e[2]) * dx + (p[1] - e[3]) * dy) / sq))
    return float(np.hypot(p[0] - e[2] - f * dx, p[1] - e[3] - f * dy))


def scene(seed=0):
    rng = np.random.default_rng(seed)
    edges = [(1, i, *map(float, (x, y, x + u, y + v))) for i, (x, y, u, v) in enumerate(zip(*rng.integers(0, 300, (2, 80)), *rng.integers(-60, 60, (2, 80))))]
    points = [tuple(map(float, p)) for p in rng.integers(0, 300, (60, 2))] + [(-5000.0, 9000.0), (0.5, -0.5)]
    return edges, points


def test_nearest_and_within(spark):
    edges, points = scene()
    e = spark.createDataFrame(edges, EDGE)
    p = spark.createDataFrame([(1, *q) for q in points], "sample_id long, px double, py double")
    got = {(r.px, r.py): (r.segment_id, r.distance) for r in nearest(p, e, ["sample_id"], 2.0, ["segment_id"]).collect()}
    assert len(got) == len(set(points))
    for q in points:
        best = min((round(brute(q, x), 9), x[1]) for x in edges)
        assert abs(got[q][1] - best[0]) < 1e-6 and got[q][0] == best[1]
    pairs = {(r.px, r.py, r.segment_id) for r in within(p.distinct(), e, ["sample_id"], 25.0).collect()}
    assert pairs == {(*q, x[1]) for q in set(points) for x in edges if brute(q, x) <= 25.0}


def test_project_degenerate_edge(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(project_point(*[F.lit(v) for v in (3.0, 4.0, 0.0, 0.0, 0.0, 0.0)]).alias("p")).collect()[0].p
    assert row.fraction == 0.0 and row.distance == 5.0


def test_cut_statuses(spark):
    edges = [(1, 1, 0, 0.0, 0.0, 100.0, 0.0), (1, 2, 0, 100.0, 0.0, 200.0, 0.0), (1, 3, 0, 0.0, 50.0, 200.0, 50.0)]
    e = spark.createDataFrame(edges, "sample_id long, segment_id long, pos int, x0 double, y0 double, x1 double, y1 double")
    s = spark.createDataFrame([(1, 1, 1, "a", "j"), (1, 2, 1, "j", "b"), (1, 3, 0, "c", "d")], "sample_id long, segment_id long, is_candidate int, start_landmark_id string, end_landmark_id string")
    cuts = [(1, "one", 50.0, -5.0, 50.0, 5.0), (1, "joint", 100.0, -5.0, 100.0, 5.0), (1, "both", 50.0, -5.0, 50.0, 60.0), (1, "context", 50.0, 45.0, 50.0, 60.0), (1, "off", 0.0, 300.0, 9.0, 300.0), (1, "parallel", 0.0, 10.0, 100.0, 10.0)]
    c = spark.createDataFrame(cuts, "sample_id long, cut_id string, ax0 double, ay0 double, ax1 double, ay1 double")
    got = {r.cut_id: (r.status, r.suggested_segment_id) for r in spatial.map_cuts(c, e, s).collect()}
    assert got == {
        "one": ("unique_candidate", 1), "joint": ("shared_landmark_ambiguous", None), "both": ("multiple_physical_crossings", None),
        "context": ("context_only", None), "off": ("non_intersection", None), "parallel": ("non_intersection", None),
    }


def test_hits_of_one_polyline_are_merged_before_clusters_form(spark):
    """A zigzag that the cut crosses at 0.2, then at 0.9 and 1.5 of another segment: 1.5 is within a pixel of 0.9, which counts."""
    zig = [(0.9, -1.0, 0.9, 1.0), (0.9, 1.0, 1.5, 1.0), (1.5, 1.0, 1.5, -1.0)]
    rows = [(1, 1, 0, 0.2, -1.0, 0.2, 1.0)] + [(1, 2, i, *e) for i, e in enumerate(zig)]
    # the same with the far hit first: now 1.5 counts, and it is 1.3 away
    rows += [(2, 1, 0, 0.2, -1.0, 0.2, 1.0)] + [(2, 2, i, *e) for i, e in enumerate([(x1, y1, x0, y0) for x0, y0, x1, y1 in reversed(zig)])]
    e = spark.createDataFrame(rows, "sample_id long, segment_id long, pos int, x0 double, y0 double, x1 double, y1 double")
    s = spark.createDataFrame([(k, 1, 0, "a", "b") for k in (1, 2)] + [(k, 2, 1, "c", "d") for k in (1, 2)], "sample_id long, segment_id long, is_candidate int, start_landmark_id string, end_landmark_id string")
    c = spark.createDataFrame([(k, "cut", 0.0, 0.0, 9.0, 0.0) for k in (1, 2)], "sample_id long, cut_id string, ax0 double, ay0 double, ax1 double, ay1 double")
    assert {r.sample_id: r.status for r in spatial.map_cuts(c, e, s).collect()} == {1: "unique_candidate", 2: "multiple_physical_crossings"}


def test_label_cuts(spark):
    edges = [(1, 1, 0.0, 0.0, 100.0, 0.0), (1, 2, 0.0, 50.0, 100.0, 50.0), (1, 3, 200.0, 0.0, 200.0, 10.0)]
    e = spark.createDataFrame(edges, "sample_id long, segment_id long, x0 double, y0 double, x1 double, y1 double")
    s = spark.createDataFrame([(i, k, 10 * k, x0, y0, 10 * k + 1, x1, y1, 10 * k + 1) for i, k, x0, y0, x1, y1 in edges], "sample_id long, segment_id long, start_node long, start_x double, start_y double, end_node long, end_x double, end_y double, distal_node long")
    cuts = [(1, "one", 30.0, -5.0, 30.0, 5.0, 1.0, 0.0), (1, "back", 30.0, -5.0, 30.0, 5.0, -1.0, 0.0), (1, "two", 70.0, -5.0, 70.0, 60.0, 1.0, 0.0), (1, "none", 150.0, 20.0, 190.0, 5.0, 1.0, 0.0), (1, "far", 9000.0, 0.0, 9010.0, 0.0, 1.0, 0.0), (2, "empty", 0.0, 0.0, 1.0, 1.0, 1.0, 0.0)]
    c = spark.createDataFrame(cuts, "sample_id long, cut_id string, ax0 double, ay0 double, ax1 double, ay1 double, nx double, ny double")
    matches, checks = spatial.label_cuts(c, e, s, 8.0)
    got = {r.cut_id: (r.status, r.candidates, r.nearest_segment_id, r.nearest_distance_px) for r in matches.collect()}
    assert got == {"one": ("exact", 1, 1, 0.0), "back": ("exact", 1, 1, 0.0), "two": ("ambiguous", 2, 1, 0.0), "none": ("nonintersecting", 0, 3, 10.0), "far": ("nonintersecting", 0, 3, 8800.0), "empty": ("nonintersecting", 0, None, None)}
    ends = {(r.cut_id, r.segment_id): (r.exact, r.pruned_node, r.direction_consistent, r.start_dot, r.end_dot) for r in checks.collect()}
    assert ends == {("one", 1): (True, 11, True, -30.0, 70.0), ("back", 1): (True, 10, False, 30.0, -70.0), ("two", 1): (False, 11, True, -70.0, 30.0), ("two", 2): (False, 21, True, -70.0, 30.0)}


def test_arm_evidence_takes_the_chord_and_the_way_along(spark):
    """An arm of an L: 30 right, 40 up; its chord is 50 long and points along (0.6, 0.8)."""
    arms = spark.createDataFrame([(1, "L", 0, 0.0, 0.0, 30.0, 0.0), (1, "L", 1, 30.0, 0.0, 30.0, 40.0), (1, "far", 0, 900.0, 0.0, 910.0, 0.0), (1, "dot", 0, 500.0, 0.0, 500.0, 0.0)],
                                "sample_id long, arm_id string, pos int, x0 double, y0 double, x1 double, y1 double")
    points = [(1, 1, 2.0, 1.0, 0.6, 0.8, 1.0), (1, 2, 29.0, 3.0, -6.0, -8.0, 0.5), (1, 3, 31.0, 39.0, 0.8, -0.6, 9.0), (1, 4, 500.0, 1.0, 1.0, 0.0, 1.0)]
    p = spark.createDataFrame(points, "sample_id long, point_id long, px double, py double, vx double, vy double, weight double")
    got = {r.arm_id: r for r in spatial.arm_evidence(arms, p, 5.0).collect()}
    arm = got["L"]
    assert (arm.length_px, arm.chord_px, arm.points, arm.density) == (70.0, 50.0, 3, 0.06)
    assert abs(arm.mean_alignment - 2 / 3) < 1e-9 and abs(arm.terminal_progress - (0 + 30 / 70 + 1) / 3) < 1e-9
    assert abs(arm.flow_vote - (0.85 - 0.425) / 1.275) < 1e-9 and abs(arm.flow_confidence - 1.275 / 1.5) < 1e-9
    none = got["far"]
    assert (none.points, none.density, none.mean_alignment, none.terminal_progress, none.flow_vote, none.flow_confidence) == (0, 0.0, None, 0.5, 0.0, 0.0)
    assert (got["dot"].points, got["dot"].density, got["dot"].flow_vote) == (1, 0.0, 0.0)


def test_snapping_in_a_group_and_past_the_first_vertex(spark):
    points = spark.createDataFrame([(1, 1, "g", 1.0, 1.0), (1, 2, "h", 1.0, 1.0), (1, 3, "g", 40.0, 9.0)], "sample_id long, point_id long, group_id string, px double, py double")
    vertices = spark.createDataFrame([(1, "g", 10, 0, 0.0, 0.0), (1, "g", 11, 1, 8.0, 0.0), (1, "h", 20, 0, 50.0, 0.0), (1, "h", 21, 1, 60.0, 0.0)], "sample_id long, group_id string, vertex_id long, pos int, x double, y double")
    edges = spark.createDataFrame([(1, "g", 1, 0.0, 0.0, 8.0, 0.0), (1, "h", 2, 30.0, 0.0, 60.0, 0.0)], "sample_id long, group_id string, segment_id long, x0 double, y0 double, x1 double, y1 double")
    snap = lambda **how: {r.point_id: (r.snapped_to, r.sx, r.sy) for r in spatial.snap_points(points, edges.drop("group_id") if not how.get("in_group") else edges, vertices.drop("group_id") if not how.get("in_group") else vertices, **how).collect()}
    assert snap() == {1: ("vertex", 0.0, 0.0), 2: ("vertex", 0.0, 0.0), 3: ("line", 40.0, 0.0)}
    assert snap(in_group=True) == {1: ("vertex", 0.0, 0.0), 2: ("none", 1.0, 1.0), 3: ("none", 40.0, 9.0)}
    assert snap(skip_first=True) == {1: ("vertex", 8.0, 0.0), 2: ("vertex", 8.0, 0.0), 3: ("line", 40.0, 0.0)}


def test_keys_with_many_edges_take_the_grid(spark, monkeypatch):
    """A key meets whole up to ``grid.WHOLE`` edges without a round of its own; beyond that the answers are the same."""
    from stemweave.plans import grid

    edges, points = scene(3)
    e = spark.createDataFrame(edges + [(2, *x[1:]) for x in edges[:5]], EDGE)
    p = spark.createDataFrame([(k, *q) for k in (1, 2) for q in points], "sample_id long, px double, py double")
    tags, whole = [], grid.written
    monkeypatch.setattr(grid, "written", lambda frame, tag="stage": tags.append(tag) or whole(frame, tag))
    answer = lambda: {(r.sample_id, r.px, r.py, r.segment_id, r.distance) for r in nearest(p, e, ["sample_id"], 2.0, ["segment_id"]).collect()}
    want = answer()
    assert "hits" not in tags
    monkeypatch.setattr(grid, "WHOLE", 10)
    assert answer() == want and "hits" in tags
    cuts = spark.createDataFrame([(k, f"c{i}", float(x), float(y), float(x + 30), float(y - 9)) for k in (1, 2) for i, (x, y) in enumerate(points)], "sample_id long, cut_id string, ax0 double, ay0 double, ax1 double, ay1 double")
    found = lambda: {(r.sample_id, r.cut_id, r.segment_id, round(r.distance, 7)) for r in spatial.nearest_segments(cuts, e, 8.0).collect()}
    far = found()
    monkeypatch.setattr(grid, "WHOLE", 96)
    assert found() == far and len(far) == 2 * len(points)


def test_side_checks_search_no_nearest_segment(spark, monkeypatch):
    from stemweave.catalog import all_queries

    def no_search(*args, **kwargs):
        raise AssertionError("the nearest segment is not asked for")

    monkeypatch.setattr(spatial, "nearest_segments", no_search)
    assert next(q.build for q in all_queries() if q.name == "cut_side_checks")(spark, "/root/testdata/sf0.001").count() > 0


def test_line_metrics_reads_its_pixels_once(spark, monkeypatch):
    from stemweave.operators import pixels

    tags, whole = [], pixels.written
    monkeypatch.setattr(pixels, "written", lambda frame, tag="stage": tags.append(tag) or whole(frame, tag))
    side = lambda rows: spark.createDataFrame(rows, "sample_id long, x long, y long")
    row = pixels.line_metrics(side([(1, 0, 0), (1, 3, 4)]), side([(1, 0, 0)]), 2.0).collect()[0]
    assert (row.precision, row.recall, row.chamfer) == (0.5, 1.0, 1.25) and tags == ["pixels", "pixels", "distances"]


def test_coverage_takes_minima_without_sorting_pairs(spark):
    from stemweave.operators import pixels

    line = spark.createDataFrame([(1, 0, x, 0) for x in range(40)], "sample_id long, component_label long, x long, y long")
    edges = spark.createDataFrame([(1, 0.0, 3.0, 9.0, 3.0)] * 200, "sample_id long, x0 double, y0 double, x1 double, y1 double")
    found = pixels.coverage(line, edges, 12.0, 4.0, 10)
    assert "SortAggregate" not in found._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [(1, 21 / 40, 12 / 40, 1)]


def test_component_votes_in_tasks_equal_those_by_cells(spark, monkeypatch):
    import random

    rnd = random.Random(4)
    points = spark.createDataFrame([(rnd.randrange(5), f"p{i}", rnd.randrange(-6, 30), rnd.randrange(20)) for i in range(300)] + [(None, "n", 1, 1), (9, "alone", 2, 2)], "sample_id long, name string, px long, py long")
    dots = [(rnd.randrange(5), rnd.randrange(4), rnd.randrange(-5, 25), rnd.randrange(20)) for _ in range(700)]
    pixels = spark.createDataFrame([*dots, dots[0], (None, 1, 1, 1), (8, 1, 1, 1)], "sample_id long, component_label int, x long, y long")
    far = points.unionByName(spark.createDataFrame([(7, "far", 1 << 40, 3), (6, "none", None, 3)], points.schema))
    want = [sorted(map(repr, spatial._component_by_cells(p, pixels, 2).collect())) for p in (points, far)]
    assert sorted(map(repr, spatial.nearest_component(far, pixels, 2).collect())) == want[1]
    monkeypatch.setattr(spatial, "_component_by_cells", lambda points, *_: points.filter("sample_id IS NULL").selectExpr("*", "CAST(NULL AS int) AS component_label", "CAST(NULL AS bigint) AS votes"))
    assert sorted(map(repr, spatial.nearest_component(points, pixels, 2).collect())) == want[0]
