"""Greedy operators against the one-by-one rules."""

import networkless as nl
import numpy as np
from pyspark.sql import functions as F

from stemweave.operators import clusters, greedy, splits


def random_boxes(n=150, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x, y = rng.integers(0, 60, 2)
        w, h = rng.integers(8, 20, 2)
        rows.append((int(i % 3), int(i), float(x), float(y), float(x + w), float(y + h), float(rng.integers(0, 20)) / 20, int(rng.integers(0, 2))))
    return rows


SCHEMA = "sample_id long, box_id long, x1 double, y1 double, x2 double, y2 double, score double, label int"


def test_nms(spark):
    rows = random_boxes() + [(0, 900, 1.0, 1.0, 9.0, 9.0, 0.5, 0), (0, 901, 1.0, 1.0, 9.0, 9.0, 0.5, 0)]
    got = {r.box_id for r in greedy.nms(spark.createDataFrame(rows, SCHEMA), 0.5, 16.0).collect()}
    want = set()
    for s in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (-r[6], r[1])):
            if all(nl.iou(k[2:6], r[2:6]) <= 0.5 for k in kept):
                kept.append(r)
        want |= {r[1] for r in kept}
    assert got == want


def test_cross_class_in_order(spark):
    rows = random_boxes(120, 4)
    got = {r.box_id for r in greedy.suppress_cross_class(spark.createDataFrame(rows, SCHEMA), 0.5, 16.0).collect()}
    gone = set()
    area = lambda r: (r[4] - r[2]) * (r[5] - r[3])
    for s in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1])
        for f in (r for r in mine if r[7] == 0):
            for l in (r for r in mine if r[7] == 1):
                if l[1] in gone:
                    continue
                w, h = min(f[4], l[4]) - max(f[2], l[2]), min(f[5], l[5]) - max(f[3], l[3])
                if w > 0 and h > 0 and w * h / min(area(f), area(l)) > 0.5:
                    gone.add(l[1] if f[6] >= l[6] else f[1])
    assert got == {r[1] for r in rows} - gone


def test_sparsify_and_limit(spark):
    rng = np.random.default_rng(7)
    pts = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 30, (200, 2)))]
    kept = []
    for p in pts:
        if all(np.hypot(p[2] - k[2], p[3] - k[3]) >= 5 for k in kept):
            kept.append(p)
    df = spark.createDataFrame(pts, "sample_id long, point_id long, x double, y double")
    assert {r.point_id for r in greedy.sparsify(df, 5.0).collect()} == {k[1] for k in kept}
    assert {r.point_id for r in greedy.sparsify(df, 5.0, 4).collect()} == {k[1] for k in kept[:4]}


def test_match_points_is_greedy(spark):
    rng = np.random.default_rng(5)
    a = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 40, (60, 2)))]
    b = [(1, i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 40, (50, 2)))]
    schema = "sample_id long, point_id long, x double, y double"
    row = greedy.match_points(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 6.0).collect()[0]
    pairs = sorted((np.hypot(p[2] - q[2], p[3] - q[3]), p[1], q[1]) for p in a for q in b if np.hypot(p[2] - q[2], p[3] - q[3]) <= 6)
    left, right, used = set(), set(), []
    for d, p, q in pairs:
        if p not in left and q not in right:
            left.add(p), right.add(q), used.append(d)
    assert row.matched == len(used) and abs(row.mean_distance - np.mean(used)) < 1e-9


def test_branch_detection_takes_first_free(spark):
    pairs = spark.createDataFrame([(1, 0, 1, 1.0), (1, 0, 0, 2.0), (1, 1, 0, 1.0), (1, 2, 0, 1.0), (1, 3, 5, 99.0)], "sample_id long, pred_id long, gt_id long, distance double")
    groups = spark.createDataFrame([(1, 4, 3)], "sample_id long, n_pred long, n_gt long")
    row = greedy.branch_detection(pairs, groups, 24.0).collect()[0]
    assert (row.tp, row.fp, row.fn) == (1, 3, 2)


def test_balanced_folds_one_by_one(spark):
    rng = np.random.default_rng(9)
    sizes = {t: int(n) for t, n in enumerate(rng.integers(1, 9, 70))}
    rows = [(t, i) for t, n in sizes.items() for i in range(n)]
    got = {r.tree_id: r.fold for r in splits.balanced_folds(spark.createDataFrame(rows, "tree_id long, i int"), k=4).collect()}
    load, want = [0] * 4, {}
    for t, n in sorted(sizes.items(), key=lambda kv: (-kv[1], kv[0])):
        f = int(np.argmin(load))
        want[t] = f
        load[f] += n
    assert got == want


def test_cluster_junctions_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    pts = sorted({(int(x), int(y)) for x, y in rng.integers(0, 40, (90, 2))})
    rows = [(1, i, x, y, 4, False) for i, (x, y) in enumerate(pts)]
    j = spark.createDataFrame(rows, "sample_id long, node_id long, x long, y long, degree long, is_trunk boolean")
    seg = spark.createDataFrame([], "sample_id long, start_node long, end_node long, length_px double")
    got = {r.node_id: r.cluster_id for r in clusters.cluster_junctions(j, seg, 3.0).collect()}
    close = [(i, k) for i, (a, b) in enumerate(pts) for k, (c, d) in enumerate(pts) if i < k and np.hypot(a - c, b - d) <= 3]
    assert got == nl.components(range(len(pts)), close)


def test_contact_clusters(spark):
    pts = [(1, "c", "p", float(x), 1.0) for x in (0, 1, 2, 10, 11, 30)] + [(1, "c", "p", 20.0, 50.0)]
    df = spark.createDataFrame(pts, "sample_id long, group_id string, parent_id string, x double, y double")
    edges = spark.createDataFrame([(1, "p", 0.0, 0.0, 60.0, 0.0)], "sample_id long, parent_id string, x0 double, y0 double, x1 double, y1 double")
    assert clusters.contact_count(df, edges, 1.5).collect()[0].contacts == 3
    ignored = spark.createDataFrame([(1, "c", 55.0, 1.0)], "sample_id long, group_id string, x double, y double")
    # the crossing at 55 is 25 from the pixel at 30, so every cluster still counts
    assert clusters.contact_count(df, edges, 1.5, ignored).collect()[0].contacts == 3
    ignored = ignored.withColumn("x", F.lit(53.0))
    assert clusters.contact_count(df, edges, 1.5, ignored).collect()[0].contacts == 2


def test_registered_sparsify_reads_every_class(spark):
    from stemweave.catalog import all_queries
    from stemweave.catalog.greedy import all_points

    sf = "/root/testdata/sf0.001"
    label = {(r.sample_id, r.point_id): r.label for r in all_points(spark, sf).collect()}
    build = next(q.build for q in all_queries() if q.name == "sparsify")
    assert {label[r.sample_id, r.point_id] for r in build(spark, sf).collect()} > {0}


def test_short_paths_link_junctions_off_the_trunk(spark):
    rows = [(1, i, 100 * i, 0, 4 if i == 5 else 3, i == 3) for i in range(1, 7)]
    j = spark.createDataFrame(rows, "sample_id long, node_id long, x long, y long, degree long, is_trunk boolean")
    seg = spark.createDataFrame([(1, 1, 2, 48.0), (1, 2, 3, 20.0), (1, 4, 5, 20.0), (1, 4, 6, 48.5), (1, 6, 1, 30.0)], "sample_id long, start_node long, end_node long, length_px double")
    # 3 is on the trunk, 5 has four arms, and 4 - 6 is too long
    assert {r.node_id: r.cluster_id for r in clusters.cluster_junctions(j, seg, 3.0).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}


def test_samples_that_fit_a_task_need_no_rounds(spark, monkeypatch):
    """Whole samples give what the rounds give, without a pair or a round; big samples and missing values take the rounds."""
    boxes = spark.createDataFrame(random_boxes(200, 3) + [(0, 900 + i, 1.0, 1.0, 9.0, 9.0, 0.5, 0) for i in range(3)], SCHEMA)
    rng = np.random.default_rng(11)
    schema = "sample_id long, point_id long, x double, y double"
    sides = [spark.createDataFrame([(int(i % 3) if side else int(i % 4), i, float(x), float(y)) for i, (x, y) in enumerate(rng.integers(0, 25, (120, 2)))], schema) for side in (0, 1)]
    asked = {
        "nms": lambda: greedy.nms(boxes, 0.4, 16.0).select("sample_id", "box_id"),
        "sparsify": lambda: greedy.sparsify(sides[0], 5.0),
        "limited": lambda: greedy.sparsify(sides[0], 3.0, 4),
        "match": lambda: greedy.match_points(*sides, 4.0),
        "detection": lambda: greedy.point_detection(*sides, 4.0),
    }
    rows = lambda: {n: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in q().collect()) for n, q in asked.items()}
    with monkeypatch.context() as m:
        for name in ("keep_strongest", "mutual_match", "within", "box_pairs"):
            m.setattr(greedy, name, None)
        whole = rows()
    with monkeypatch.context() as m:
        m.setattr(greedy, "WHOLE", 45)
        m.setattr(greedy, "MEET", 65)
        assert rows() == whole
    odd = sides[0].unionByName(spark.createDataFrame([(0, 500, None, 3.0), (0, 501, float("nan"), 3.0), (None, 502, 1.0, 1.0)], schema))
    assert {r.point_id for r in greedy.sparsify(odd, 5.0).collect()} == {r[1] for r in whole["sparsify"]} | {500, 501}
    pairs = {r.sample_id: (r.pred_points, r.matched) for r in greedy.match_points(odd, sides[1], 4.0).collect()}
    assert pairs == {s: (n + 2 * (s == 0), k) for s, n, _, k, *_ in whole["match"]} | {None: (1, 0)}


def test_groups_of_any_length_are_whole():
    import pyarrow as pa

    from stemweave.plans.slices import whole_runs

    key = np.repeat(np.arange(9), [1, 5, 1, 23, 2, 2, 11, 1, 4])
    table = pa.table({"k": [f"g{k}" for k in key], "v": np.arange(len(key))})
    for size in (1, 3, 7, 100):
        seen = [(t["k"][int(a)].as_py(), t["v"][int(a):int(b)].to_pylist()) for t, cut in whole_runs(iter(table.to_batches(size)), ["k"]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        assert seen == [(f"g{k}", np.flatnonzero(key == k).tolist()) for k in range(9)]
    assert list(whole_runs(iter([]), ["k"])) == []
