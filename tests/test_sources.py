"""Annotation readers on small files and the incremental audit across a restart."""

import json

from stemweave.operators.splits import audit_feature_list
from stemweave.operators.features import feature_sets
from stemweave.sources import annotations as src
from stemweave.streaming.audit import audit_stream


def put(folder, name, value):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")


def test_skeletons(spark, tmp_path):
    groups = [{"group_id": "trunk", "group_type": "trunk", "points": [[0, 0], [0, 5], [0, 9]]}, {"group_id": "b1", "group_type": "branch", "points": [[0, 5], [4, 5]], "edges": [[1, 0]]}]
    put(tmp_path, "a.json", {"image_path": "a.jpg", "image_width": 10, "image_height": 10, "groups": groups})
    put(tmp_path, "b.json", "{not json")
    rows = src.read_skeletons(spark, str(tmp_path)).collect()
    by = {r.group_id: r for r in rows}
    assert by["trunk"].edges == [[0, 1], [1, 2]] and by["b1"].edges == [[1, 0]]
    assert by[None]._corrupt_record is not None and len(rows) == 3
    assert src.group_points(src.read_skeletons(spark, str(tmp_path / "a.json"))).count() == 5


def test_coco_labelme_csv_and_files(spark, tmp_path):
    coco = {
        "images": [{"id": 1, "file_name": "tree_1_view_1.jpg", "width": 9, "height": 9}, {"id": 2, "file_name": "other.jpg", "width": 9, "height": 9}],
        "annotations": [{"id": 5, "image_id": 1, "segmentation": [[0, 0, 4, 0, 4, 4], [1, 1, 2, 2]]}, {"id": 6, "image_id": 1, "segmentation": {"counts": "abc", "size": [9, 9]}}],
    }
    put(tmp_path / "coco", "c.json", coco)
    images, polygons, bad = src.read_coco(spark, str(tmp_path / "coco"), r"tree_\d+")
    assert images.count() == 1 and [(r.file_name, r.reason) for r in bad.collect()] == [("other.jpg", "name_mismatch")]
    rows = polygons.collect()
    assert sorted(len(r.polygon) for r in rows if r.polygon) == [3] and sum(r.rle is not None for r in rows) == 1
    put(tmp_path / "lm", "l.json", {"imageWidth": 10, "imageHeight": 8, "imagePath": "x", "shapes": [{"label": "Branch", "points": [[-1, 0], [20, 20], [3, 3]]}, {"label": "sky", "points": [[0, 0], [1, 1], [2, 2]]}]})
    lm = src.read_labelme(spark, str(tmp_path / "lm"), ["branch"]).collect()
    assert [(p.x, p.y) for p in lm[0].polygon] == [(0.0, 0.0), (9.0, 7.0), (3.0, 3.0)] and len(lm) == 1
    put(tmp_path / "csv", "f.csv", "﻿branch_id,a,b\nx,1.5,\ny,,oops\n")
    assert {r.branch_id: r.features for r in src.read_feature_csv(spark, str(tmp_path / "csv"), "branch_id").collect()} == {"x": {"a": 1.5}, "y": {}}
    inventory = src.scan_files(spark, str(tmp_path), "*.json").collect()
    assert len(inventory) == 2 and all(len(r.sha256) == 64 for r in inventory)
    src.write_table(polygons.select("image_id"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_broken_files_are_reported(spark, tmp_path):
    put(tmp_path / "coco", "a.json", "{broken")
    put(tmp_path / "coco", "b.json", {"images": [{"id": 1, "file_name": "tree_1.jpg", "width": 9, "height": 9}], "annotations": [{"id": 5, "image_id": 7, "segmentation": [[0, 0, 4, 0, 4, 4]]}]})
    images, polygons, bad = src.read_coco(spark, str(tmp_path / "coco"), "tree")
    assert images.count() == 1 and polygons.count() == 0 and sorted((r.id, r.reason) for r in bad.collect() if r.id) + [r.reason for r in bad.collect() if not r.id] == [(7, "missing_image"), "invalid_json"]
    put(tmp_path / "lm", "l.json", "{broken")
    assert [r._corrupt_record is not None for r in src.read_labelme(spark, str(tmp_path / "lm"), ["branch"]).collect()] == [True]


def test_failed_write_keeps_the_old_table(spark, tmp_path):
    import pytest

    path = str(tmp_path / "t")
    src.write_table(spark.range(3), path)
    with pytest.raises(Exception):
        src.write_table(spark.range(5).selectExpr("if(id = 4, raise_error('no'), id) AS id"), path)
    assert spark.read.parquet(path).count() == 3 and [p.name for p in tmp_path.iterdir()] == ["t"]
    src.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5


def test_many_sources_of_one_content(spark):
    from pyspark.sql import functions as F

    from stemweave.operators import manifest

    files = spark.range(5000).select(F.lit("x").alias("digest"), F.lit("t").alias("task"), F.format_string("s%05d", "id").alias("source_id"))
    head = manifest.dedupe_by_content(files).collect()
    assert len(head) == 1 and head[0].sources == 5000 and head[0].first_source == "s00000"
    places = manifest.content_sources(files).orderBy("place").collect()
    assert [r.place for r in places] == list(range(1, 5001)) and places[-1].source_id == "s04999"


def test_paired_arms_keep_apart(spark):
    from stemweave.operators import graph

    edges = spark.createDataFrame([(1, 10 + i, 50) for i in range(4)], "sample_id long, src long, dst long")
    members = spark.createDataFrame([(1, 50, 7)], "sample_id long, node_id long, cluster_id long")
    pairs = spark.createDataFrame([(1, 7, 10, 999), (1, 7, 11, 5000), (1, 7, 12, 5000)], "sample_id long, cluster_id long, arm_node long, pair_no long")
    assert sorted(((r.src, r.pair_no) for r in graph.uncross(edges, members, pairs).collect()), key=str) == [(10, 999), (11, 5000), (12, 5000), (13, None)]


def cut_file(view, cut_id="c1", p1=(5, 5)):
    line = {"cut_id": cut_id, "p0": [1, 1], "p1": list(p1), "normal_pruned_side": [1, 0], "normal_retained_side": [-1, 0], "confirmed": True}
    return {"tree_id": "tree_1", "view": view, "image_stage": "before", "image_path": "", "reference_after_path": "", "cut_lines": [line, line]}


def test_cut_lines_and_stream(spark, tmp_path):
    inbox, out, state = tmp_path / "in", tmp_path / "out", tmp_path / "state"
    put(inbox, "1.json", cut_file("v1"))
    put(inbox, "copy.json", cut_file("v1"))
    put(inbox, "2.json", cut_file("v2", p1=(1, 1)))
    assert src.read_cut_lines(spark, str(inbox)).count() == 6
    images = spark.createDataFrame([("tree_1_v1", 10, 10), ("tree_1_v2", 10, 10)], "sample_id string, width int, height int")
    run = lambda: audit_stream(spark, str(inbox), images, str(out), str(state)).awaitTermination()
    run()
    issues = lambda: sorted((r.sample_id, r.code) for r in spark.read.json(str(out)).collect())
    first = [("tree_1_v1", "duplicate_cut_id"), ("tree_1_v2", "duplicate_cut_id"), ("tree_1_v2", "zero_length_cut"), ("tree_1_v2", "zero_length_cut")]
    assert issues() == first
    put(inbox, "4.json", cut_file("v1") | {"image_stage": "after"})
    run()
    assert issues().count(("tree_1_v1", "duplicate_cut_id")) == 2
    first = issues()
    put(inbox, "3.json", "{broken")
    run()
    assert issues() == sorted(first + [("", "invalid_json")])
    run()
    assert len(issues()) == len(first) + 1


def test_driver_side_checks():
    assert audit_feature_list(["a", "b"], ["c"], 2) == []
    assert audit_feature_list(["a", "c"], ["c"], 3) == ["forbidden:c", "count:2"]
    sets, missing = feature_sets(["a", "b"], {"g": ["a", "z"], "h": ["b"]}, {"full": [], "no_h": ["h"]})
    assert sets == {"full": ["a", "b"], "no_h": ["a"]} and missing == {"g": ["z"], "h": []}
