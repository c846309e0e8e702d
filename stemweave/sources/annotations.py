"""Readers of annotation files into tables, with explicit schemas and rejects as rows."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemweave.functions.geometry import clamp, linear_chain

NUMBERS = T.ArrayType(T.DoubleType())
GROUP = T.StructType([
    T.StructField("group_id", T.StringType()), T.StructField("group_type", T.StringType()), T.StructField("color_hex", T.StringType()),
    T.StructField("points", T.ArrayType(NUMBERS)), T.StructField("edges", T.ArrayType(T.ArrayType(T.IntegerType()))),
    T.StructField("fork_origin_group", T.StringType()), T.StructField("current_anchor_idx", T.IntegerType()),
])
SKELETON = T.StructType([
    T.StructField("image_path", T.StringType()), T.StructField("image_width", T.IntegerType()), T.StructField("image_height", T.IntegerType()),
    T.StructField("groups", T.ArrayType(GROUP)), T.StructField("_corrupt_record", T.StringType()),
])
CUT = T.StructType([
    T.StructField("cut_id", T.StringType()), T.StructField("p0", NUMBERS), T.StructField("p1", NUMBERS), T.StructField("normal_pruned_side", NUMBERS),
    T.StructField("normal_retained_side", NUMBERS), T.StructField("confirmed", T.BooleanType()),
])
CUT_FILE = T.StructType([
    *[T.StructField(n, T.StringType()) for n in ("tree_id", "view", "image_stage", "image_path", "reference_after_path")],
    T.StructField("cut_lines", T.ArrayType(CUT)), T.StructField("_corrupt_record", T.StringType()),
])
COCO = T.StructType([
    T.StructField("images", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("file_name", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))),
    T.StructField("annotations", T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("image_id", T.LongType()), T.StructField("segmentation", T.StringType())]))),
    T.StructField("_corrupt_record", T.StringType()),
])
LABELME = T.StructType([
    T.StructField("imageWidth", T.IntegerType()), T.StructField("imageHeight", T.IntegerType()), T.StructField("imagePath", T.StringType()),
    T.StructField("shapes", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("points", T.ArrayType(NUMBERS))]))),
    T.StructField("_corrupt_record", T.StringType()),
])


def _json(spark: SparkSession, path: str | Sequence[str], schema: T.StructType) -> DataFrame:
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.json(path).withColumn("path", F.input_file_name())


def read_skeletons(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per group ``(path, image_path, width, height, group_id, group_type, points, edges)``.

    Missing or empty edges become the chain 0-1-2-...; files that do not parse come back as one row
    with ``_corrupt_record``.
    """
    raw = _json(spark, path, SKELETON)
    g = F.col("g")
    points = F.transform(g.points, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    exploded = raw.withColumn("g", F.explode_outer("groups"))
    return exploded.select(
        "path", "image_path", F.col("image_width").alias("width"), F.col("image_height").alias("height"), g.group_id.alias("group_id"), g.group_type.alias("group_type"),
        points.alias("points"), F.when(F.coalesce(F.size(g.edges), F.lit(0)) > 0, g.edges).otherwise(linear_chain(points)).alias("edges"),
        g.fork_origin_group.alias("fork_origin_group"), "_corrupt_record",
    )


def group_points(groups: DataFrame) -> DataFrame:
    return groups.select("path", "group_id", F.posexplode("points").alias("pos", "p")).select("path", "group_id", "pos", "p.x", "p.y")


def read_cut_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per cut line with the fields of its file; unreadable files stay as rows."""
    raw = _json(spark, path, CUT_FILE)
    names = [f.name for f in CUT.fields]
    return raw.withColumn("c", F.explode_outer("cut_lines")).select(
        "path", F.concat_ws("_", "tree_id", "view").alias("sample_id"), "tree_id", "view", "image_stage", "image_path", "reference_after_path", F.size("cut_lines").alias("n_cut_lines"),
        *[F.col(f"c.{n}").alias(n) for n in names], "_corrupt_record",
    )


def read_coco(spark: SparkSession, path: str | Sequence[str], pattern: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, polygons with at least three points, and rejects with a ``reason``.

    A run-length segmentation stays as text in ``rle``. Rejects are images whose name does not match, annotations
    of images that are not in their file, and files that do not parse.
    """
    raw = _json(spark, path, COCO)
    images = raw.select("path", F.explode("images").alias("i")).select("path", "i.*")
    broken = raw.filter("_corrupt_record IS NOT NULL").select("path", F.when(F.col("images").isNull(), "invalid_json").otherwise("invalid_fields").alias("reason"))
    good = images.filter(F.col("file_name").rlike(pattern))
    bad = images.filter(~F.coalesce(F.col("file_name").rlike(pattern), F.lit(False)))
    anns = raw.select("path", F.explode("annotations").alias("a")).select("path", F.col("a.id").alias("annotation_id"), "a.image_id", "a.segmentation")
    lost = anns.join(images.select("path", F.col("id").alias("image_id")), ["path", "image_id"], "left_anti")
    bad = (
        bad.withColumn("reason", F.lit("name_mismatch"))
        .unionByName(lost.select("path", F.col("image_id").alias("id"), F.lit("missing_image").alias("reason")).distinct(), allowMissingColumns=True)
        .unionByName(broken, allowMissingColumns=True)
    )
    joined = good.withColumnRenamed("id", "image_id").join(anns, ["path", "image_id"], "left")
    polygon = F.from_json("segmentation", T.ArrayType(NUMBERS))
    is_rle = F.col("segmentation").startswith("{")
    parts = joined.withColumn("flat", F.explode_outer(F.when(~is_rle, polygon)))
    corners = F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size("flat") / 2).cast("int") - 1, F.lit(0))), lambda i: F.struct(F.get("flat", i * 2).alias("x"), F.get("flat", i * 2 + 1).alias("y")))
    shaped = parts.select(
        "path", "image_id", "file_name", "width", "height", "annotation_id", F.when(F.size("flat") >= 6, corners).alias("polygon"), F.when(is_rle, F.col("segmentation")).alias("rle")
    )
    return good, shaped.filter("polygon IS NOT NULL OR rle IS NOT NULL"), bad


def read_labelme(spark: SparkSession, path: str | Sequence[str], labels: Sequence[str]) -> DataFrame:
    """Polygons of the wanted labels with at least three points, clamped to the image.

    Files that do not parse come back as one row with ``_corrupt_record``.
    """
    raw = _json(spark, path, LABELME)
    s = raw.select("path", "imagePath", "imageWidth", "imageHeight", F.posexplode("shapes").alias("shape_no", "s")).filter(F.lower(F.col("s.label")).isin([v.lower() for v in labels]))
    inside = F.transform("s.points", lambda p: F.struct(clamp(F.get(p, F.lit(0)), 0.0, F.col("imageWidth") - 1.0).alias("x"), clamp(F.get(p, F.lit(1)), 0.0, F.col("imageHeight") - 1.0).alias("y")))
    shaped = s.filter(F.size("s.points") >= 3).select("path", "imagePath", "shape_no", F.col("s.label").alias("label"), inside.alias("polygon"))
    broken = raw.filter("_corrupt_record IS NOT NULL").select("path", "imagePath", "_corrupt_record")
    return shaped.unionByName(broken, allowMissingColumns=True)


def read_feature_csv(spark: SparkSession, path: str | Sequence[str], key: str) -> DataFrame:
    """``(key, features MAP<STRING, DOUBLE>)`` of the numbers that are there; a byte mark is skipped."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    pairs = [x for c in raw.columns if c != key for x in (F.lit(c), F.col(c).try_cast("double"))]
    return raw.select(key, F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull() & ~F.isnan(v)).alias("features"))


def scan_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Path, size and SHA-256 of every file."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content").drop("content")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a table: the new one is written beside it, and takes its place by renaming when it is complete.

    A failed write leaves the old table as it was; if the new one can't take its place, the old one is put back.
    """
    spark = df.sparkSession
    fresh, old = (f"{path.rstrip('/')}.{uuid.uuid4().hex}.{tag}" for tag in ("new", "old"))
    writer = df.write.mode("errorifexists")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(fresh)
    except Exception:
        files.delete(hadoop(fresh), True)
        raise
    kept = files.exists(hadoop(path))
    if kept and not files.rename(hadoop(path), hadoop(old)):
        raise OSError(f"{path} can't be moved")
    if not files.rename(hadoop(fresh), hadoop(path)):
        if kept:
            files.rename(hadoop(old), hadoop(path))
        raise OSError(f"{fresh} can't take the place of {path}")
    if kept:
        files.delete(hadoop(old), True)
