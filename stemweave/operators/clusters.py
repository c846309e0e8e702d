"""Clusters of contacts and junctions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.operators.graph import components, node_key
from stemweave.plans.grid import nearest_within
from stemweave.functions.geometry import norm

S = ["sample_id"]


def contact_count(points: DataFrame, edges: DataFrame, tolerance: float, ignored: DataFrame | None = None) -> DataFrame:
    """Contact clusters of every child with its parent.

    ``points(sample_id, group_id, parent_id, x, y)`` are the child's densified pixels, ``edges``
    carry ``parent_id``. Pixels within ``tolerance`` cluster under eight-neighbourhood; a cluster
    within max(24, tolerance) of a declared crossing ``ignored(sample_id, group_id, x, y)`` does not
    count.
    """
    keys = ["sample_id", "parent_id"]
    spots = points.select("sample_id", "parent_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    touch = nearest_within(spots, edges, keys, tolerance, []).select(*keys, F.col("px").alias("x"), F.col("py").alias("y"))
    contact = points.select("sample_id", "group_id", "parent_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).join(touch, [*keys, "x", "y"], "left_semi")
    own = ["sample_id", "group_id"]
    nodes = contact.select(*own, "x", "y", node_key(F.col("x"), F.col("y")).alias("node_id")).distinct()
    ahead = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))]))
    step = nodes.withColumn("d", ahead).select(*own, F.col("node_id").alias("src"), node_key(F.col("x") + F.col("d.dx"), F.col("y") + F.col("d.dy")).alias("dst"))
    links = step.join(nodes.select(*own, F.col("node_id").alias("dst")), [*own, "dst"]).select(*own, "src", "dst")
    labelled = nodes.join(components(nodes, links, own), [*own, "node_id"])
    if ignored is not None:
        limit = max(24.0, tolerance)
        at = ignored.select(*own, F.col("x").alias("ix"), F.col("y").alias("iy"))
        bad = labelled.join(at, own).filter(norm(F.col("x") - F.col("ix"), F.col("y") - F.col("iy")) <= limit).select(*own, "component_id").distinct()
        labelled = labelled.join(bad, [*own, "component_id"], "left_anti")
    return labelled.groupBy(*own).agg(F.count_distinct("component_id").alias("contacts"))


def cluster_junctions(junctions: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """Clusters of junctions that are close or linked by a short path without a junction.

    ``junctions(sample_id, node_id, x, y, degree, is_trunk)``, ``segments(sample_id, start_node, end_node, length_px)``
    between junctions, traced through what lies between them. A short path links two nodes of degree three of which
    none is on the trunk. Cells are small enough that all junctions of one are close to each other; each is
    tied to its cell's first node and to its nearest junction in every cell around, which connects
    the same nodes as all close pairs would.
    """
    size = radius / (2**0.5)
    cell = lambda v: F.floor(F.col(v) / size).cast("long")
    placed = junctions.select("sample_id", "node_id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    head = placed.groupBy("sample_id", "cx", "cy").agg(F.min("node_id").alias("src"))
    inside = placed.join(head, ["sample_id", "cx", "cy"]).filter("src <> node_id").select("sample_id", "src", F.col("node_id").alias("dst"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-2, 3) for b in range(-2, 3) if (a, b) > (0, 0)]))
    asked = placed.withColumn("d", around).select("sample_id", F.col("node_id").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("cx") + F.col("d.a")).alias("cx"), (F.col("cy") + F.col("d.b")).alias("cy"))
    far = norm((F.col("x") - F.col("sx")).cast("double"), (F.col("y") - F.col("sy")).cast("double"))
    across = asked.join(placed, ["sample_id", "cx", "cy"]).withColumn("d", far).filter(F.col("d") <= radius).groupBy("sample_id", "src", "cx", "cy").agg(F.min(F.struct("d", "node_id")).alias("b")).select("sample_id", "src", F.col("b.node_id").alias("dst"))
    three = junctions.filter("degree = 3 AND NOT is_trunk").select("sample_id", "node_id")
    short = segments.filter(F.col("length_px") <= max(4 * radius, 48.0)).select("sample_id", F.col("start_node").alias("src"), F.col("end_node").alias("dst"))
    for end in ("src", "dst"):
        short = short.join(three.withColumnRenamed("node_id", end), ["sample_id", end], "left_semi")
    edges = inside.unionByName(across).unionByName(short.select("sample_id", "src", "dst")).filter("src <> dst").select("sample_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    return components(junctions, edges).withColumnRenamed("component_id", "cluster_id")
