"""Metrics between two sparse pixel tables ``(sample_id, x, y)``: overlap, lines, groups, coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.operators.graph import components, node_key
from stemweave.plans.durable import written
from stemweave.plans.grid import as_edges, nearest_of, nearest_within, within
from stemweave.plans.skew import attach_groups, exact_quantiles, value_counts

S = ["sample_id"]
PIXEL = ["sample_id", "x", "y"]


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _marked(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """One row per pixel of either side with its memberships; an aggregate, not a join."""
    p = pred.select(*PIXEL, F.lit(1).alias("p"), F.lit(0).alias("g"))
    g = gt.select(*PIXEL, F.lit(0).alias("p"), F.lit(1).alias("g"))
    return p.unionByName(g).groupBy(*PIXEL).agg(F.max("p").alias("p"), F.max("g").alias("g"))


def mask_metrics(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """IoU, Dice, precision and recall per sample."""
    counts = _marked(pred, gt).groupBy("sample_id").agg(
        F.count_if(F.col("p") + F.col("g") == 2).alias("tp"), F.count_if(F.col("p") > F.col("g")).alias("fp"), F.count_if(F.col("p") < F.col("g")).alias("fn")
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "sample_id", "tp", "fp", "fn", _ratio(tp, tp + fp + fn).alias("iou"), _ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall")
    )


def cldice(pred: DataFrame, gt: DataFrame, pred_line: DataFrame, gt_line: DataFrame) -> DataFrame:
    """Harmonic mean of how much of each centre line lies in the other mask."""
    def share(line: DataFrame, mask: DataFrame, name: str) -> DataFrame:
        both = _marked(line, mask).filter("p = 1")
        return both.groupBy("sample_id").agg(F.avg(F.col("g").cast("double")).alias(name))

    joined = share(pred_line, gt, "topology_precision").join(share(gt_line, pred, "topology_sensitivity"), "sample_id", "full").na.fill(0.0)
    a, b = F.col("topology_precision"), F.col("topology_sensitivity")
    return joined.withColumn("cldice", _ratio(2 * a * b, a + b))


def pixel_components(pixels: DataFrame) -> DataFrame:
    """Component of every pixel under eight-neighbourhood."""
    nodes = pixels.select("sample_id", "x", "y", node_key(F.col("x"), F.col("y")).alias("node_id")).distinct()
    ahead = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (0, 1), (1, 1), (1, -1))]))
    step = nodes.withColumn("d", ahead).select("sample_id", F.col("node_id").alias("src"), node_key(F.col("x") + F.col("d.dx"), F.col("y") + F.col("d.dy")).alias("dst"))
    edges = step.join(nodes.select("sample_id", F.col("node_id").alias("dst")), ["sample_id", "dst"]).select("sample_id", "src", "dst")
    return nodes.join(components(nodes, edges), ["sample_id", "node_id"]).select("sample_id", "x", "y", "component_id")


def floating_components(pixels: DataFrame) -> DataFrame:
    """Number of components per sample, and those besides the largest."""
    size = pixel_components(pixels).groupBy("sample_id", "component_id").agg(F.count(F.lit(1)).alias("n"))
    return size.groupBy("sample_id").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest")).withColumn("floating", F.col("components") - 1)


def _once(side: DataFrame) -> DataFrame:
    """The pixels of a side, written for all that read them."""
    return written(side.select(*PIXEL).distinct(), "pixels")


def line_distances(pred: DataFrame, gt: DataFrame, radius: float = 4.0) -> DataFrame:
    """Nearest distance of every pixel to the other side: (sample_id, side, distance), written once."""
    return _distances(_once(pred), _once(gt), radius)


def _distances(pred: DataFrame, gt: DataFrame, radius: float = 4.0) -> DataFrame:
    def one(a: DataFrame, b: DataFrame, side: str) -> DataFrame:
        spots = a.select("sample_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).filter("px IS NOT NULL AND py IS NOT NULL")
        return nearest_of(spots, as_edges(b), S, radius, bare=True).select("sample_id", F.lit(side).alias("side"), "distance")

    return written(one(pred, gt, "pred").unionByName(one(gt, pred, "gt")), "distances")


def _present(pred: DataFrame, gt: DataFrame) -> DataFrame:
    return _marked(pred, gt).groupBy("sample_id").agg((F.max("p") + F.max("g") == 2).alias("both"))


def line_metrics(pred: DataFrame, gt: DataFrame, tolerance: float, distances: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 within a tolerance and the Chamfer distance.

    A sample with only one side scores 0; its Chamfer distance is the longer side of its image if
    ``images(sample_id, width, height)`` has it, else null.
    """
    if distances is None:
        pred, gt = _once(pred), _once(gt)
    d = _distances(pred, gt) if distances is None else distances
    is_pred = F.col("side") == "pred"
    agg = d.groupBy("sample_id").agg(
        F.avg(F.when(is_pred, (F.col("distance") <= tolerance).cast("double"))).alias("precision"),
        F.avg(F.when(~is_pred, (F.col("distance") <= tolerance).cast("double"))).alias("recall"),
        F.avg(F.when(is_pred, F.col("distance"))).alias("_a"), F.avg(F.when(~is_pred, F.col("distance"))).alias("_b"),
    )
    joined = _present(pred, gt).join(agg, "sample_id", "left")
    p, r = F.coalesce("precision", F.lit(0.0)), F.coalesce("recall", F.lit(0.0))
    chamfer = (F.col("_a") + F.col("_b")) / 2
    if images is not None:
        joined = joined.join(images.select("sample_id", F.greatest("width", "height").cast("double").alias("_side")), "sample_id", "left")
        chamfer = F.when(F.col("both"), chamfer).otherwise(F.col("_side"))
    return joined.select("sample_id", p.alias("precision"), r.alias("recall"), (2 * p * r / (p + r + 1e-6)).alias("f1"), chamfer.alias("chamfer"))


TOLERANCES = (1.0, 3.0, 5.0, 8.0, 12.0, 16.0, 24.0)


def line_metrics_sweep(pred: DataFrame, gt: DataFrame, tolerances: Sequence[float] = TOLERANCES, distances: DataFrame | None = None) -> DataFrame:
    """Precision, recall and F1 at several tolerances and the trapezoid area over recall; 0 with one side only.

    The distances are found once; a sample's few (recall, precision) points are sorted in a row.
    """
    if distances is None:
        pred, gt = _once(pred), _once(gt)
    d = _distances(pred, gt) if distances is None else distances
    is_pred = F.col("side") == "pred"
    aggs = []
    for t in tolerances:
        within_t = (F.col("distance") <= t).cast("double")
        for side, name in ((is_pred, "p"), (~is_pred, "r")):
            aggs.append(F.coalesce(F.avg(F.when(side, within_t)), F.lit(0.0)).alias(f"{name}{t}".replace(".", "_")))
    wide = d.groupBy("sample_id").agg(*aggs)
    pts = F.array_sort(F.array(*[F.struct(F.col(f"r{t}".replace(".", "_")).alias("r"), F.col(f"p{t}".replace(".", "_")).alias("p")) for t in tolerances]))
    n = len(tolerances)
    area = F.aggregate(F.zip_with(F.slice(pts, 1, n - 1), F.slice(pts, 2, n - 1), lambda a, b: (b.r - a.r) * (a.p + b.p) * 0.5), F.lit(0.0), lambda acc, v: acc + v)
    cols = []
    for t in tolerances:
        p, r = F.col(f"p{t}".replace(".", "_")), F.col(f"r{t}".replace(".", "_"))
        cols += [p.alias(f"p_{int(t)}px"), r.alias(f"r_{int(t)}px"), (2 * p * r / (p + r + 1e-6)).alias(f"f1_{int(t)}px")]
    return wide.select("sample_id", *cols, area.alias("pr_auc"))


def hausdorff(pred: DataFrame, gt: DataFrame, percentile: float = 95.0, distances: DataFrame | None = None) -> DataFrame:
    """Percentile and maximum of the distances of both directions together; -1 with an empty side."""
    if distances is None:
        pred, gt = _once(pred), _once(gt)
    d = _distances(pred, gt) if distances is None else distances
    counts = value_counts(d, S, "distance")
    q = exact_quantiles(counts, S, "distance", [percentile / 100.0], "q", weight="_n").select("sample_id", "q")
    top = d.groupBy("sample_id").agg(F.max("distance").alias("m"))
    joined = _present(pred, gt).join(q, "sample_id", "left").join(top, "sample_id", "left")
    return joined.select("sample_id", F.when(F.col("both"), F.col("q")).otherwise(-1.0).alias(f"hausdorff_{int(percentile)}"), F.when(F.col("both"), F.col("m")).otherwise(-1.0).alias("hausdorff_max"))


def group_consistency(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Mean best precision of predicted groups, mean best recall of true groups, F1, self overlap.

    Pixel tables carry ``group_id``; only pairs of groups that share a pixel arise.
    """
    a = pred.select(*PIXEL, F.col("group_id").alias("pg")).distinct()
    b = gt.select(*PIXEL, F.col("group_id").alias("gg")).distinct()
    inter = a.join(b, PIXEL).groupBy("sample_id", "pg", "gg").agg(F.count(F.lit(1)).alias("n"))
    pa = a.groupBy("sample_id", "pg").agg(F.count(F.lit(1)).alias("area"))
    ga = b.groupBy("sample_id", "gg").agg(F.count(F.lit(1)).alias("area"))
    bp = pa.join(inter.groupBy("sample_id", "pg").agg(F.max("n").alias("n")), ["sample_id", "pg"], "left").groupBy("sample_id").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("area")).alias("group_precision"))
    br = ga.join(inter.groupBy("sample_id", "gg").agg(F.max("n").alias("n")), ["sample_id", "gg"], "left").groupBy("sample_id").agg(F.avg(F.coalesce("n", F.lit(0)) / F.col("area")).alias("group_recall"))
    own = a.groupBy(*PIXEL).agg(F.count(F.lit(1)).alias("k")).groupBy("sample_id").agg((F.count_if(F.col("k") > 1) / F.count(F.lit(1))).alias("group_overlap_ratio"))
    joined = bp.join(br, "sample_id", "full").join(own, "sample_id", "left").na.fill(0.0)
    p, r = F.col("group_precision"), F.col("group_recall")
    return joined.withColumn("group_f1", 2 * p * r / F.greatest(p + r, F.lit(1e-6)))


def group_topology(pred: DataFrame, gt: DataFrame, tolerance: float = 24.0) -> DataFrame:
    """Area-weighted share of every group that lies within ``tolerance`` of its best partner."""
    def matched(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
        spots = a.select("sample_id", "group_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py")).distinct()
        target = as_edges(b.select("sample_id", "x", "y", F.col("group_id").alias("other")).distinct())
        near = within(spots, target, S, tolerance).select("sample_id", "group_id", "px", "py", "other").distinct()
        best = near.groupBy("sample_id", "group_id", "other").agg(F.count(F.lit(1)).alias("n")).groupBy("sample_id", "group_id").agg(F.max("n").alias("n"))
        total = spots.groupBy("sample_id", "group_id").agg(F.count(F.lit(1)).alias("area"))
        return total.join(best, ["sample_id", "group_id"], "left").groupBy("sample_id").agg((F.sum(F.coalesce("n", F.lit(0))) / F.sum("area")).alias(name))

    joined = matched(pred, gt, "precision").join(matched(gt, pred, "recall"), "sample_id", "full").na.fill(0.0)
    p, r = F.col("precision"), F.col("recall")
    return joined.withColumn("f1", 2 * p * r / F.greatest(p + r, F.lit(1e-6)))


def coverage(line: DataFrame, edges: DataFrame, wide: float = 24.0, tight: float = 5.0, long: int = 64, need: float = 0.9) -> DataFrame:
    """Share of line pixels near any group at two distances, and long components covered too little.

    ``line(sample_id, component_label, x, y)``.
    """
    spots = line.select("sample_id", "component_label", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"))
    hit = nearest_within(spots, edges.select(*S, "x0", "y0", "x1", "y1").distinct(), S, wide, [], bare=True)
    seen = attach_groups(spots, hit, ["sample_id", "px", "py"], "left")
    per = seen.groupBy("sample_id", "component_label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("distance") <= wide).alias("w"), F.count_if(F.col("distance") <= tight).alias("t"))
    return per.groupBy("sample_id").agg(
        (F.sum("w") / F.sum("n")).alias("coverage_wide"), (F.sum("t") / F.sum("n")).alias("coverage_tight"),
        F.count_if((F.col("n") >= long) & (F.col("w") / F.col("n") < need)).alias("long_components_below"),
    )
