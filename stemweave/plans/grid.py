"""Spatial joins as equi-joins on grid cells.

Points and edges meet in the cells of a grid that is laid over each key's plane. An edge is walked
at a spacing of one radius and enters the cells around its samples; a point sits in one cell. The
exact distance then decides, and the pairs are reduced on the side where they arise, before any
shuffle. A heavy cell only makes a heavy join partition, which adaptive execution splits; repeated
coordinates are merged before the join. Keys with few edges need no grid: they meet whole, once, and
every distance is taken where they meet.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.functions.geometry import norm, project_point
from stemweave.plans.durable import written

GROWTH = 8.0
MAX_ROUNDS = 30
WHOLE = 96  # edges of a key that meets whole
CROWD = 100_000  # and its points


# a cell is one number, column * 2^32 + row: cheap to hash, compare and make distinct
COLUMN = 1 << 32


def cell_key(x: Column, y: Column, size: float) -> Column:
    index = lambda v: F.floor(v / F.lit(size)).cast("long")
    return index(x) * COLUMN + index(y)


def edge_cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float, radius: float) -> Column:
    """Distinct cells that hold a point within ``radius`` of an edge, for ``size`` of at least four times that.

    Samples are half a cell apart at most, so what is near the edge is in the box of that half and the radius around one
    of them, and such a box touches only the cells of its four corners.
    """
    n = F.greatest(F.ceil(norm(x1 - x0, y1 - y0) / F.lit(size / 2)), F.lit(1)).cast("long")
    steps = F.when((x0 == x1) & (y0 == y1), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), n))
    reach_x, reach_y = (F.abs(d) / (2 * n) + F.lit(radius + size * 1e-3) for d in (x1 - x0, y1 - y0))

    def around(i: Column) -> Column:
        x, y = x0 + (x1 - x0) * i / n, y0 + (y1 - y0) * i / n
        return F.array(*[cell_key(x + a * reach_x, y + b * reach_y, size) for a in (-1, 1) for b in (-1, 1)])

    return F.array_distinct(F.flatten(F.transform(steps, around)))


def passed_cells(x0: Column, y0: Column, x1: Column, y1: Column, size: float) -> Column:
    """Distinct cells an edge passes, with a margin far above the tolerance of a crossing.

    Samples are half a cell apart, so every point of the edge is in the box of a quarter cell
    around one of them, and that box touches only the cells of its four corners.
    """
    n = F.greatest(F.ceil(norm(x1 - x0, y1 - y0) / F.lit(size / 2)), F.lit(1)).cast("long")
    reach = size / 4 + size * 1e-3
    corners = F.array(*[F.struct(F.lit(a * reach).alias("x"), F.lit(b * reach).alias("y")) for a in (-1, 1) for b in (-1, 1)])

    def around(i: Column) -> Column:
        return F.transform(corners, lambda d: cell_key(x0 + (x1 - x0) * i / n + d.x, y0 + (y1 - y0) * i / n + d.y, size))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(0).cast("long"), n), around)))


def as_edges(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Points as edges without length."""
    keep = [c for c in points.columns if c not in (x, y)]
    return points.select(*keep, F.col(x).cast("double").alias("x0"), F.col(y).cast("double").alias("y0"), F.col(x).cast("double").alias("x1"), F.col(y).cast("double").alias("y1"))


def within(points: DataFrame, edges: DataFrame, keys: Sequence[str], radius: float) -> DataFrame:
    """All (point, edge) pairs of a key not farther apart than ``radius``.

    ``points`` have ``px, py``, ``edges`` have ``x0, y0, x1, y1``; the result has the columns of
    both with ``distance, fx, fy, fraction``.
    """
    size = 4.5 * radius
    left = points.withColumn("_cell", cell_key(F.col("px"), F.col("py"), size))
    cells = edge_cells(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), size, radius)
    right = edges.withColumn("_cell", F.explode(cells))
    joined = left.join(right, [*keys, "_cell"])
    p = project_point(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return (
        joined.withColumn("_p", p)
        .filter(F.col("_p.distance") <= radius)
        .withColumns({"distance": F.col("_p.distance"), "fx": F.col("_p.x"), "fy": F.col("_p.y"), "fraction": F.col("_p.fraction")})
        .drop("_p", "_cell")
    )


def parted(points: DataFrame, edges: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """The points of keys that meet whole, and points and edges of the keys with too many of either, if there are any.

    Both are counted, so ``points`` and ``edges`` should be written tables.
    """
    few = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_p")).join(edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("_e")), list(keys))
    heavy = written(few.filter((F.col("_e") > WHOLE) | (F.col("_p") > CROWD)).select(*keys), "heavy")
    if not heavy.limit(1).count():
        return points, None
    return points.join(heavy, list(keys), "left_anti"), (points.join(heavy, list(keys), "left_semi"), edges.join(heavy, list(keys), "left_semi"))


def met(points: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All pairs of a key. Both sides are dealt to all shuffle partitions and none is broadcast: tables that are small in bytes still
    have many pairs to go through."""
    deal = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return points.repartition(deal, *keys).join(edges.repartition(deal, *keys).hint("merge"), list(keys))


def _closest(pairs: DataFrame, keys: Sequence[str], used: Sequence[str], bare: bool) -> DataFrame:
    if bare:
        return pairs.groupBy(*keys, "px", "py").agg(F.min("distance").alias("distance"))
    best = F.min(F.struct("distance", *used, "fx", "fy", "fraction")).alias("b")
    names = [n for n in ["distance", *used, "fx", "fy", "fraction"] if n not in keys]
    return pairs.groupBy(*keys, "px", "py").agg(best).select(*keys, "px", "py", *[F.col(f"b.{n}").alias(n) for n in names])


def _whole(spots: DataFrame, target: DataFrame, keys: Sequence[str], radius: float | None, used: Sequence[str], bare: bool) -> DataFrame:
    p = project_point(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    pairs = met(spots, target, keys).withColumn("_p", p)
    if bare and radius is None:  # a minimum leaves out nulls, and NaN is the largest
        return _closest(pairs.withColumn("distance", F.col("_p.distance")), keys, used, bare).filter("distance IS NOT NULL AND NOT isnan(distance)")
    near = F.col("_p.distance").isNotNull() & ~F.isnan("_p.distance")
    found = pairs.filter(near if radius is None else F.col("_p.distance") <= radius).withColumns({"distance": F.col("_p.distance"), "fx": F.col("_p.x"), "fy": F.col("_p.y"), "fraction": F.col("_p.fraction")})
    return _closest(found, keys, used, bare)


def _sides(points: DataFrame, edges: DataFrame, keys: Sequence[str], used: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    spots = points.select(*keys, "px", "py").filter("px IS NOT NULL AND py IS NOT NULL").distinct()
    return written(spots, "spots"), written(edges.select(*dict.fromkeys([*keys, *used, "x0", "y0", "x1", "y1"])), "edges")


def nearest_within(
    points: DataFrame, edges: DataFrame, keys: Sequence[str], radius: float, order: Sequence[str], carry: Sequence[str] = (), bare: bool = False
) -> DataFrame:
    """The nearest edge within ``radius`` per (keys, px, py); equal distances by ``order``.

    Result: keys, px, py, distance, ``order`` and ``carry`` columns of the edge, fx, fy, fraction; ``bare`` leaves only the distance,
    whose minimum needs no sorting of the pairs.
    """
    used = list(dict.fromkeys([*order, *carry]))
    spots, target = _sides(points, edges, keys, used)
    few, many = parted(spots, target, keys)
    found = _whole(few, target, keys, radius, used, bare)
    return found if many is None else found.unionByName(_closest(within(*many, keys, radius), keys, used, bare))


def nearest(
    points: DataFrame, edges: DataFrame, keys: Sequence[str], radius: float, order: Sequence[str], carry: Sequence[str] = ()
) -> DataFrame:
    """As ``nearest_within`` without a limit on the distance.

    ``radius`` is where the search starts. Points without a hit go to the next, eight times wider
    round; a hit within the radius of a round is the nearest one, so the answer is exact. Points
    whose key has no edge at all are left out. Rounds are written to the shared folder.
    """
    used = list(dict.fromkeys([*order, *carry]))
    return nearest_of(*_sides(points, edges, keys, used), keys, radius, used)


def nearest_of(spots: DataFrame, target: DataFrame, keys: Sequence[str], radius: float, used: Sequence[str] = (), bare: bool = False) -> DataFrame:
    """``nearest`` on written tables, ``spots`` without repeated rows; ``bare`` leaves only the distance."""
    few, many = parted(spots, target, keys)
    found = [_whole(few, target, keys, None, used, bare)]
    if many is None:
        return found[0]
    pending, target = (written(side, tag) for side, tag in zip(many, ("spots", "edges"), strict=True))
    for _ in range(MAX_ROUNDS):
        if not pending.limit(1).count():
            break
        hits = written(_closest(within(pending, target, keys, radius), keys, used, bare), "hits")
        found.append(hits)
        pending = written(pending.join(hits.select(*keys, "px", "py"), [*keys, "px", "py"], "left_anti"), "spots")
        radius *= GROWTH
    else:
        if pending.limit(1).count():
            raise RuntimeError("nearest: points left after the widest round")
    return reduce(DataFrame.unionByName, found)


def crossings(lines: DataFrame, edges: DataFrame, keys: Sequence[str], size: float) -> DataFrame:
    """Crossing points of lines ``(ax0, ay0, ax1, ay1)`` and edges ``(x0, y0, x1, y1)`` of a key.

    Keys with few edges meet whole. Of the others both enter the cells they pass; a pair that meets in several cells is
    kept in the cell that holds the crossing point. Both sides are counted and read again, so they are written first.
    """
    from stemweave.functions.geometry import intersect_segments

    def celled(df: DataFrame, names: Sequence[str]) -> DataFrame:
        return df.withColumn("_cell", F.explode(passed_cells(*[F.col(n) for n in names], size)))

    lines, edges = written(lines, "lines"), written(edges, "edges")
    few, many = parted(lines, edges, keys)
    hit = intersect_segments(*[F.col(n) for n in ("ax0", "ay0", "ax1", "ay1", "x0", "y0", "x1", "y1")])
    found = met(few, edges, keys).withColumn("hit", hit).filter("hit IS NOT NULL")
    if many is None:
        return found
    joined = celled(many[0], ["ax0", "ay0", "ax1", "ay1"]).join(celled(many[1], ["x0", "y0", "x1", "y1"]), [*keys, "_cell"]).withColumn("hit", hit)
    return found.unionByName(joined.filter(F.col("hit").isNotNull() & (cell_key(F.col("hit.x"), F.col("hit.y"), size) == F.col("_cell"))).drop("_cell"))
