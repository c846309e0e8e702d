"""One-to-one matchings of many small and large problems at once, as joins and, where a task holds whole problems, in arrays.

As joins a problem is named by its keys; its pairs are rows (keys, left, right). All problems advance together, a problem
leaves the work when it is done, and no problem is ever collected into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemweave.plans.durable import scratch, written


def maximum_matching(pairs: DataFrame, keys: Sequence[str], start: DataFrame | None = None) -> DataFrame:
    """(keys, left, right) of a matching with the most pairs; ``start`` is a matching to begin with.

    Phases of augmenting paths: from every free left a tree of alternating pairs grows by layers, a right belongs to
    the first tree that reaches it (the smallest on ties), so paths of different trees never meet and all that end
    at a free right are exchanged at once. A phase that finds no such end proves the matching largest. Layers and phases
    are only as many as the longest open problem needs; problems without a free left or right take no part.
    """
    keys = list(keys)
    spark = pairs.sparkSession
    with scratch(spark) as tables:
        pairs = written(pairs.select(*keys, "left", "right").distinct(), "pairs")
        matched = written(_mutual(pairs, keys) if start is None else start.select(*keys, "left", "right"), "matched")
        while True:
            with scratch(spark) as phase:  # its layers go with it
                flips = _augment(pairs, matched, keys)
                if flips is None:
                    break
                kept = matched.join(flips.select(*keys, "left"), [*keys, "left"], "left_anti")
                matched = phase.keep(written(kept.unionByName(flips), "matched"))
        tables.keep(matched)
    return matched


def _mutual(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Every left asks its smallest right, every right takes the smallest left that asks."""
    asked = pairs.groupBy(*keys, "left").agg(F.min("right").alias("right"))
    return asked.groupBy(*keys, "right").agg(F.min("left").alias("left")).select(*keys, "left", "right")


def _augment(pairs: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame | None:
    """New pairs (keys, left, right) of all lefts on augmenting paths that share no vertex; None if there is none."""
    free = {side: pairs.select(*keys, side).distinct().join(matched.select(*keys, side), [*keys, side], "left_anti") for side in ("left", "right")}
    open_ = free["left"].select(*keys).distinct().join(free["right"].select(*keys).distinct(), keys, "left_semi")
    frontier = written(free["left"].join(open_, keys, "left_semi").withColumn("root", F.col("left")), "frontier")
    if frontier.isEmpty():
        return None
    ends_here = written(free["right"].join(frontier.select(*keys).distinct(), keys, "left_semi"), "free")
    edges = written(pairs.join(frontier.select(*keys).distinct(), keys, "left_semi"), "open")
    claimed: DataFrame | None = None
    ends: DataFrame | None = None
    layers = 0
    while True:
        reach = edges.join(frontier, [*keys, "left"])
        if claimed is not None:
            reach = reach.join(claimed.select(*keys, "right"), [*keys, "right"], "left_anti")
        best = reach.groupBy(*keys, "right").agg(F.min(F.struct("root", "left")).alias("by"))
        new = written(best.select(*keys, "right", F.col("by.root").alias("root"), F.col("by.left").alias("left")), "layer")
        if new.isEmpty():
            break
        layers += 1
        claimed = new if claimed is None else written(claimed.unionByName(new), "claimed")
        found = new.join(ends_here, [*keys, "right"], "left_semi").groupBy(*keys, "root").agg(F.min("right").alias("right"))
        ends = found if ends is None else written(ends.unionByName(found), "ends")
        going = new.join(found, [*keys, "root"], "left_anti").select(*keys, "right", "root")
        frontier = written(going.join(matched, [*keys, "right"]).select(*keys, "left", "root"), "frontier")
    if ends is None or ends.isEmpty():
        return None
    flips: DataFrame | None = None
    current = ends
    for _ in range(layers):
        step = written(current.join(claimed.select(*keys, "right", "left"), [*keys, "right"]), "step")
        flips = step if flips is None else flips.unionByName(step)
        back = step.filter("left <> root").select(*keys, "root", "left")
        current = back.join(matched, [*keys, "left"]).select(*keys, "root", "right")
    return written(flips.select(*keys, "left", "right"), "flips")


def grown(left: np.ndarray, right: np.ndarray, partner: np.ndarray, taker: np.ndarray) -> np.ndarray:
    """The right of every left (-1 without one) in a matching with the most pairs, for all problems whose pairs are in the arrays.

    ``partner`` is a matching to begin with and ``taker`` its inverse. The same phases as in ``maximum_matching``.
    """
    partner, taker, lefts = partner.copy(), taker.copy(), len(partner)
    if not len(left):
        return partner
    free = np.zeros(lefts, dtype=bool)
    free[left] = partner[left] < 0
    while True:
        root, by = np.full(lefts, -1), np.full(len(taker), -1)
        root[free] = np.flatnonzero(free)
        frontier, edges, ends = free, np.arange(len(left)), np.full(lefts, -1)
        while True:
            edges = edges[by[right[edges]] < 0]
            reach = edges[frontier[left[edges]]]
            if not len(reach):
                break
            best = np.full(len(taker), lefts * lefts)
            np.minimum.at(best, right[reach], root[left[reach]] * lefts + left[reach])
            new = np.unique(right[reach])
            by[new] = best[new] % lefts
            tree, open_ = best[new] // lefts, taker[new] < 0
            ends[tree[open_][::-1]] = new[open_][::-1]
            going = ends[tree] < 0
            frontier = np.zeros(lefts, dtype=bool)
            frontier[taker[new[going]]] = True
            root[taker[new[going]]] = tree[going]
        end = ends[ends >= 0]
        if not len(end):
            return partner
        free[ends >= 0] = False
        while len(end):
            here = by[end]
            before = partner[here]
            partner[here], taker[end] = end, here
            end = before[before >= 0]
