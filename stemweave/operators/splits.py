"""Leakage-safe splits, folds, samples and weights.

The tree is the independent unit: it is drawn, never its rows. Shuffles are seeded integer hashes,
so a split can be recomputed anywhere from (seed, tree).
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.functions.hashing import counting, portable_hash
from stemweave.plans.skew import attach_scalars, grouped_rank, running_totals


def shuffled_trees(df: DataFrame, key: str, seed: int, number: Column | None = None) -> DataFrame:
    """Distinct trees with their place 0, 1, ... in the seeded order and the number of trees.

    ``number`` is the non-negative integer hashed for a tree; the key itself if it is one.
    """
    trees = df.select(key).distinct().withColumn("_h", portable_hash(seed, F.col(key) if number is None else number))
    ranked = running_totals(
        trees, [], [F.col("_h"), F.col(key)], {"_rank": F.lit(1).cast("long")}, whole={"n_trees": "_rank"}
    )
    return ranked.select(key, (F.col("_rank") - 1).alias("place"), "n_trees")


def split_trees(df: DataFrame, key: str = "tree_id", seed: int = 0, ratios: tuple[float, float] = (0.70, 0.15)) -> DataFrame:
    """train/val/test by rounded shares, at least one tree each when there are three or more."""
    n = F.col("n_trees")
    first = F.rint(n * ratios[0])
    second = F.rint(n * ratios[1])
    train_end = F.when(n >= 3, F.least(n - 2, F.greatest(F.lit(1.0), first))).otherwise(first)
    val_end = F.when(n >= 3, F.least(n - 1, F.greatest(train_end + 1, train_end + second))).otherwise(train_end + second)
    place = F.col("place")
    return shuffled_trees(df, key, seed).select(
        key, F.when(place < train_end, "train").when(place < val_end, "val").otherwise("test").alias("split")
    )


def split_trees_floor(df: DataFrame, key: str = "tree_id", seed: int = 0, ratios: tuple[float, float] = (0.8, 0.1)) -> DataFrame:
    """train/val/test by truncated shares; the rest is test."""
    n, place = F.col("n_trees"), F.col("place")
    train_end = F.floor(n * ratios[0])
    val_end = train_end + F.floor(n * ratios[1])
    return shuffled_trees(df, key, seed).select(
        key, F.when(place < train_end, "train").when(place < val_end, "val").otherwise("test").alias("split")
    )


def split_counts(rows: DataFrame, splits: DataFrame, key: str = "tree_id", item: str = "sample_id") -> DataFrame:
    """Trees and items per split, and trees that fall into more than one split."""
    per_tree = rows.groupBy(key).agg(F.count_distinct(item).alias("items"))
    joined = per_tree.join(splits, key)
    clash = splits.groupBy(key).agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias("overlapping_trees"))
    counts = joined.groupBy("split").agg(F.count_distinct(key).alias("trees"), F.sum("items").alias("items"))
    return attach_scalars(counts, clash)


def folds(df: DataFrame, key: str = "tree_id", k: int = 5, seed: int = 0) -> DataFrame:
    """k contiguous folds of the seeded order; the first ``n % k`` folds hold one tree more."""
    n, place = F.col("n_trees"), F.col("place")
    small = F.floor(n / k)
    extra = n % k
    head = extra * (small + 1)
    fold = F.when(place < head, F.floor(place / (small + 1))).otherwise(
        extra + F.floor((place - head) / F.greatest(small, F.lit(1)))
    )
    return shuffled_trees(df, key, seed).select(key, fold.cast("long").alias("fold"))


def nested_folds(df: DataFrame, key: str = "tree_id", k: int = 5, seed: int = 0) -> DataFrame:
    """Role of every tree in every outer fold: test, val (the next fold) or train."""
    outer = F.explode(counting(k))
    role = (
        F.when(F.col("fold") == F.col("outer_fold"), "test")
        .when(F.col("fold") == (F.col("outer_fold") + 1) % k, "val")
        .otherwise("train")
    )
    return folds(df, key, k, seed).select(key, "fold", outer.alias("outer_fold")).withColumn("role", role)


def _fill_order(k: int):
    """For every tree size, from the largest: which folds take its trees, in which order.

    Giving m trees of one size s to the least loaded of k folds is a merge of k arithmetic
    sequences load + i*s, so it is written as at most k+1 runs, each a cycle over a fixed list of
    folds. One row per distinct size comes in: their number is below the square root of twice the
    number of rows.
    """

    def fill(sizes: pd.DataFrame) -> pd.DataFrame:
        load = [0] * k
        out = []
        for size, trees in sizes.sort_values("size", ascending=False)[["size", "trees"]].itertuples(index=False):
            size, trees = int(size), int(trees)
            lap = [v // size for v in load]
            start, taken = 0, [0] * k
            laps = sorted(set(lap))
            for i, lap_from in enumerate(laps):
                if start >= trees:
                    break
                active = sorted((f for f in range(k) if lap[f] <= lap_from), key=lambda f: (load[f] % size, f))
                span = (laps[i + 1] - lap_from) * len(active) if i + 1 < len(laps) else trees - start
                stop = min(trees, start + span)
                out.append((size, start, stop, active))
                for place, f in enumerate(active):
                    taken[f] += max(0, -(-(stop - start - place) // len(active)))
                start = stop
            load = [v + c * size for v, c in zip(load, taken)]
        return pd.DataFrame(out, columns=["size", "first", "last", "cycle"])

    return fill


def balanced_folds(df: DataFrame, key: str = "tree_id", k: int = 5, item: str | None = None) -> DataFrame:
    """Biggest tree first into the fold with the fewest items, lowest fold on ties."""
    count = F.count(F.lit(1)) if item is None else F.count_distinct(item)
    trees = df.groupBy(key).agg(count.alias("size"))
    histogram = trees.groupBy("size").agg(F.count(F.lit(1)).alias("trees"))
    runs = histogram.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        lambda pdf: _fill_order(k)(pdf), "size long, first long, last long, cycle array<int>"
    )
    ranked = grouped_rank(trees, ["size"], [F.col(key)], "_rank").withColumn("_place", F.col("_rank") - 1)
    placed = ranked.join(runs, "size").filter((F.col("_place") >= F.col("first")) & (F.col("_place") < F.col("last")))
    turn = ((F.col("_place") - F.col("first")) % F.size("cycle")).cast("int")
    return placed.select(key, "size", F.get("cycle", turn).cast("long").alias("fold"))


def group_folds(df: DataFrame, key: str = "tree_id", k: int = 5) -> DataFrame:
    """Leave one tree out below ten trees, balanced folds from ten on."""
    few = [r[0] for r in df.select(key).distinct().sort(key).limit(10).collect()]
    if len(few) < 2:
        raise ValueError("at least two trees are required")
    if len(few) < 10:
        number = F.array_position(F.array(*[F.lit(v) for v in few]), F.col(key)) - 1
        return df.select(key).distinct().withColumn("fold", number.cast("long"))
    return balanced_folds(df, key, k).select(key, "fold")


def systematic_split(df: DataFrame, key: str, test_ratio: float) -> DataFrame:
    """Every n-th name of the sorted list is test, n = max(round(1/ratio), 2)."""
    every = max(int(round(1.0 / max(test_ratio, 1e-6))), 2)
    ranked = grouped_rank(df.select(key).distinct(), [], [F.col(key)], "_rank")
    return ranked.select(key, F.when((F.col("_rank") - 1) % every == 0, "test").otherwise("train").alias("split"))


def sample_one_per_group(df: DataFrame, n: int, seed: int, key: str = "tree_id", item: str = "sample_id") -> DataFrame:
    """n trees by seeded order, then one seeded view of each."""
    trees = df.select(key).distinct().sort(portable_hash(seed, F.col(key)), F.col(key)).limit(n)
    place = F.struct(portable_hash(seed, F.col(key), F.col(item)).alias("h"), F.col(item))
    views = df.join(F.broadcast(trees), key).groupBy(key).agg(F.min(place).alias("pick"))
    return views.select(key, F.col(f"pick.{item}").alias(item))


def downsample(df: DataFrame, ratio: float, order: Sequence[Column], label: str = "label") -> DataFrame:
    """All positives and at most ``ratio`` negatives per positive, the first of ``order``.

    Both are counted first: negatives are only ranked if there are too many of them.
    """
    positives, many = df.agg(F.sum(label), F.count_if(F.col(label) == 0)).first()
    if positives is not None and many <= positives * ratio:
        return df.filter(F.col(label) == 1).unionByName(df.filter(F.col(label) == 0))
    limit = df.agg((F.sum(label) * ratio).alias("_limit"))
    negatives = grouped_rank(df.filter(F.col(label) == 0), [], order, "_rank")
    kept = attach_scalars(negatives, limit).filter(F.col("_rank") <= F.col("_limit")).select(*df.columns)
    return df.filter(F.col(label) == 1).unionByName(kept)


def class_weights(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Balanced weights n/(2 n_c) and the positive weight neg/pos."""
    c = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("positives"))
    n, p = F.col("n"), F.col("positives")
    return c.select(
        *by, "n", "positives",
        (n / F.greatest(2 * p, F.lit(1))).alias("weight_positive"),
        (n / F.greatest(2 * (n - p), F.lit(1))).alias("weight_negative"),
        ((n - p) / F.greatest(p, F.lit(1))).alias("pos_weight"),
    )


def with_class_weights(df: DataFrame, label: str = "label", name: str = "weight") -> DataFrame:
    weights = class_weights(df, (), label)
    return (
        attach_scalars(df, weights.select("weight_positive", "weight_negative"))
        .withColumn(name, F.when(F.col(label) == 1, F.col("weight_positive")).otherwise(F.col("weight_negative")))
        .drop("weight_positive", "weight_negative")
    )


def audit_folds(roles: DataFrame, key: str = "tree_id") -> DataFrame:
    """Per outer fold: trees per role and trees that hold more than one role."""
    per_tree = roles.groupBy("outer_fold", key).agg(F.count_distinct("role").alias("roles"), F.min("role").alias("role"))
    return per_tree.groupBy("outer_fold").agg(
        F.count_if(F.col("role") == "train").alias("train_trees"),
        F.count_if(F.col("role") == "val").alias("val_trees"),
        F.count_if(F.col("role") == "test").alias("test_trees"),
        F.count_if(F.col("roles") > 1).alias("leaking_trees"),
    )


def audit_coverage(oof: DataFrame, expected: DataFrame, key: Sequence[str], model: str = "model") -> DataFrame:
    """Per model: duplicate, missing and extra keys against the expected key set."""
    rows = oof.groupBy(model, *key).agg(F.count(F.lit(1)).alias("rows"))
    known = expected.select(*key).distinct().withColumn("_known", F.lit(True))
    total = known.agg(F.count(F.lit(1)).alias("expected_keys"))
    found = rows.join(known, list(key), "left").groupBy(model).agg(
        F.count_if(F.col("rows") > 1).alias("duplicate_keys"),
        F.count_if(F.col("_known").isNotNull()).alias("matched"),
        F.count_if(F.col("_known").isNull()).alias("extra_keys"),
    )
    return attach_scalars(found, total).select(
        model, "expected_keys", (F.col("expected_keys") - F.col("matched")).alias("missing_keys"), "extra_keys", "duplicate_keys"
    )


def audit_feature_list(columns: Sequence[str], forbidden: Sequence[str], expected: int) -> list[str]:
    """Reasons why a feature list may not be trained on; empty when it may."""
    reasons = [f"forbidden:{c}" for c in columns if c in set(forbidden)]
    if len(columns) != expected:
        reasons.append(f"count:{len(columns)}")
    if len(set(columns)) != len(columns):
        reasons.append("duplicate")
    return reasons
