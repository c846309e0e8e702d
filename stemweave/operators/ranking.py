"""Ranking metrics per view, averaged over trees.

Rows are predictions ``(model, tree_id, sample_id, segment_id, label, score)``. A view is ranked by
score descending, then ``segment_id``; the reference order of ties is unspecified, this one is total.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.operators.matching import grown, maximum_matching
from stemweave.plans.durable import scratch, written
from stemweave.plans.skew import attach_groups, grouped_rank
from stemweave.plans.slices import fit_whole, in_tasks

VIEW, S = ["model", "tree_id", "sample_id"], ["sample_id"]
#: Predictions of a sample whose views are matched in one task.
WHOLE = 20_000


def _place() -> Column:
    return F.struct((-F.col("score")).alias("falling"), F.col("segment_id").alias("tie"))


def view_ranks(df: DataFrame, keys: Sequence[str] = VIEW) -> DataFrame:
    """Per view: rows ``n``, positives ``p`` and the rank of the first positive (null without one).

    The best positive is an aggregate over the positives; the rank is one plus the number of rows
    placed before it, counted together with n and p, so a view is never sorted in one task and the
    source is read twice in all.
    """
    placed = df.select(*keys, "label", _place().alias("place"))
    best = placed.filter(F.col("label") == 1).groupBy(*keys).agg(F.min("place").alias("best"))
    before = F.count_if(F.col("place") < F.col("best"))
    return (
        attach_groups(placed, best, keys, "left")
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("p"), before.alias("_before"))
        .select(*keys, "n", "p", F.when(F.col("p") > 0, F.col("_before") + 1).alias("first_rank"))
    )


def success_columns(ks: Sequence[int]) -> list[Column]:
    return [(F.col("first_rank") <= k).cast("double").alias(f"success_at_{k}") for k in ks]


def tree_macro(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean over views within a tree, then mean over trees."""
    per_tree = df.groupBy(*by, "tree_id").agg(*[F.avg(c).alias(c) for c in columns])
    return per_tree.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns], F.count(F.lit(1)).alias("trees"))


def ranking_metrics(views: DataFrame, ks: Sequence[int] = (1, 3)) -> DataFrame:
    """Success@k and MRR per model from ``view_ranks``, with views that have and lack a positive."""
    scored = views.filter("p > 0").select(*VIEW, *success_columns(ks), (1 / F.col("first_rank")).alias("mrr"))
    macro = tree_macro(scored, [f"success_at_{k}" for k in ks] + ["mrr"])
    counts = views.groupBy("model").agg(F.count_if(F.col("p") > 0).alias("positive_views"), F.count_if(F.col("p") == 0).alias("zero_positive_views"))
    return macro.join(counts, "model")


def random_success(n: Column, p: Column, k: int) -> Column:
    """Chance that at least one of ``p`` positives is among ``k`` of ``n`` in random order."""
    missed = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)),
        F.lit(1.0),
        lambda acc, i: acc * F.greatest(n - p - i, F.lit(0)) / F.greatest(n - i, F.lit(1)),
    )
    return F.when((p <= 0) | (n <= 0), 0.0).when((k >= n) | (k > n - p), 1.0).otherwise(1.0 - missed)


def random_baseline(views: DataFrame, ks: Sequence[int] = (1, 3)) -> DataFrame:
    """Analytic success@k and (p+1)/(n+1) of a random order from ``view_ranks``, averaged like the models."""
    n, p = F.col("n"), F.col("p")
    scored = views.filter("p > 0").select(
        *VIEW,
        *[random_success(n, p, k).alias(f"random_success_at_{k}") for k in ks],
        ((p + 1.0) / (n + 1.0)).alias("random_mrr_reference"),
    )
    return tree_macro(scored, [f"random_success_at_{k}" for k in ks] + ["random_mrr_reference"]).drop("trees")


def ranking_against_random(df: DataFrame, ks: Sequence[int] = (1, 3)) -> DataFrame:
    """Both side by side; the table of views is written once and read for each part."""
    views = written(view_ranks(df), "views")
    return ranking_metrics(views, ks).join(random_baseline(views, ks), "model")


def ranked_views(df: DataFrame) -> DataFrame:
    """Every row with its rank in the view."""
    return grouped_rank(df, VIEW, [F.col("score").desc(), F.col("segment_id")])


def budget_metrics(df: DataFrame) -> DataFrame:
    """Coverage and any-hit among the top B of a view, B being the view's number of positives."""
    budgets = df.groupBy(*VIEW).agg(F.sum("label").alias("budget")).filter("budget > 0")
    ranked = ranked_views(df.select(*VIEW, "segment_id", "label", "score"))
    hits = (
        attach_groups(ranked.filter("label = 1"), budgets, VIEW)
        .groupBy(*VIEW, "budget")
        .agg(F.count_if(F.col("rank") <= F.col("budget")).alias("hits"))
        .select(
            *VIEW,
            (F.col("hits") / F.col("budget")).alias("budget_coverage"),
            (F.col("hits") > 0).cast("double").alias("budget_any_hit"),
        )
    )
    return tree_macro(hits, ["budget_coverage", "budget_any_hit"])


def exact_recommendations(df: DataFrame, budgets: Sequence[int] = (1, 3)) -> DataFrame:
    """Exact hit and recall at fixed budgets and at the truth budget, per view."""
    truths = df.groupBy(*VIEW).agg(F.sum("label").alias("truth_cuts")).filter("truth_cuts > 0")
    ranked = ranked_views(df.select(*VIEW, "segment_id", "label", "score")).filter("label = 1")
    inside = lambda b: F.count_if(F.col("rank") <= b)
    counted = (
        attach_groups(ranked, truths, VIEW)
        .groupBy(*VIEW, "truth_cuts")
        .agg(*[inside(b).alias(f"_h{b}") for b in budgets], inside(F.col("truth_cuts")).alias("_hb"))
    )
    return counted.select(
        *VIEW,
        "truth_cuts",
        *[(F.col(f"_h{b}") > 0).cast("double").alias(f"exact_hit_at_{b}") for b in budgets],
        *[(F.col(f"_h{b}") / F.col("truth_cuts")).alias(f"exact_recall_at_{b}") for b in budgets],
        (F.col("_hb") / F.col("truth_cuts")).alias("budget_exact_coverage"),
        (F.col("_hb") > 0).cast("double").alias("budget_exact_any"),
    )


def recommendation_metrics(df: DataFrame, adjacency: DataFrame, budgets: Sequence[int] = (1, 3)) -> DataFrame:
    """Hits and recall per view at fixed budgets and at the truth budget, exact and with one hop of slack.

    ``adjacency(sample_id, src, dst)`` lists adjacent segments in both directions. With a hop of slack the picked
    segments are matched one to one with true ones that are the same or adjacent, as many as can be; a budget of a view
    is a matching problem of its own.

    Samples that fit a task meet their adjacent segments there, once; bigger ones and those with missing values or with a segment that
    stands twice in a view are ranked and matched by rounds of joins.
    """
    names = [*map(str, budgets), "b"]
    counts = [f"{kind}_{n}" for kind in ("exact", "hop1") for n in names]
    rows = df.select(*VIEW, "segment_id", "label", "score")
    null = reduce(Column.__or__, [F.col(k).isNull() for k in rows.columns if k != "sample_id"])
    with scratch(df.sparkSession) as tables:
        whole, others = fit_whole(rows, S, WHOLE, null | F.isnan(F.col("score").cast("double")) | ~F.col("label").isin(0, 1))
        ours = whole.select(*VIEW, F.lit(0).alias("kind"), "segment_id", F.lit(None).cast(df.schema["segment_id"].dataType).alias("dst"), F.col("label").cast("long"), "score")
        pairs = adjacency.filter(F.col("sample_id").isNotNull()).select(
            *[F.lit(None).cast(df.schema[k].dataType).alias(k) for k in VIEW[:2]], "sample_id", F.lit(1).alias("kind"), F.col("src").alias("segment_id"), "dst", F.lit(None).cast("long").alias("label"), F.lit(None).cast(df.schema["score"].dataType).alias("score"))
        schema = ", ".join([f"{k} {t}" for k, t in rows.select(*VIEW).dtypes] + ["odd boolean", "truth_cuts long"] + [f"{c} long" for c in counts])
        order = [F.col("kind"), *[F.col(k) for k in VIEW[:2]], F.col("score").desc(), F.col("segment_id")]
        solved = tables.keep(written(in_tasks(ours.unionByName(pairs), S, order, _local_recommendations(list(budgets), counts), schema), "wide"))
        wide, odd = solved.filter("not odd").drop("odd"), solved.filter("odd").select(*S)
        if odd.limit(1).count():
            twice = rows.join(odd, S, "left_semi")
            others = twice if others is None else others.unionByName(twice)
        if others is not None:
            wide = wide.unionByName(tables.keep(written(_recommendation_rounds(written(others, "others"), adjacency, budgets), "wide")))
    share = lambda kind, n: F.col(f"{kind}_{n}") / F.col("truth_cuts")
    any_ = lambda kind, n: (F.col(f"{kind}_{n}") > 0).cast("double")
    return wide.select(
        *VIEW, "truth_cuts",
        *[any_(kind, b).alias(f"{kind}_hit_at_{b}") for b in budgets for kind in ("exact", "hop1")],
        *[share(kind, b).alias(f"{kind}_recall_at_{b}") for b in budgets for kind in ("exact", "hop1")],
        *[share(kind, "b").alias(f"budget_{kind}_coverage") for kind in ("exact", "hop1")],
        *[any_(kind, "b").alias(f"budget_{kind}_any") for kind in ("exact", "hop1")],
    )


def _recommendation_rounds(df: DataFrame, adjacency: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Counts of hits per view by joins, for samples of any size."""
    truths = df.groupBy(*VIEW).agg(F.sum("label").alias("truth_cuts")).filter("truth_cuts > 0")
    # only views with a true segment are ranked
    ranked = ranked_views(attach_groups(df.select(*VIEW, "segment_id", "label", "score"), truths, VIEW))
    names = [*map(str, budgets), "b"]
    slots = F.array(*[F.struct(F.lit(n).alias("slot"), size.cast("long").alias("size")) for n, size in zip(names, [*map(F.lit, budgets), F.col("truth_cuts")], strict=True)])
    picked = ranked.withColumn("s", F.explode(slots)).filter("rank <= s.size").select(*VIEW, "truth_cuts", "s.slot", F.col("segment_id").alias("left"), "label")
    picked = written(picked, "picked")
    true = written(df.filter("label = 1").select(*VIEW, F.col("segment_id").alias("right")), "true")
    problem = [*VIEW, "slot"]
    exact = picked.filter("label = 1").select(*problem, "left", F.col("left").alias("right"))
    near = picked.select(*problem, "left").join(adjacency.select("sample_id", F.col("src").alias("left"), F.col("dst").alias("right")), ["sample_id", "left"])
    near = near.join(true, [*VIEW, "right"]).select(*problem, "left", "right")
    matched = maximum_matching(exact.unionByName(near), problem, exact)
    counts = picked.groupBy(*problem, "truth_cuts").agg(F.sum("label").alias("exact"))
    hops = matched.groupBy(*problem).agg(F.count(F.lit(1)).alias("hop1"))
    both = counts.join(hops, problem, "left").withColumn("hop1", F.coalesce("hop1", F.lit(0)))
    at = lambda kind, name: F.sum(F.when(F.col("slot") == name, F.col(kind)).otherwise(0))
    return both.groupBy(*VIEW, "truth_cuts").agg(*[at(kind, n).alias(f"{kind}_{n}") for kind in ("exact", "hop1") for n in names])


def _local_recommendations(budgets: list[int], counts: list[str]):
    """For ``in_tasks``: counts of hits per view of whole samples, whose rows come as predictions (kind 0) in the order of their
    views and ranks and then as adjacent segments (kind 1, from ``segment_id`` to ``dst``)."""

    def solve(table: pa.Table, bounds: np.ndarray) -> pa.Table:
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        kind = table.column("kind").to_numpy()
        rows, links = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        ours, near = table.take(pa.array(rows)), table.take(pa.array(links))
        group, of = group[rows], group[links]
        if not len(rows):
            return pa.Table.from_arrays([*[ours.column(k) for k in VIEW], pa.array([], pa.bool_()), *[pa.array([], pa.int64())] * (1 + len(counts))], names=[*VIEW, "odd", "truth_cuts", *counts])
        differ = [pc.not_equal(ours.column(k).slice(1), ours.column(k).slice(0, len(ours) - 1)).to_numpy() for k in VIEW]
        first = np.concatenate([[0], np.flatnonzero(np.logical_or.reduce(differ)) + 1])
        view = np.repeat(np.arange(len(first)), np.diff([*first, len(rows)]))
        rank = np.arange(len(rows)) - first[view] + 1
        label = ours.column("label").to_numpy()
        truths = np.add.reduceat(label, first)
        # segments as numbers
        named = pa.concat_arrays([ours.column("segment_id").combine_chunks(), near.column("segment_id").combine_chunks(), near.column("dst").combine_chunks()]).dictionary_encode()
        code, src, dst = np.split(named.indices.fill_null(-1).to_numpy().astype(np.int64), [len(rows), len(rows) + len(links)])
        n = len(named.dictionary) + 1
        here = np.argsort(view * n + code, kind="stable")
        known = (view * n + code)[here]
        twice = np.zeros(int(group[-1]) + 1, dtype=bool)
        twice[group[here[1:][known[1:] == known[:-1]]]] = True
        # every view of the sample takes an adjacent pair if it lists both, the second one as true
        begins = np.append(np.flatnonzero(np.diff(group[first], prepend=-1)), len(first))
        spans = np.full((int(group[-1]) + 1, 2), 0)
        spans[group[first[begins[:-1]]]] = np.stack([begins[:-1], begins[1:]], axis=1)
        inside = (of <= group[-1]) & (src >= 0) & (dst >= 0)
        of, src, dst = of[inside], src[inside], dst[inside]
        many = spans[of, 1] - spans[of, 0]
        at = np.repeat(np.arange(len(of)), many)
        its = spans[of[at], 0] + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)

        def place(names: np.ndarray) -> np.ndarray:
            wanted = its * n + names[at]
            found = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
            return np.where(known[found] == wanted, here[found], -1)

        left, right = place(src), place(dst)
        fine = (left >= 0) & (right >= 0)
        left, right = left[fine], right[fine]
        fine = label[right] == 1
        true = np.flatnonzero(label == 1)
        left, right = np.concatenate([left[fine], true]), np.concatenate([right[fine], true])
        # a budget of a view is a problem of its own; what is picked and true begins with itself
        sizes = [np.full(len(first), b) for b in budgets] + [truths]
        exact, hop1 = [], []
        for size in sizes:
            picked = rank <= size[view]
            partner = np.where(picked & (label == 1), np.arange(len(rows)), -1)
            idle = np.zeros((2, len(first)), dtype=bool)  # views with a free left and those with a free right
            idle[0, view[picked & (label == 0)]] = True
            idle[1, view[~picked & (label == 1)]] = True
            use = picked[left] & (idle[0] & idle[1])[view[left]]
            exact.append(np.bincount(view[partner >= 0], minlength=len(first)))
            hop1.append(np.bincount(view[grown(left[use], right[use], partner, partner) >= 0], minlength=len(first)))
        keep = np.flatnonzero((truths > 0) & ~twice[group[first]])
        bad = first[begins[:-1]][twice[group[first[begins[:-1]]]]]
        out = pa.array(np.concatenate([first[keep], bad]))
        fill = lambda v: pa.array(np.concatenate([v[keep], np.zeros(len(bad), dtype=np.int64)]).astype(np.int64))
        return pa.Table.from_arrays([*[ours.column(k).take(out) for k in VIEW], pa.array(np.arange(len(out)) >= len(keep)), fill(truths), *[fill(v) for v in exact + hop1]], names=[*VIEW, "odd", "truth_cuts", *counts])

    return solve


def recommendation_summary(views: DataFrame) -> DataFrame:
    """Per model: mean over views within a tree, then over trees, and (``pooled_``) the mean over all views."""
    measures = [c for c in views.columns if c.startswith(("exact_", "hop1_", "budget_"))]
    views = written(views, "views")
    pooled = views.groupBy("model").agg(*[F.avg(m).alias(f"pooled_{m}") for m in measures], F.count(F.lit(1)).alias("positive_views"))
    return tree_macro(views, measures).join(pooled, "model")


def pick_cases(df: DataFrame, k: int) -> DataFrame:
    """Per model the k best true positives, the k best false positives and the k lowest misses.

    ``row_number() <= k`` is applied by Spark before the shuffle as well, so a case sends at most
    k rows per task.
    """
    from pyspark.sql import Window

    kind = (
        F.when((F.col("label") == 1) & (F.col("prediction") == 1), "success")
        .when((F.col("label") == 0) & (F.col("prediction") == 1), "false_positive")
        .when((F.col("label") == 1) & (F.col("prediction") == 0), "missed")
    )
    signed = F.when(F.col("case_kind") == "missed", F.col("score")).otherwise(-F.col("score"))
    window = Window.partitionBy("model", "case_kind").orderBy("_sort", "sample_id", "segment_id")
    return (
        df.withColumn("case_kind", kind)
        .filter(F.col("case_kind").isNotNull())
        .withColumn("_sort", signed)
        .withColumn("case_rank", F.row_number().over(window))
        .filter(F.col("case_rank") <= k)
        .drop("_sort")
    )
