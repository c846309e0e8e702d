"""Resamples are random draws: share of distinct trees, width of intervals, unrelated orders of seeds."""

import numpy as np
from pyspark.sql import functions as F

from stemweave.operators import resample, splits


def trees(spark, n):
    return spark.range(n).select(F.col("id").alias("tree_id"))


def test_draws_leave_out_a_third(spark):
    for n in (1000, 1009):
        drawn = np.array([r["times"] for r in resample.tree_draws(trees(spark, n), "tree_id", 20, 42).collect()])
        assert drawn.shape == (n, 20) and (drawn.sum(axis=0) == n).all()
        shares = (drawn > 0).mean(axis=0)
        assert abs(np.mean(shares) - 0.632) < 0.01 and all(abs(s - 0.632) < 0.06 for s in shares)


def test_interval_has_the_width_of_theory(spark):
    values = np.random.default_rng(3).normal(0, 1, 400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "tree_id long, v double")
    row = resample.bootstrap_mean(df, ["v"], n=1000, seed=5).first()
    expected = 2 * 1.96 * values.std() / 20
    assert abs((row["ci95_high"] - row["ci95_low"]) / expected - 1) < 0.12
    assert row["ci95_low"] < values.mean() < row["ci95_high"]


def test_seeds_give_unrelated_orders(spark):
    order = lambda seed: [r["tree_id"] for r in splits.shuffled_trees(trees(spark, 300), "tree_id", seed).orderBy("place").collect()]
    a, b = order(1), order(2)
    at = b.index(a[0])
    turned = b[at:] + b[:at]
    assert np.mean([x == y for x, y in zip(a, turned, strict=True)]) < 0.1
    assert abs(np.corrcoef(np.argsort(a), np.argsort(b))[0, 1]) < 0.25


def test_weighted_vectors_equal_expanded_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(("A", "B")[i % 2], int(t), float(s), int(y)) for i, (t, s, y) in enumerate(zip(rng.integers(0, 30, 600), rng.integers(0, 12, 600) / 10, rng.integers(0, 2, 600), strict=True))]
    df = spark.createDataFrame(rows, "model string, tree_id long, score double, label long")
    drawn = {r["tree_id"]: r["times"] for r in resample.tree_draws(df.select("tree_id").distinct(), "tree_id", 40, 9).collect()}
    draws = {rep: {t: times[rep] for t, times in drawn.items()} for rep in range(40)}
    got = {r["model"]: r for r in resample.cluster_bootstrap(df, n=40, seed=9).collect()}
    for model in "AB":
        aucs, precisions = [], []
        for times in draws.values():
            mine = [(s, y, times.get(t, 0)) for m, t, s, y in rows if m == model]
            pos = [(s, w) for s, y, w in mine if y]
            neg = [(s, w) for s, y, w in mine if not y]
            won = sum(w * v * ((a > b) + 0.5 * (a == b)) for a, w in pos for b, v in neg)
            aucs.append(won / (sum(w for _, w in pos) * sum(v for _, v in neg)))
            above = lambda s, side: sum(w for t, w in side if t >= s)
            precisions.append(sum(w * above(s, pos) / (above(s, pos) + above(s, neg)) for s, w in pos if w) / sum(w for _, w in pos))
        assert abs(got[model]["average_precision_low"] - np.percentile(precisions, 2.5)) < 1e-9
        assert abs(got[model]["auroc_low"] - np.percentile(aucs, 2.5)) < 1e-9 and abs(got[model]["auroc_high"] - np.percentile(aucs, 97.5)) < 1e-9


def test_bootstrap_over_many_ranges_and_a_group_without_positives(spark):
    rng = np.random.default_rng(2)
    rows = [("A", int(t), float(s), int(s + e > 1)) for t, s, e in zip(rng.integers(0, 40, 1500), rng.random(1500), rng.random(1500), strict=True)] + [("C", 1, 0.5, 0), ("C", 2, 0.7, 0)]
    df = spark.createDataFrame(rows, "model string, tree_id long, score double, label long")
    once = {r["model"]: r for r in resample.cluster_bootstrap(df, n=30, seed=3).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        again = {r["model"]: r for r in resample.cluster_bootstrap(df, n=30, seed=3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert set(once) == set(again) == {"A"}
    assert all(abs(once["A"][c] - again["A"][c]) < 1e-9 for c in once["A"].asDict() if c != "model")
    assert resample.cluster_bootstrap(df.limit(0), n=30).count() == 0


def test_hashes_in_arrays_equal_the_column(spark):
    from stemweave.functions.hashing import portable_hash, portable_hashes

    for seed, rep, size in ((42, 0, 1), (7, 1999, 12_345), (9, 31, 10_001)):
        column = [r[0] for r in spark.range(size).orderBy("id").select(portable_hash(seed, F.lit(rep), F.col("id"))).collect()]
        assert portable_hashes(seed, rep, size).tolist() == column


def test_draws_are_no_rows(spark):
    """Ten thousand trees in 400 resamples are four million draws; the plan has rows per part of the trees only."""
    drawn = resample.draws(spark, 10_000, 400, 5).collect()
    assert sorted(r["part"] for r in drawn) == list(range(10)) and sum(len(r["times"]) for r in drawn) <= 10 * 400
    times = np.concatenate([resample._times(r["times"], min(1024, 10_000 - 1024 * r["part"])) for r in sorted(drawn)])
    assert times.shape == (10_000, 400) and (times.sum(axis=0) == 10_000).all()


def test_means_with_gaps_equal_expanded_draws(spark):
    from stemweave.functions.hashing import portable_hashes

    rng = np.random.default_rng(6)
    rows = [(i, float(a), None if i % 7 == 0 else float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (2500, 2)))]
    got = {r["metric"]: r for r in resample.bootstrap_mean(spark.createDataFrame(rows, "tree_id long, a double, b double"), ["a", "b"], n=60, seed=4).collect()}
    for m, at in (("a", 1), ("b", 2)):
        values = np.array([r[at] for r in rows if r[at] is not None])
        means = [values[(portable_hashes(4, rep, len(values)) % np.uint64(len(values))).astype(int)].mean() for rep in range(60)]
        assert abs(got[m]["mean"] - values.mean()) < 1e-9
        assert abs(got[m]["ci95_low"] - np.percentile(means, 2.5)) < 1e-9 and abs(got[m]["ci95_high"] - np.percentile(means, 97.5)) < 1e-9


def test_a_tree_with_many_scores_is_dealt_to_lanes(spark):
    rng = np.random.default_rng(8)
    rows = [("A", int(t), float(s), int(s + e > 1)) for t, s, e in zip(np.where(rng.random(9000) < 0.9, 0, rng.integers(0, 20, 9000)), rng.random(9000), rng.random(9000), strict=True)]
    df = spark.createDataFrame(rows, "model string, tree_id long, score double, label long")
    whole = resample.cluster_bootstrap(df, n=12, seed=3).first()
    resample.LANE, before = 10**9, resample.LANE
    try:
        one = resample.cluster_bootstrap(df, n=12, seed=3).first()
    finally:
        resample.LANE = before
    assert all(abs(whole[c] - one[c]) < 1e-9 for c in whole.asDict() if c != "model")


def test_draws_are_never_broadcast(spark, monkeypatch):
    """A plan takes the draws for a few short rows; with many trees they are gigabytes."""
    plans = {}
    keep = resample.written
    monkeypatch.setattr(resample, "written", lambda df, tag="stage": plans.setdefault(tag, df._jdf.queryExecution().toString()) and keep(df, tag))
    rows = [("A", t, (t * 7 % 11) / 11, t % 3 % 2) for t in range(3000)]
    got = resample.cluster_bootstrap(spark.createDataFrame(rows, "model string, tree_id long, score double, label long"), n=20, seed=3).first()
    assert 0 < got["auroc_low"] < got["auroc_high"] < 1
    resample.bootstrap_mean(spark.createDataFrame(rows, "model string, tree_id long, score double, label long"), ["score"], n=20, seed=3).first()
    assert all("MapInArrow" in plans[t] and "BroadcastHashJoin [part" not in plans[t] for t in ("sums", "drawn"))
