"""Skew-safe helpers against plain numpy and pandas."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from stemweave.plans.skew import attach_groups, exact_quantiles, grouped_rank, running_totals


def hot_frame(n=4000, seed=1):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 40, n))
    return pd.DataFrame({"k": key, "id": np.arange(n), "v": rng.integers(0, 50, n).astype(float)})


def test_running_totals_of_a_hot_key(spark):
    pdf = hot_frame()
    df = running_totals(spark.createDataFrame(pdf), ["k"], [F.col("v"), F.col("id")], {"rank": F.lit(1), "total": F.col("v")}, whole={"all": "total"})
    got = df.toPandas().sort_values(["k", "v", "id"], ignore_index=True)
    want = pdf.sort_values(["k", "v", "id"], ignore_index=True)
    assert (got["id"] == want["id"]).all()
    assert (got["rank"] == want.groupby("k").cumcount() + 1).all()
    assert np.allclose(got["total"], want.groupby("k")["v"].cumsum())
    assert np.allclose(got["all"], want.groupby("k")["v"].transform("sum"))


def test_exclusive_running_max(spark):
    pdf = hot_frame(500)
    df = running_totals(spark.createDataFrame(pdf), ["k"], [F.col("id")], {"m": F.col("v")}, exclusive=True, running="max")
    got = df.toPandas().sort_values(["k", "id"], ignore_index=True)
    want = pdf.sort_values(["k", "id"], ignore_index=True).groupby("k")["v"].transform(lambda s: s.cummax().shift())
    assert np.allclose(got["m"].fillna(-1), want.fillna(-1))


def test_global_rank(spark):
    pdf = hot_frame(300)
    got = grouped_rank(spark.createDataFrame(pdf), [], [F.col("v").desc(), F.col("id")]).toPandas().sort_values("rank")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert got["id"].tolist() == want["id"].tolist() and got["rank"].tolist() == list(range(1, 301))


def test_quantiles_match_numpy(spark):
    pdf = hot_frame()
    probs = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]
    got = exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", probs).toPandas()
    assert len(got) == len(probs) * pdf["k"].nunique()
    for row in got.itertuples():
        assert abs(row.quantile - np.quantile(pdf.loc[pdf.k == row.k, "v"], row.prob)) < 1e-9


def test_attach_groups_keeps_unmatched_rows(spark):
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 12)], "k int, v int")
    groups = spark.createDataFrame([(1, "a")], "k int, name string")
    assert sorted(attach_groups(rows, groups, ["k"], "left").collect()) == [(1, 10, "a"), (1, 11, "a"), (2, 12, None)]


def test_shuffle_files_go_with_the_write(spark):
    from stemweave.plans.durable import CLEANUP, written

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(CLEANUP, None)
    table = written(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert sorted(map(tuple, table.collect()))[:2] == [(0, 143), (1, 143)]
    assert shuffled() <= before and spark.conf.get(CLEANUP, None) == setting
