"""Split, fold, bootstrap and contrast queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, rsql
from stemweave.functions.hashing import portable_hash, portable_hash_sql as ph
from stemweave.operators import curves, resample, splits
from stemweave.operators.resample import erfc_sql

SEED = 20260727
CAND = fx.with_views("candidates")


def shuffled_sql(seed: int) -> str:
    return f"""shuffled AS (SELECT tree_id, row_number() OVER (ORDER BY {ph(seed, 'tree_id')}, tree_id) - 1 AS place, count(*) OVER () AS n
      FROM (SELECT DISTINCT tree_id FROM lines) d)"""


def on_lines(fn):
    return lambda spark, sf: rounded(fn(fx.lines(spark, sf)))


def on_candidates(fn):
    return lambda spark, sf: rounded(fn(fx.candidates(spark, sf)))


SPLIT = """bounds AS (SELECT *, least(n - 2, greatest(1, round_even(n * 0.70::DOUBLE, 0))) AS te FROM shuffled),
  split AS (SELECT tree_id, CASE WHEN place < te THEN 'train' WHEN place < least(n - 1, greatest(te + 1, te + round_even(n * 0.15::DOUBLE, 0))) THEN 'val' ELSE 'test' END AS split FROM bounds)"""
FOLD = """fold AS (SELECT tree_id, (CASE WHEN place < (n % 5) * (n // 5 + 1) THEN place // (n // 5 + 1)
   ELSE n % 5 + (place - (n % 5) * (n // 5 + 1)) // (n // 5) END)::BIGINT AS fold FROM shuffled)"""
ROLES = f"""{FOLD}, roles AS (SELECT tree_id, fold, o AS outer_fold, CASE WHEN fold = o THEN 'test' WHEN fold = (o + 1) % 5 THEN 'val' ELSE 'train' END AS role
   FROM fold, range(5) r(o))"""
LINES = fx.with_views("lines")


def _split_counts(df):
    return splits.split_counts(df, splits.split_trees_floor(df, seed=SEED))


def _paired(df):
    per_tree = curves.tree_metrics(df).groupBy("tree_id").pivot("model", ["A", "B"]).agg(F.max("macro_f1"))
    return resample.paired_delta(per_tree, "A", "B", n=2000, seed=7)


def _means(df):
    """Every tree has a column per model and metric."""
    per_tree = curves.classification_metrics(df, ["model", "tree_id"])
    wide = per_tree.groupBy("tree_id").pivot("model", ["A", "B"]).agg(F.max("macro_f1").alias("macro_f1"), F.max("precision").alias("precision"))
    return resample.bootstrap_mean(wide, [c for c in wide.columns if c != "tree_id"], n=2000, seed=9)


def _row_hash():
    return portable_hash(3, F.col("sample_id"), F.col("l_partkey"))


TREE_F1 = f"""c AS (SELECT model, tree_id, count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
          count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 0 AND prediction = 0) AS tn FROM candidates GROUP BY ALL),
  tf AS (SELECT model, tree_id, ((CASE WHEN tp+tp+fp+fn > 0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0 END)
  + (CASE WHEN tn+tn+fn+fp > 0 THEN 2.0::DOUBLE*tn/(2*tn+fn+fp) ELSE 0 END))/2 AS mf, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pr FROM c)"""


def _boot_sql(source: str, n: int, seed: int) -> str:
    """means over n resamples of source(metric, tree_id, value)"""
    return f"""ix AS (SELECT metric, tree_id, value, row_number() OVER (PARTITION BY metric ORDER BY tree_id) - 1 AS i, count(*) OVER (PARTITION BY metric) AS sz FROM {source} WHERE value IS NOT NULL),
  dr AS (SELECT metric, rep, {ph(seed, 'rep', 'i')} % sz AS j FROM ix, range({n}) r(rep)),
  bm AS (SELECT dr.metric, rep, avg(value) AS m FROM dr JOIN ix ON ix.metric = dr.metric AND ix.i = dr.j GROUP BY ALL),
  ci AS (SELECT metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM bm GROUP BY metric)"""


QUERIES = [
    Query(
        "split_trees",
        on_lines(lambda df: splits.split_trees(df, seed=SEED)),
        fx.with_views("lines", extra=f"{shuffled_sql(SEED)}, {SPLIT}") + "SELECT tree_id, split FROM split",
    ),
    Query(
        "split_counts",
        on_lines(_split_counts),
        fx.with_views("lines", extra=shuffled_sql(SEED))
        + """, s AS (SELECT tree_id, CASE WHEN place < floor(n * 0.8::DOUBLE) THEN 'train' WHEN place < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM shuffled),
        v AS (SELECT tree_id, count(DISTINCT sample_id) AS items FROM lines GROUP BY 1)
        SELECT split, count(*) AS trees, sum(items)::BIGINT AS items, 0::BIGINT AS overlapping_trees FROM s JOIN v USING (tree_id) GROUP BY split""",
    ),
    Query(
        "nested_folds",
        on_lines(lambda df: splits.nested_folds(df, k=5, seed=11)),
        fx.with_views("lines", extra=f"{shuffled_sql(11)}, {ROLES}") + "SELECT * FROM roles",
    ),
    Query(
        "audit_folds",
        on_lines(lambda df: splits.audit_folds(splits.nested_folds(df, k=5, seed=11))),
        fx.with_views("lines", extra=f"{shuffled_sql(11)}, {ROLES}")
        + """SELECT outer_fold, count_if(role = 'train') AS train_trees, count_if(role = 'val') AS val_trees, count_if(role = 'test') AS test_trees, 0::BIGINT AS leaking_trees
        FROM roles GROUP BY outer_fold""",
    ),
    Query("balanced_folds", on_lines(lambda df: splits.balanced_folds(df, k=5))),
    Query("group_folds", on_lines(lambda df: splits.group_folds(df, k=4))),
    Query(
        "systematic_split",
        on_lines(lambda df: splits.systematic_split(df, "sample_id", 0.2)),
        LINES + """SELECT sample_id, CASE WHEN (row_number() OVER (ORDER BY sample_id) - 1) % 5 = 0 THEN 'test' ELSE 'train' END AS split
        FROM (SELECT DISTINCT sample_id FROM lines) d""",
    ),
    Query(
        "sample_one_per_group",
        on_lines(lambda df: splits.sample_one_per_group(df, 10, 5)),
        LINES + f""", t AS (SELECT DISTINCT tree_id FROM lines ORDER BY {ph(5, 'tree_id')}, tree_id LIMIT 10)
        SELECT tree_id, sample_id FROM (SELECT l.tree_id, sample_id, row_number() OVER (PARTITION BY l.tree_id ORDER BY {ph(5, 'l.tree_id', 'sample_id')}, sample_id) AS r
          FROM (SELECT DISTINCT tree_id, sample_id FROM lines) l JOIN t ON t.tree_id = l.tree_id) x WHERE r = 1""",
    ),
    Query(
        "downsample",
        on_lines(lambda df: splits.downsample(
            df.select("tree_id", "sample_id", "segment_id", "label", "l_partkey"), 1.5, [_row_hash(), F.col("sample_id"), F.col("segment_id")]
        ).drop("l_partkey")),
        LINES + f""", r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ph(3, 'sample_id', 'l_partkey')}, sample_id, segment_id) AS rk,
          sum(label) OVER () AS p FROM lines) SELECT tree_id, sample_id, segment_id, label FROM r WHERE label = 1 OR rk <= p * 1.5""",
    ),
    Query(
        "class_weights",
        on_candidates(lambda df: splits.class_weights(df, ["model"])),
        CAND + f"""SELECT model, count(*) AS n, sum(label)::BIGINT AS positives, {rsql('count(*) / (2 * sum(label))', 'weight_positive')},
        {rsql('count(*) / (2 * (count(*) - sum(label)))', 'weight_negative')}, {rsql('(count(*) - sum(label)) / sum(label)', 'pos_weight')} FROM candidates GROUP BY model""",
    ),
    Query(
        "audit_coverage",
        lambda spark, sf: splits.audit_coverage(
            fx.candidates(spark, sf).filter("model = 'A' OR score < 0.9"),
            fx.lines(spark, sf).filter("l_linenumber <= 6").select("sample_id", "segment_id"),
            ["sample_id", "segment_id"],
        ),
        fx.with_views("lines", "candidates") + """, o AS (SELECT * FROM candidates WHERE model = 'A' OR score < 0.9),
        e AS (SELECT DISTINCT sample_id, segment_id FROM lines WHERE l_linenumber <= 6),
        k AS (SELECT model, sample_id, segment_id, count(*) AS c FROM o GROUP BY ALL),
        j AS (SELECT model, c, e.sample_id IS NOT NULL AS known FROM k LEFT JOIN e ON e.sample_id = k.sample_id AND e.segment_id = k.segment_id)
        SELECT model, (SELECT count(*) FROM e) AS expected_keys, (SELECT count(*) FROM e) - count_if(known) AS missing_keys, count_if(NOT known) AS extra_keys,
        count_if(c > 1) AS duplicate_keys FROM j GROUP BY model""",
    ),
    Query(
        "ensemble_scores",
        on_candidates(lambda df: resample.ensemble(df, ["tree_id", "sample_id", "segment_id", "label"])),
        CAND + f"SELECT tree_id, sample_id, segment_id, label, {rsql('avg(score)', 'score')}, count(*) AS members FROM candidates GROUP BY ALL",
    ),
    Query(
        "select_model",
        on_candidates(lambda df: resample.select_model(curves.average_precision(df))),
        CAND + f""", hist AS (SELECT model, score, count(*) AS n, sum(label) AS pos FROM candidates GROUP BY ALL),
        cum AS (SELECT *, sum(n) OVER w AS above, sum(pos) OVER w AS tp FROM hist WINDOW w AS (PARTITION BY model ORDER BY score DESC)),
        a AS (SELECT model, sum(pos * tp / above) / sum(pos) AS ap FROM cum GROUP BY model)
        SELECT model, {rsql('ap', 'average_precision')} FROM a ORDER BY ap DESC, model LIMIT 1""",
    ),
    Query(
        "mean_contrast",
        on_lines(lambda df: resample.mean_contrast(df, ["l_quantity", "l_discount", "l_tax", "l_linenumber"])),
        LINES + ", long AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, label, {c}::DOUBLE AS v FROM lines" for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"]) + f""")
        SELECT feature, {rsql('avg(v) FILTER (label = 1)', 'mean_positive')}, {rsql('avg(v) FILTER (label = 0)', 'mean_negative')}, {rsql('stddev_samp(v) FILTER (label = 0)', 'std_negative')},
        {rsql('(avg(v) FILTER (label = 1) - avg(v) FILTER (label = 0)) / greatest(stddev_samp(v) FILTER (label = 0), 1e-9)', 'standardized_shift')} FROM long GROUP BY feature""",
    ),
    Query(
        "bootstrap_mean",
        on_candidates(_means),
        CAND + f""", {TREE_F1}, src AS (SELECT model || '_macro_f1' AS metric, tree_id, mf AS value FROM tf UNION ALL SELECT model || '_precision', tree_id, pr FROM tf),
        {_boot_sql('src', 2000, 9)} SELECT metric, {rsql('(SELECT avg(value) FROM src WHERE src.metric = ci.metric)', 'mean')}, {rsql('lo', 'ci95_low')}, {rsql('hi', 'ci95_high')} FROM ci""",
    ),
    Query(
        "paired_delta",
        on_candidates(_paired),
        CAND + f""", {TREE_F1}, src AS (SELECT 'delta' AS metric, a.tree_id, b.mf - a.mf AS value FROM tf a JOIN tf b ON a.tree_id = b.tree_id AND a.model = 'A' AND b.model = 'B'),
        {_boot_sql('src', 2000, 7)},
        tie AS (SELECT abs(value) AS s, count(*) AS n, count_if(value > 0) AS ups FROM src WHERE abs(value) > 1e-12 GROUP BY 1),
        rk AS (SELECT *, sum(n) OVER (ORDER BY s) - (n - 1) / 2.0::DOUBLE AS r FROM tie),
        sm AS (SELECT sum(ups * r) AS up, sum(n)::DOUBLE AS m, sum(n::DOUBLE * n * n - n) AS tie FROM rk),
        zz AS (SELECT abs(least(up, m * (m + 1) / 2 - up) - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - tie / 2) / 24) / sqrt(2.0::DOUBLE) AS x FROM sm)
        SELECT {rsql('(SELECT avg(value) FROM src)', 'delta')}, {rsql('lo', 'ci_low')}, {rsql('hi', 'ci_high')}, {rsql('(SELECT ' + erfc_sql('x') + ' FROM zz)', 'p_value')} FROM ci""",
    ),
    Query(
        "cluster_bootstrap",
        on_candidates(lambda df: resample.cluster_bootstrap(df, n=1000, seed=42)),
        CAND + f""", ix AS (SELECT tree_id, row_number() OVER (ORDER BY tree_id) - 1 AS i, count(*) OVER () AS sz FROM (SELECT DISTINCT tree_id FROM candidates) d),
        dr AS (SELECT rep, j, count(*) AS times FROM (SELECT rep, {ph(42, 'rep', 'i')} % sz AS j FROM ix, range(1000) r(rep)) x GROUP BY ALL),
        hist AS (SELECT model, tree_id, score, count(*) AS n, sum(label) AS pos FROM candidates GROUP BY ALL),
        wt AS (SELECT model, rep, score, sum(n * times) AS n, sum(pos * times) AS pos FROM hist JOIN ix USING (tree_id) JOIN dr ON dr.j = ix.i GROUP BY ALL),
        cum AS (SELECT *, sum(n) OVER w AS above, sum(pos) OVER w AS tp FROM wt WINDOW w AS (PARTITION BY model, rep ORDER BY score DESC)),
        v AS (SELECT model, rep, sum(pos * tp / above) / sum(pos) AS ap, sum((n - pos) * (tp - pos / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(n - pos)) AS auc FROM cum GROUP BY ALL)
        SELECT model, {rsql('quantile_cont(ap, 0.025)', 'average_precision_low')}, {rsql('quantile_cont(ap, 0.975)', 'average_precision_high')},
        {rsql('quantile_cont(auc, 0.025)', 'auroc_low')}, {rsql('quantile_cont(auc, 0.975)', 'auroc_high')} FROM v GROUP BY model""",
    ),
]
