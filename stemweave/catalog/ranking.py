"""Ranking, curve and threshold queries over the candidate table."""

from __future__ import annotations

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, rsql
from stemweave.operators import curves, ranking

CAND = fx.with_views("candidates")
RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY model, tree_id, sample_id ORDER BY score DESC, segment_id) AS rk FROM candidates)"
VIEWS = """views AS (SELECT model, tree_id, sample_id, count(*) AS n, sum(label) AS p,
   min(CASE WHEN label = 1 THEN rk END) AS fr,
   sum(CASE WHEN label = 1 AND rk <= 1 THEN 1 ELSE 0 END) AS h1, sum(CASE WHEN label = 1 AND rk <= 3 THEN 1 ELSE 0 END) AS h3
   FROM ranked GROUP BY ALL)"""
BASE = fx.with_views("candidates", extra=f"{RANKED}, {VIEWS}")
CUM = """hist AS (SELECT model, score, count(*) AS n, sum(label) AS pos FROM candidates GROUP BY ALL),
 cum AS (SELECT *, sum(n) OVER w AS above, sum(pos) OVER w AS tp, sum(n) OVER (PARTITION BY model) AS n_all,
   sum(pos) OVER (PARTITION BY model) AS p_all FROM hist WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""
CURVE = fx.with_views("candidates", extra=CUM)
MACRO = """((CASE WHEN tp+tp+fp+fn > 0 THEN 2.0::DOUBLE*tp/(2*tp+fp+fn) ELSE 0 END)
  + (CASE WHEN tn+tn+fn+fp > 0 THEN 2.0::DOUBLE*tn/(2*tn+fn+fp) ELSE 0 END))/2"""


def on_candidates(fn, *args):
    return lambda spark, sf: rounded(fn(fx.candidates(spark, sf), *args))


RANDOM_TREE = """random_views AS (SELECT model, tree_id,
   (p::DOUBLE / n) AS r1,
   CASE WHEN 3 >= n OR 3 > n - p THEN 1.0 ELSE 1.0 - ((n-p)::DOUBLE/n) * ((n-p-1)::DOUBLE/(n-1)) * ((n-p-2)::DOUBLE/(n-2)) END AS r3,
   (p + 1.0::DOUBLE) / (n + 1.0::DOUBLE) AS rm FROM views WHERE p > 0),
 random_tree AS (SELECT model, tree_id, avg(r1) AS r1, avg(r3) AS r3, avg(rm) AS rm FROM random_views GROUP BY ALL),
 model_tree AS (SELECT model, tree_id, avg((fr <= 1)::INT) AS s1, avg((fr <= 3)::INT) AS s3, avg(1.0::DOUBLE / fr) AS m FROM views WHERE p > 0 GROUP BY ALL)"""

# Segments match true ones whose line numbers differ by one at most. These ranges rise together, so taking, line by line,
# the first true one that is left gives the largest matching: a fold that shares nothing with augmenting paths.
HOPS = """num AS (SELECT r.model, r.tree_id, r.sample_id, r.label, rk, l_linenumber AS ln FROM ranked r JOIN lines l ON l.sample_id = r.sample_id AND l.segment_id = r.segment_id),
 tv AS (SELECT model, tree_id, sample_id, list(ln ORDER BY ln) AS t, count(*) AS b FROM num WHERE label = 1 GROUP BY ALL),
 sl AS (SELECT *, unnest([1, 3, b]) AS size, unnest(['1', '3', 'b']) AS slot FROM tv),
 pk AS (SELECT sl.model, sl.tree_id, sl.sample_id, slot, t, b, list(ln ORDER BY ln) AS p, sum(label)::BIGINT AS exact FROM sl JOIN num ON num.model = sl.model AND num.tree_id = sl.tree_id AND num.sample_id = sl.sample_id AND rk <= size GROUP BY ALL),
 mt AS (SELECT *, list_reduce([0::BIGINT] || p, lambda s, x: CASE WHEN t[greatest(s // 1000, len(list_filter(t, lambda y: y < x - 1))) + 1] <= x + 1
   THEN (greatest(s // 1000, len(list_filter(t, lambda y: y < x - 1))) + 1) * 1000 + s % 1000 + 1 ELSE s END) % 1000 AS hop1 FROM pk),
 wide AS (SELECT model, tree_id, sample_id, any_value(b) AS truth_cuts, {sums} FROM mt GROUP BY ALL)""".replace(
    "{sums}", ", ".join(f"coalesce(sum({k}) FILTER (slot = '{n}'), 0) AS {k}_{n}" for k in ("exact", "hop1") for n in "13b"))
HOP_COLUMNS = [(f"{k}_hit_at_{b}", f"({k}_{b} > 0)::INT") for b in "13" for k in ("exact", "hop1")]
HOP_COLUMNS += [(f"{k}_recall_at_{b}", f"{k}_{b}::DOUBLE / truth_cuts") for b in "13" for k in ("exact", "hop1")]
HOP_COLUMNS += [(f"budget_{k}_coverage", f"{k}_b::DOUBLE / truth_cuts") for k in ("exact", "hop1")] + [(f"budget_{k}_any", f"({k}_b > 0)::INT") for k in ("exact", "hop1")]
HOP_VIEWS = fx.with_views("lines", "candidates", extra=f"{RANKED}, {HOPS}")


def _recommended(spark, sf):
    return ranking.recommendation_metrics(fx.candidates(spark, sf), fx.adjacency(spark, sf))


QUERIES = [
    Query("recommendation_metrics", lambda s, sf: rounded(_recommended(s, sf)),
          HOP_VIEWS + f" SELECT model, tree_id, sample_id, truth_cuts::BIGINT AS truth_cuts, {', '.join(rsql(e, n) for n, e in HOP_COLUMNS)} FROM wide"),
    Query("recommendation_summary", lambda s, sf: rounded(ranking.recommendation_summary(_recommended(s, sf))),
          HOP_VIEWS + f""", vw AS (SELECT model, tree_id, {', '.join(f'{e} AS {n}' for n, e in HOP_COLUMNS)} FROM wide), tr AS (SELECT model, tree_id, {', '.join(f'avg({n}) AS {n}' for n, _ in HOP_COLUMNS)} FROM vw GROUP BY ALL)
          SELECT * FROM (SELECT model, {', '.join(rsql(f'avg({n})', n) for n, _ in HOP_COLUMNS)}, count(*) AS trees FROM tr GROUP BY model)
          JOIN (SELECT model, {', '.join(rsql(f'avg({n})', f'pooled_{n}') for n, _ in HOP_COLUMNS)}, count(*) AS positive_views FROM vw GROUP BY model) USING (model)"""),
    Query(
        "ranking_vs_random",
        on_candidates(ranking.ranking_against_random),
        fx.with_views("candidates", extra=f"{RANKED}, {VIEWS}, {RANDOM_TREE}")
        + f"""SELECT m.model, {rsql('avg(s1)', 'success_at_1')}, {rsql('avg(s3)', 'success_at_3')}, {rsql('avg(m)', 'mrr')},
        count(*) AS trees, any_value(pv) AS positive_views, any_value(zv) AS zero_positive_views,
        any_value(x1) AS random_success_at_1, any_value(x3) AS random_success_at_3, any_value(xm) AS random_mrr_reference
        FROM model_tree m
        JOIN (SELECT model, count_if(p > 0) AS pv, count_if(p = 0) AS zv FROM views GROUP BY model) c ON c.model = m.model
        JOIN (SELECT model, {rsql('avg(r1)', 'x1')}, {rsql('avg(r3)', 'x3')}, {rsql('avg(rm)', 'xm')} FROM random_tree GROUP BY model) r
          ON r.model = m.model GROUP BY m.model""",
    ),
    Query(
        "budget_metrics",
        on_candidates(ranking.budget_metrics),
        fx.with_views("candidates", extra=f"{RANKED}, {VIEWS}")
        + f""", hit AS (SELECT r.model, r.tree_id, r.sample_id, p, sum(CASE WHEN label = 1 AND rk <= p THEN 1 ELSE 0 END) AS h
          FROM ranked r JOIN views v ON r.model = v.model AND r.tree_id = v.tree_id AND r.sample_id = v.sample_id WHERE p > 0 GROUP BY ALL),
          t AS (SELECT model, tree_id, avg(h::DOUBLE / p) AS c, avg((h > 0)::INT) AS a FROM hit GROUP BY ALL)
        SELECT model, {rsql('avg(c)', 'budget_coverage')}, {rsql('avg(a)', 'budget_any_hit')}, count(*) AS trees FROM t GROUP BY model""",
    ),
    Query(
        "recommendations_exact",
        on_candidates(ranking.exact_recommendations),
        fx.with_views("candidates", extra=f"{RANKED}, {VIEWS}")
        + f""", hit AS (SELECT r.model, r.tree_id, r.sample_id, sum(CASE WHEN label = 1 AND rk <= p THEN 1 ELSE 0 END) AS hb
          FROM ranked r JOIN views v ON r.model = v.model AND r.tree_id = v.tree_id AND r.sample_id = v.sample_id WHERE p > 0 GROUP BY ALL)
        SELECT v.model, v.tree_id, v.sample_id, p::BIGINT AS truth_cuts, (h1 > 0)::INT::DOUBLE AS exact_hit_at_1, (h3 > 0)::INT::DOUBLE AS exact_hit_at_3,
          {rsql('h1::DOUBLE / p', 'exact_recall_at_1')}, {rsql('h3::DOUBLE / p', 'exact_recall_at_3')},
          {rsql('hb::DOUBLE / p', 'budget_exact_coverage')}, (hb > 0)::INT::DOUBLE AS budget_exact_any
        FROM views v JOIN hit h ON h.model = v.model AND h.tree_id = v.tree_id AND h.sample_id = v.sample_id""",
    ),
    Query(
        "pick_cases",
        on_candidates(ranking.pick_cases, 5),
        CAND
        + """, k AS (SELECT *, CASE WHEN label = 1 AND prediction = 1 THEN 'success' WHEN label = 0 AND prediction = 1 THEN 'false_positive'
             WHEN label = 1 AND prediction = 0 THEN 'missed' END AS case_kind FROM candidates),
          r AS (SELECT *, row_number() OVER (PARTITION BY model, case_kind ORDER BY CASE WHEN case_kind = 'missed' THEN score ELSE -score END, sample_id, segment_id)
             AS case_rank FROM k WHERE case_kind IS NOT NULL)
          SELECT model, tree_id, sample_id, segment_id, candidate_type, label, round(score, 6) + 0.0 AS score, prediction, case_kind, case_rank FROM r WHERE case_rank <= 5""",
    ),
    Query(
        "average_precision",
        on_candidates(curves.average_precision),
        CURVE + f"SELECT model, {rsql('sum(pos * tp / above) / any_value(p_all)', 'average_precision')} FROM cum GROUP BY model",
    ),
    Query(
        "auroc",
        on_candidates(curves.auroc),
        CURVE + f"SELECT model, {rsql('sum((n - pos) * (tp - pos / 2.0::DOUBLE)) / (any_value(p_all) * any_value(n_all - p_all))', 'auroc')} FROM cum GROUP BY model",
    ),
    Query(
        "pr_curve",
        on_candidates(curves.pr_curve),
        CURVE + f"""SELECT model, {rsql('tp / above', 'precision')}, {rsql('tp / p_all', 'recall')}, {rsql('score', 'threshold')} FROM cum
        UNION ALL SELECT DISTINCT model, 1.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM candidates""",
    ),
    Query(
        "roc_curve",
        on_candidates(curves.roc_curve),
        CURVE + f"""SELECT model, {rsql('(above - tp) / (n_all - p_all)', 'fpr')}, {rsql('tp / p_all', 'tpr')}, {rsql('score', 'threshold')} FROM cum
        UNION ALL SELECT DISTINCT model, 0.0::DOUBLE, 0.0::DOUBLE, NULL::DOUBLE FROM candidates""",
    ),
    Query(
        "precision_at_recall",
        on_candidates(lambda df: curves.precision_at_recall(curves.pr_curve(df), [0.1, 0.2, 0.25, 0.3, 0.4, 0.5])),
        CURVE + f""", c AS (SELECT model, tp / above AS precision, tp / p_all AS recall, score FROM cum UNION ALL SELECT DISTINCT model, 1.0, 0.0, 'infinity'::DOUBLE FROM candidates),
        t AS (SELECT unnest([0.1::DOUBLE, 0.2::DOUBLE, 0.25::DOUBLE, 0.3::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE]) AS target),
        e AS (SELECT model, target, max(recall) FILTER (recall <= target) AS r0, min(recall) FILTER (recall > target) AS r1 FROM c, t GROUP BY ALL),
        l AS (SELECT e.model, target, r0, r1, arg_min(precision, score) AS p0 FROM e JOIN c ON c.model = e.model AND c.recall = e.r0 GROUP BY ALL),
        h AS (SELECT e.model, target, arg_max(precision, score) AS p1 FROM e JOIN c ON c.model = e.model AND c.recall = e.r1 GROUP BY ALL)
        SELECT l.model, l.target, {rsql('CASE WHEN p1 IS NULL THEN p0 ELSE p0 + (p1 - p0) * (l.target - r0) / (r1 - r0) END', 'precision_at_recall')}
        FROM l LEFT JOIN h ON h.model = l.model AND h.target = l.target""",
    ),
    Query(
        "classification_metrics",
        on_candidates(curves.classification_metrics),
        CAND + f""", c AS (SELECT model, count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
          count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 0 AND prediction = 0) AS tn, avg((score - label) * (score - label)) AS b FROM candidates GROUP BY model)
        SELECT model, tp, fp, fn, tn, {rsql('tp / (tp + fp)', 'precision')}, {rsql('tp / (tp + fn)', 'recall')}, {rsql('2.0 * tp / (2 * tp + fp + fn)', 'f1')},
          {rsql(MACRO, 'macro_f1')}, {rsql('(tp / (tp + fp)) / ((tp + fn) / (tp + fp + fn + tn))', 'multiple_over_random')}, {rsql('b', 'brier')} FROM c""",
    ),
    Query(
        "threshold_grid",
        on_candidates(curves.choose_threshold_grid),
        CAND + f""", g AS (SELECT CASE WHEN i = 90 THEN 0.95::DOUBLE ELSE 0.05::DOUBLE + i * ((0.95::DOUBLE - 0.05::DOUBLE) / 90) END AS t FROM range(91) r(i)),
         m AS (SELECT DISTINCT model FROM candidates),
         c AS (SELECT m.model, t, (SELECT 1) AS one FROM m, g),
         s AS (SELECT model, score, label, count(*) AS n FROM candidates GROUP BY ALL),
         k AS (SELECT c.model, t, sum(CASE WHEN label = 1 AND score >= t THEN n ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND score >= t THEN n ELSE 0 END) AS fp,
            sum(CASE WHEN label = 1 AND score < t THEN n ELSE 0 END) AS fn, sum(CASE WHEN label = 0 AND score < t THEN n ELSE 0 END) AS tn
            FROM c JOIN s ON s.model = c.model GROUP BY c.model, t),
         f AS (SELECT model, t, {MACRO} AS v FROM k)
        SELECT model, {rsql('t', 'threshold')}, {rsql('v', 'macro_f1')} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY v DESC, abs(t - 0.5), t) AS r FROM f) WHERE r = 1""",
    ),
    Query(
        "threshold_quantile",
        on_candidates(curves.choose_threshold_quantile),
        CAND + f""", q AS (SELECT CASE WHEN i = 299 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE + i * ((0.99::DOUBLE - 0.01::DOUBLE) / 299) END AS pr FROM range(300) r(i)),
         o AS (SELECT model, score, row_number() OVER (PARTITION BY model ORDER BY score) - 1 AS ix, count(*) OVER (PARTITION BY model) AS sz FROM candidates),
         z AS (SELECT DISTINCT model, sz FROM o),
         p AS (SELECT z.model, pr * (sz - 1)::DOUBLE AS pos FROM z, q),
         tq AS (SELECT p.model, a.score + (b.score - a.score) * (pos - floor(pos)) AS t FROM p JOIN o a ON a.model = p.model AND a.ix = floor(pos)::BIGINT
            JOIN o b ON b.model = p.model AND b.ix = ceil(pos)::BIGINT
            UNION SELECT z.model, x FROM z, (SELECT unnest([0.0::DOUBLE, 0.5::DOUBLE, 1.0::DOUBLE]) AS x)),
         s AS (SELECT model, score, label, count(*) AS n FROM candidates GROUP BY ALL),
         k AS (SELECT c.model, t, sum(CASE WHEN label = 1 AND score >= t THEN n ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND score >= t THEN n ELSE 0 END) AS fp,
            sum(CASE WHEN label = 1 AND score < t THEN n ELSE 0 END) AS fn, sum(CASE WHEN label = 0 AND score < t THEN n ELSE 0 END) AS tn
            FROM tq c JOIN s ON s.model = c.model GROUP BY c.model, t),
         f AS (SELECT model, t, {MACRO} AS v FROM k)
        SELECT model, {rsql('t', 'threshold')}, {rsql('v', 'macro_f1')} FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY v DESC, t DESC) AS r FROM f) WHERE r = 1""",
    ),
    Query(
        "tree_macro_ap",
        on_candidates(curves.macro_by_tree),
        fx.with_views("candidates") + f""", hist AS (SELECT model, tree_id, score, count(*) AS n, sum(label) AS pos FROM candidates GROUP BY ALL),
        cum AS (SELECT *, sum(n) OVER w AS above, sum(pos) OVER w AS tp FROM hist WINDOW w AS (PARTITION BY model, tree_id ORDER BY score DESC)),
        t AS (SELECT model, tree_id, sum(pos * tp / above) / sum(pos) AS ap FROM cum GROUP BY ALL HAVING sum(pos) > 0)
        SELECT model, {rsql('avg(ap)', 'tree_macro_ap')}, count(*) AS trees_with_positive FROM t GROUP BY model""",
    ),
    Query(
        "per_view_load",
        on_candidates(curves.per_view_load),
        CAND + f""", v AS (SELECT model, sample_id, sum(prediction) AS made, sum(prediction * (1 - label)) AS fm FROM candidates GROUP BY ALL)
        SELECT model, {rsql('avg(fm)', 'mean_false_recommendations_per_view')}, {rsql('avg(made)', 'mean_recommendations_per_view')} FROM v GROUP BY model""",
    ),
    Query(
        "tree_metrics",
        on_candidates(curves.tree_metrics),
        CAND + f""", hist AS (SELECT model, tree_id, score, count(*) AS n, sum(label) AS pos FROM candidates GROUP BY ALL),
        cum AS (SELECT *, sum(n) OVER w AS above, sum(pos) OVER w AS stp FROM hist WINDOW w AS (PARTITION BY model, tree_id ORDER BY score DESC)),
        a AS (SELECT model, tree_id, CASE WHEN sum(pos) > 0 THEN sum(pos * stp / above) / sum(pos) END AS ap FROM cum GROUP BY ALL),
        c AS (SELECT model, tree_id, count_if(label = 1 AND prediction = 1) AS tp, count_if(label = 0 AND prediction = 1) AS fp,
          count_if(label = 1 AND prediction = 0) AS fn, count_if(label = 0 AND prediction = 0) AS tn FROM candidates GROUP BY ALL)
        SELECT c.model, c.tree_id, {rsql('ap', 'pr_auc')}, {rsql(MACRO, 'macro_f1')}, {rsql('CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END', 'precision')},
        {rsql('CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END', 'recall')} FROM c JOIN a ON a.model = c.model AND a.tree_id = c.tree_id""",
    ),
    Query(
        "metric_rollup",
        on_candidates(curves.metric_rollup),
        CAND + """SELECT model, tree_id, sample_id, count(*) AS n, sum(label)::BIGINT AS positives, sum(prediction)::BIGINT AS recommended,
        grouping_id(model, tree_id, sample_id)::BIGINT AS level FROM candidates GROUP BY GROUPING SETS ((model), (model, tree_id), (model, tree_id, sample_id))""",
    ),
]
