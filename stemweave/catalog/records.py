"""Manifest, audit, review and run-summary queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemweave import fixtures as fx
from stemweave.catalog.base import Query, rounded, rsql, table
from stemweave.functions.hashing import MODULUS, portable_hash, portable_hash_sql as ph
from stemweave.functions.keys import parse_sample_key
from stemweave.operators import audit, manifest, review, summaries

c = F.col
FILES = fx.with_views("files")

# --- audits of cut lines -------------------------------------------------------------------------


def images(cuts: DataFrame) -> DataFrame:
    """One image per sample; some samples have none."""
    return cuts.select("sample_id").distinct().filter(c("sample_id").cast("long") % 29 != 0).select(
        "sample_id", F.lit(720.0).alias("width"), F.lit(480.0).alias("height")
    )


def cut_issues(spark: SparkSession, sf: str) -> DataFrame:
    cuts = fx.cut_lines(spark, sf)
    return audit.audit_cut_lines(cuts, images(cuts))


PAIR = lambda p: f"({p} IS NOT NULL AND len({p}) = 2)"
OUT = lambda p: f"CAST(sample_id AS BIGINT) % 29 <> 0 AND NOT ({p}[1] >= 0 AND {p}[1] < 720 AND {p}[2] >= 0 AND {p}[2] < 480)"
CHECKS = [
    ("cut_id = ''", "missing_cut_id", "''"),
    ("NOT ok", "invalid_endpoint", "cut_id"),
    ("ok AND p0[1] = p1[1] AND p0[2] = p1[2]", "zero_length_cut", "cut_id"),
    (f"ok AND {OUT('p0')}", "coordinate_out_of_bounds", "concat(cut_id, '.p0')"),
    (f"ok AND {OUT('p1')}", "coordinate_out_of_bounds", "concat(cut_id, '.p1')"),
    ("ok AND normal_pruned_side IS NULL", "invalid_pruned_normal", "cut_id"),
    ("ok AND abs(sqrt(normal_pruned_side[1] ** 2 + normal_pruned_side[2] ** 2) - 1) > 1e-3", "non_unit_pruned_normal", "cut_id"),
    ("ok AND normal_retained_side IS NULL", "invalid_retained_normal", "cut_id"),
    (
        "ok AND normal_pruned_side IS NOT NULL AND normal_retained_side IS NOT NULL AND NOT (abs(normal_pruned_side[1] + normal_retained_side[1]) <= 1e-3"
        " AND abs(normal_pruned_side[2] + normal_retained_side[2]) <= 1e-3)", "normal_direction_mismatch", "cut_id"),
    ("ok AND confirmed IS NULL", "invalid_confirmed_value", "cut_id"),
    ("ok AND NOT confirmed", "unconfirmed_cut", "cut_id"),
]
ISSUES = (
    f"ck AS (SELECT *, {PAIR('p0')} AND {PAIR('p1')} AS ok FROM cut_lines), issues AS ("
    + " UNION ALL ".join(f"SELECT sample_id, 'error' AS severity, '{code}' AS code, {detail} AS detail FROM ck WHERE {cond}" for cond, code, detail in CHECKS)
    + " UNION ALL SELECT sample_id, 'error', 'duplicate_cut_id', concat(cut_id, ' x', count(*)) FROM ck WHERE cut_id <> '' GROUP BY sample_id, cut_id HAVING count(*) > 1)"
)
SAMPLE_ROWS = "rws AS (SELECT sample_id, count(*) AS num_cut_lines, count_if(coalesce(confirmed, false)) AS num_confirmed FROM cut_lines GROUP BY sample_id)"
STATUS = """st AS (SELECT r.*, CASE WHEN coalesce(e, 0) > 0 THEN 'invalid' WHEN num_cut_lines = num_confirmed THEN 'complete' ELSE 'incomplete' END AS status,
  coalesce(e, 0) AS error_count, coalesce(w, 0) AS warning_count FROM rws r LEFT JOIN (SELECT sample_id, count_if(severity = 'error') AS e, count_if(severity = 'warning') AS w FROM issues GROUP BY 1) i
  ON i.sample_id = r.sample_id)"""


def sample_rows(spark, sf):
    return fx.cut_lines(spark, sf).groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("num_cut_lines"), F.count_if(F.coalesce("confirmed", F.lit(False))).alias("num_confirmed")
    )


def _status(spark, sf):
    return audit.derive_status(sample_rows(spark, sf), cut_issues(spark, sf))


def _documents(spark, sf):
    f = fx.files(spark, sf)
    docs = f.select(
        "sample_id", c("tree_id").alias("directory_tree"), c("task").alias("directory_view"),
        F.when(c("doc_id") % 31 == 0, "other").otherwise(c("tree_id")).alias("tree_id"), c("task").alias("view"),
        F.when(c("doc_id") % 37 == 0, "after").otherwise("before").alias("image_stage"),
        F.when(c("doc_id") % 41 == 0, None).otherwise(c("n_chars") % 9).alias("n_cut_lines"),
    )
    before = f.filter("quality IS NOT NULL").select("sample_id", (c("n_chars") % 3).alias("width"), F.lit(1).alias("height"))
    after = f.filter("doc_id % 7 <> 0").select("sample_id", F.lit(1).cast("long").alias("width"), F.lit(1).alias("height"))
    return audit.audit_documents(docs, before, after)


DOC_ISSUES = """SELECT sample_id, 'error' AS severity, 'tree_id_mismatch' AS code, 'other' AS detail FROM files WHERE doc_id % 31 = 0
 UNION ALL SELECT sample_id, 'error', 'invalid_stage', 'after' FROM files WHERE doc_id % 37 = 0
 UNION ALL SELECT sample_id, 'error', 'missing_or_invalid_before_image', '' FROM files WHERE quality IS NULL
 UNION ALL SELECT sample_id, 'error', 'missing_or_invalid_after_image', '' FROM files WHERE doc_id % 7 = 0
 UNION ALL SELECT sample_id, 'warning', 'image_size_mismatch', '' FROM files WHERE quality IS NOT NULL AND doc_id % 7 <> 0 AND n_chars % 3 <> 1
 UNION ALL SELECT sample_id, 'error', 'invalid_cut_lines', '' FROM files WHERE doc_id % 41 = 0
 UNION ALL SELECT sample_id, 'warning', 'empty_annotation', '' FROM files WHERE doc_id % 41 = 0 OR n_chars % 9 = 0"""

# --- run state ------------------------------------------------------------------------------------

MARK = "CASE WHEN toxic = 1 THEN 'auto_excluded' WHEN quality = 1 THEN 'complete' WHEN doc_id % 3 = 0 THEN 'manual_quality_review' ELSE 'running' END"


def mark():
    return F.when(c("toxic") == 1, "auto_excluded").when(c("quality") == 1, "complete").when(c("doc_id") % 3 == 0, "manual_quality_review").otherwise("running")


def _reconcile(spark, sf):
    f = fx.files(spark, sf)
    d = c("doc_id")
    expected = f.filter(d % 20 != 19).select("sample_id", c("sha256").alias("image_sha256"), c("sha256").alias("cut_truth_sha256"), F.lit("2.0").alias("graph_schema_version"))
    markers = f.filter("quality IS NOT NULL").select(
        "sample_id", F.when(d % 11 == 0, "x").otherwise(c("sha256")).alias("image_sha256"), c("sha256").alias("cut_truth_sha256"),
        F.when(d % 13 == 0, "1.0").otherwise("2.0").alias("graph_schema_version"), mark().alias("status"), (d % 23 == 0).alias("failed"),
    )
    graphs = f.filter(d % 9 != 0).select(
        "sample_id", F.when(d % 17 == 0, "1.0").otherwise("2.0").alias("schema_version"), (d % 19 != 0).alias("valid"), (c("n_chars") % 5).alias("n_mappings"),
        c("sha256").alias("graph_sha256"), F.when(d % 10 == 0, "y").otherwise(c("sha256")).alias("cut_truth_sha256"),
    )
    cuts = f.filter(d % 8 != 0).select("sample_id", (c("n_chars") % 10 % 5).alias("n_cuts"), F.when(d % 15 == 0, "z").otherwise(c("sha256")).alias("sha256"))
    annotations = f.filter("quality = 1").select("sample_id", F.when(d % 6 == 0, "w").otherwise(c("sha256")).alias("graph_sha256"))
    return audit.reconcile(expected, markers, graphs, cuts, annotations)


STATE = f"""s AS (SELECT *, doc_id % 20 <> 19 AS e, quality IS NOT NULL AS m, {MARK} AS st, doc_id % 9 <> 0 AS g, doc_id % 8 <> 0 AS ct FROM files),
 b AS (SELECT *, e AND m AS both_, e AND m AND st IN ('complete', 'manual_quality_review') AS an FROM s)"""
RECON = [
    ("both_ AND doc_id % 23 = 0", "stale_failure_marker"),
    ("e AND NOT m", "missing_complete_marker"),
    ("m AND NOT e", "unexpected_sample_directory"),
    ("both_ AND doc_id % 11 = 0", "marker_manifest_signature_mismatch:image_sha256"),
    ("both_ AND doc_id % 13 = 0", "marker_manifest_signature_mismatch:graph_schema_version"),
    ("both_ AND st = 'running'", "unexpected_marker_status"),
    ("both_ AND NOT ct", "missing_raw_cut_truth"),
    ("both_ AND ct AND doc_id % 15 = 0", "raw_cut_truth_hash_mismatch"),
    ("an AND NOT g", "missing_artifacts"),
    ("an AND g AND doc_id % 17 = 0", "graph_schema_mismatch"),
    ("an AND g AND doc_id % 19 = 0", "invalid_atomic_partition"),
    ("an AND g AND doc_id % 10 = 0", "graph_cut_truth_hash_mismatch"),
    ("an AND g AND n_chars % 5 <> CASE WHEN ct THEN n_chars % 10 % 5 ELSE 0 END", "cut_mapping_count_mismatch"),
    ("an AND g AND quality = 1 AND doc_id % 6 = 0", "manual_annotation_graph_hash_mismatch"),
]


def status_rows(spark, sf):
    return fx.files(spark, sf).withColumn("status", F.when(c("quality").isNull(), None).otherwise(mark()))


def _gate(spark, sf):
    f = status_rows(spark, sf)
    return audit.export_gate(f.select(
        "sample_id", c("status").alias("marker_status"),
        F.when(c("n_chars") % 4 == 0, None).when(c("n_chars") % 4 == 1, "excluded").when(c("n_chars") % 4 == 2, "in_progress").otherwise("accepted").alias("annotation_status"),
        (c("doc_id") % 19 != 0).alias("graph_valid"), (c("doc_id") % 10 != 0).alias("hashes_match"),
    ))


def _pieces(spark, sf):
    """Orders as arcs cut into lines: starts and ends follow the line number, with gaps and overlaps."""
    l = fx.lines(spark, sf)
    start = (c("l_linenumber") - 1) * 10.0
    pieces = l.select(
        c("sample_id").alias("parent_id"), c("segment_id"), start.alias("start_arc_px"),
        (start + 10.0 + c("l_discount") * 20 - c("l_tax") * 20).alias("end_arc_px"), (c("l_quantity") / 5.0).alias("length_px"),
    )
    parents = table(spark, sf, "orders").select(c("o_orderkey").alias("parent_id"), (c("o_custkey") % 60).cast("double").alias("length_px"))
    return audit.check_interval_partition(parents, pieces)


def _contract(spark, sf):
    return audit.validate_table(
        fx.lines(spark, sf).select("tree_id", "sample_id", "l_linenumber", "candidate_type", "label"),
        ["tree_id", "sample_id", "view"], ["sample_id", "l_linenumber"], {"label": [0, 1], "candidate_type": ["a--b", "b--c"]})


def _compare(spark, sf):
    l = fx.lines(spark, sf)
    a = l.select("sample_id", "segment_id", c("l_discount").alias("score"))
    b = l.filter("l_linenumber < 7 OR l_partkey % 2 = 0").select("sample_id", "segment_id", (c("l_discount") + F.when(c("l_partkey") % 9 == 0, 0.05).otherwise(0.0)).alias("score"))
    return audit.compare_rankings(a, b, ["sample_id"], "segment_id")


def _difference(spark, sf):
    l = fx.lines(spark, sf).select("sample_id", "l_linenumber", "label")
    return audit.table_difference(l, l.filter("label = 0").unionByName(l.filter("l_linenumber = 1")))


# --- review ----------------------------------------------------------------------------------------

ADJ = """adj AS (SELECT sample_id, segment_id, neighbor_id FROM (SELECT a.sample_id, a.segment_id, b.segment_id AS neighbor_id FROM lines a JOIN lines b
  ON a.sample_id = b.sample_id AND b.l_linenumber = a.l_linenumber + 1) x)"""


def neighbours(spark, sf) -> DataFrame:
    """Segments of a view whose line numbers follow each other."""
    l = fx.lines(spark, sf).select("sample_id", "segment_id", "l_linenumber")
    nxt = l.select("sample_id", (c("l_linenumber") - 1).alias("l_linenumber"), c("segment_id").alias("neighbor_id"))
    return l.join(nxt, ["sample_id", "l_linenumber"]).select("sample_id", "segment_id", "neighbor_id")


def _review(spark, sf):
    return review.build_review(fx.candidates(spark, sf), neighbours(spark, sf), 17, ("A", "B"))


TOP3 = f"""rk AS (SELECT *, row_number() OVER (PARTITION BY sample_id, model ORDER BY score DESC, segment_id) AS rank FROM candidates),
 top3 AS (SELECT * FROM rk WHERE rank <= 3)"""


def rated(spark, sf) -> DataFrame:
    """Top three per view and model with marks that follow the segment."""
    mark_of = c("sample_id") % 7 + c("rank")
    return _review(spark, sf).select(
        "sample_id", "model", c("rank").alias("model_rank"), c("panel"), c("rank").alias("display_slot"),
        (mark_of % 3 == 0).cast("int").alias("acceptable"), (mark_of % 3 == 1).cast("int").alias("harmless"),
        ((mark_of % 3 == 2) | (mark_of % 8 == 0)).cast("int").alias("harmful"),
    )


RATED = """rt AS (SELECT tree_id, sample_id, model, rank AS model_rank,
   CASE WHEN ((sample_id % 7 + rank) % 3 = 0)::INT + ((sample_id % 7 + rank) % 3 = 1)::INT + (((sample_id % 7 + rank) % 3 = 2) OR ((sample_id % 7 + rank) % 8 = 0))::INT <> 1 THEN ''
   WHEN (sample_id % 7 + rank) % 3 = 0 THEN 'acceptable' WHEN (sample_id % 7 + rank) % 3 = 1 THEN 'harmless' ELSE 'harmful' END AS category FROM top3),
 ok AS (SELECT * FROM rt WHERE category <> '')"""


def categorised(spark, sf) -> DataFrame:
    trees = table(spark, sf, "orders").select(c("o_orderkey").alias("sample_id"), c("o_custkey").alias("tree_id"))
    return review.with_category(rated(spark, sf)).filter("category <> ''").join(trees, "sample_id")


RATE_SQL = """count(*) AS recommendations, count_if(category = 'acceptable') AS acceptable, count_if(category = 'harmless') AS harmless, count_if(category = 'harmful') AS harmful"""


def _tree_rates(spark, sf):
    return review.review_rates(categorised(spark, sf), ["model", "tree_id"])


def _log(spark, sf):
    """Ratings written as one JSON object per sample and read back against the sheet."""
    sheet = review.with_category(rated(spark, sf)).select(c("sample_id").cast("string").alias("sample_id"), "panel", "display_slot", "category")
    entry = F.map_from_arrays(
        F.array(F.concat_ws("|", "sample_id", "panel", c("display_slot").cast("string"))),
        F.array(F.struct(F.when(F.length("sample_id") % 2 == 0, c("category")).otherwise(" acceptable ").alias("category"))),
    )
    states = sheet.filter("display_slot < 3 OR panel = 'Panel A'").select(F.to_json(entry).alias("scores"))
    return review.reconcile_review(review.read_log(states), sheet.filter("panel = 'Panel A' OR display_slot > 1"))


FLIP = f"({ph(17, 'sample_id')} < {MODULUS // 2})"

# --- queries ---------------------------------------------------------------------------------------

QUERIES = [
    Query("audit_cut_lines", cut_issues, fx.with_views("cut_lines", extra=ISSUES) + "SELECT * FROM issues"),
    Query("audit_documents", _documents, FILES + DOC_ISSUES),
    Query(
        "audit_duplicates", lambda s, sf: audit.audit_duplicates(fx.files(s, sf).withColumn("sample_id", c("n_chars").cast("string")), "sample_id", "sha256", 5),
        FILES + """, f AS (SELECT CAST(n_chars AS VARCHAR) AS sample_id, sha256 FROM files)
        SELECT sample_id, 'error' AS severity, 'duplicate_sample' AS code, CAST(count(*) AS VARCHAR) AS detail FROM f GROUP BY 1 HAVING count(*) > 1
        UNION ALL SELECT sample_id, 'warning', 'duplicate_json_content', sha256 FROM f WHERE sha256 IN (SELECT sha256 FROM f GROUP BY 1 HAVING count(*) > 1)
        UNION ALL SELECT '__dataset__', 'error', 'unexpected_sample_count', concat(count(*), ' != 5') FROM f HAVING count(*) <> 5""",
    ),
    Query("derive_status", _status, fx.with_views("cut_lines", extra=f"{ISSUES}, {SAMPLE_ROWS}, {STATUS}") + "SELECT * FROM st"),
    Query(
        "audit_summary", lambda s, sf: audit.audit_summary(_status(s, sf), cut_issues(s, sf)),
        fx.with_views("cut_lines", extra=f"{ISSUES}, {SAMPLE_ROWS}, {STATUS}")
        + """SELECT 'severity' AS facet, severity AS name, count(*) AS n FROM issues GROUP BY ALL UNION ALL SELECT 'code', code, count(*) FROM issues GROUP BY ALL
        UNION ALL SELECT 'status', status, count(*) FROM st GROUP BY ALL""",
    ),
    Query(
        "validate_table", _contract,
        fx.with_views("lines") + """SELECT 'missing_column:view' AS "check", 1::BIGINT AS violations UNION ALL SELECT 'null_sample_id', count_if(sample_id IS NULL) FROM lines
        UNION ALL SELECT 'null_l_linenumber', count_if(l_linenumber IS NULL) FROM lines UNION ALL SELECT 'allowed_label', 0 UNION ALL SELECT 'allowed_candidate_type', count_if(candidate_type = 'c--c') FROM lines
        UNION ALL SELECT 'duplicate_key', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM lines GROUP BY sample_id, l_linenumber) x""",
    ),
    Query(
        "reconcile", _reconcile,
        fx.with_views("files", extra=STATE) + " UNION ALL ".join(f"SELECT sample_id, '{r}' AS reason FROM b WHERE {w}" for w, r in RECON),
    ),
    Query(
        "rollup_tree_state", lambda s, sf: audit.rollup_tree_state(status_rows(s, sf)),
        FILES + f""", t AS (SELECT tree_id, bool_or(quality IS NOT NULL AND ({MARK}) IN ('complete', 'manual_quality_review')) AS a, bool_or(quality IS NOT NULL AND ({MARK}) = 'auto_excluded') AS x FROM files GROUP BY 1)
        SELECT count(*) AS trees, count_if(x) AS with_excluded_view, count_if(NOT a) AS none_annotatable, count_if(NOT x) AS all_annotatable, count_if(a AND x) AS mixed FROM t""",
    ),
    Query(
        "distribution", lambda s, sf: rounded(audit.distribution(fx.lines(s, sf), ["l_extendedprice", "l_quantity", "l_tax"])),
        fx.with_views("lines") + " UNION ALL ".join(
            f"SELECT '{m}' AS metric, count({m}) AS count, {rsql(f'min({m})', 'min')}, {rsql(f'quantile_cont({m}, 0.05)', 'p05')}, {rsql(f'quantile_cont({m}, 0.5)', 'median')}, {rsql(f'quantile_cont({m}, 0.95)', 'p95')}, {rsql(f'max({m})', 'max')} FROM lines"
            for m in ("l_extendedprice", "l_quantity", "l_tax")),
    ),
    Query(
        "export_gate", _gate,
        FILES + f""", s AS (SELECT CASE WHEN quality IS NULL THEN 'invalid:missing_complete_marker' WHEN ({MARK}) = 'auto_excluded' THEN 'auto_excluded' WHEN ({MARK}) = 'running' THEN 'invalid:unexpected_complete_marker_status'
          WHEN n_chars % 4 = 0 THEN 'missing' WHEN doc_id % 19 = 0 THEN 'invalid:graph_not_complete_or_geometry_invalid' WHEN doc_id % 10 = 0 THEN 'invalid:graph_hash_mismatch'
          WHEN n_chars % 4 = 1 THEN 'excluded' WHEN n_chars % 4 = 2 THEN 'in_progress' ELSE 'accepted' END AS state FROM files)
        SELECT state, count(*) AS samples, bool_and(state IN ('accepted', 'excluded', 'auto_excluded')) OVER () AS gate_complete FROM s GROUP BY state""".replace("bool_and(state IN ('accepted', 'excluded', 'auto_excluded')) OVER ()", "(SELECT bool_and(state IN ('accepted', 'excluded', 'auto_excluded')) FROM s)"),
    ),
    Query(
        "check_interval_partition", _pieces,
        fx.with_views("lines") + """, p AS (SELECT sample_id AS parent_id, segment_id, (l_linenumber - 1) * 10.0::DOUBLE AS a, (l_linenumber - 1) * 10.0::DOUBLE + 10.0 + l_discount * 20 - l_tax * 20 AS b, l_quantity / 5.0::DOUBLE AS len FROM lines),
        w AS (SELECT *, coalesce(greatest(max(b) OVER (PARTITION BY parent_id ORDER BY a, b, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS cur FROM p),
        s AS (SELECT o_orderkey AS parent_id, (o_custkey % 60)::DOUBLE AS ex, coalesce((SELECT sum(len) FROM p WHERE parent_id = o_orderkey), 0.0) AS ob, greatest(coalesce((SELECT max(b) FROM p WHERE parent_id = o_orderkey), 0.0), 0.0) AS cv FROM orders)
        SELECT parent_id, segment_id, 'overlap' AS kind FROM w WHERE a < cur - 0.5 UNION ALL SELECT parent_id, segment_id, 'gap' FROM w WHERE a > cur + 0.5
        UNION ALL SELECT parent_id, NULL, 'length_mismatch' FROM s WHERE abs(cv - ex) > 1 OR abs(ob - ex) > 1""",
    ),
    Query(
        "compare_rankings", lambda s, sf: rounded(_compare(s, sf)),
        fx.with_views("lines") + f""", a AS (SELECT sample_id, segment_id, l_discount AS s, row_number() OVER (PARTITION BY sample_id ORDER BY l_discount DESC, segment_id) AS r FROM lines),
        bb AS (SELECT sample_id, segment_id, l_discount + CASE WHEN l_partkey % 9 = 0 THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END AS s FROM lines WHERE l_linenumber < 7 OR l_partkey % 2 = 0),
        b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY s DESC, segment_id) AS r FROM bb),
        j AS (SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, a.s AS sa, b.s AS sb, a.r AS ra, b.r AS rb FROM a FULL JOIN b ON a.sample_id = b.sample_id AND a.segment_id = b.segment_id),
        g AS (SELECT sample_id, bool_and(sa IS NOT NULL AND sb IS NOT NULL) AS same_set, bool_and(coalesce(ra = rb, false)) AS same_order, max(abs(sa - sb)) AS d FROM j GROUP BY 1)
        SELECT sample_id, same_set, same_order, {rsql('d', 'max_abs_delta')}, same_set AND same_order AND coalesce(d, 0) <= 1e-6 AS passed FROM g""",
    ),
    Query(
        "table_difference", _difference,
        fx.with_views("lines") + """, u AS (SELECT sample_id, l_linenumber, label, 1 AS d FROM lines UNION ALL SELECT sample_id, l_linenumber, label, -1 FROM lines WHERE label = 0 UNION ALL SELECT sample_id, l_linenumber, label, -1 FROM lines WHERE l_linenumber = 1)
        SELECT sample_id, l_linenumber, label, sum(d)::BIGINT AS difference FROM u GROUP BY ALL HAVING sum(d) <> 0""",
    ),
    Query(
        "dedupe_by_content", lambda s, sf: manifest.dedupe_by_content(fx.files(s, sf).select(c("sha256").alias("digest"), "task", "source_id")),
        FILES + """SELECT sha256 AS digest, array_to_string(list_sort(list(DISTINCT task)), ';') AS tasks, min(source_id) AS first_source, count(DISTINCT source_id) AS sources, count(*) AS source_count
        FROM files GROUP BY sha256""",
    ),
    Query(
        "content_sources", lambda s, sf: manifest.content_sources(fx.files(s, sf).select(c("sha256").alias("digest"), "task", "source_id")),
        FILES + "SELECT sha256 AS digest, source_id, row_number() OVER (PARTITION BY sha256 ORDER BY source_id) AS place FROM (SELECT DISTINCT sha256, source_id FROM files) z",
    ),
    Query(
        "scan_documents", lambda s, sf: fx.files(s, sf).select("path", "n_chars", "sha256"),
        FILES + "SELECT path, n_chars, sha256 FROM files",
    ),
    Query(
        "dataset_fingerprint", lambda s, sf: manifest.dataset_fingerprint(fx.files(s, sf), ["path", "sha256"]),
        FILES + """, d AS (SELECT sha256(concat(length(path), ':', path, '|', length(sha256), ':', sha256)) AS h FROM files),
        g AS (SELECT count(*) AS rows, """ + ", ".join(f"(sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) % 4294967296)::BIGINT AS l{i}" for i in range(8))
        + " FROM d) SELECT rows, sha256(concat_ws(':', rows, " + ", ".join(f"l{i}" for i in range(8)) + ")) AS fingerprint FROM g",
    ),
    Query(
        "pending_samples",
        lambda s, sf: manifest.pending(
            fx.files(s, sf).select("sample_id", c("sha256").alias("inputs"), F.lit("v2").alias("config")),
            status_rows(s, sf).filter("quality IS NOT NULL").select("sample_id", F.when(c("doc_id") % 11 == 0, "x").otherwise(c("sha256")).alias("inputs"),
                F.when(c("doc_id") % 3 == 0, "v1").when(c("doc_id") % 3 == 1, "v0").otherwise("v2").alias("config"), F.when(c("status") == "running", "failed").otherwise(c("status")).alias("status")),
            False, ["v1"]),
        FILES + f"""SELECT sample_id, sha256 AS inputs, 'v2' AS config FROM files WHERE NOT (quality IS NOT NULL AND doc_id % 11 <> 0 AND doc_id % 3 <> 1)""",
    ),
    Query(
        "freeze_manifest",
        lambda s, sf: manifest.freeze_manifest(
            fx.files(s, sf).select("sample_id", "tree_id"), fx.files(s, sf).filter("toxic = 1"), fx.files(s, sf).filter("doc_id % 6 <> 0"), fx.files(s, sf).filter("quality IS NOT NULL")),
        FILES + """, r AS (SELECT *, CASE WHEN toxic = 1 THEN 'derived_exclusion_register' WHEN doc_id % 6 = 0 THEN 'missing_before_image' WHEN quality IS NULL THEN 'missing_cut_truth' ELSE '' END AS reason FROM files)
        SELECT sample_id, tree_id, reason = '' AS included, reason, CASE WHEN reason = '' THEN sha256 ELSE '' END AS cut_truth_sha256 FROM r""",
    ),
    Query(
        "validate_manifest",
        lambda s, sf: manifest.validate_manifest(
            fx.files(s, sf).select("path", F.when(c("doc_id") % 5 == 0, None).when(c("doc_id") % 7 == 0, "x").otherwise(c("sha256")).alias("sha256")), fx.files(s, sf).filter("doc_id % 6 <> 0")),
        FILES + """SELECT path, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN 'x' ELSE sha256 END AS sha256,
        CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS state FROM files""",
    ),
    Query(
        "merge_manifests",
        lambda s, sf: manifest.merge_manifests(
            [fx.files(s, sf).filter("doc_id % 3 = 0").select(c("path").alias("sample_name"), F.lit("first").alias("origin")),
             fx.files(s, sf).filter("doc_id % 2 = 0").select(c("path").alias("sample_name"), F.lit("second").alias("origin"))],
            fx.files(s, sf).select(c("path").alias("sample_name"))),
        FILES + "SELECT path AS sample_name, CASE WHEN doc_id % 2 = 0 THEN 'second' WHEN doc_id % 3 = 0 THEN 'first' END AS origin FROM files",
    ),
    Query(
        "pair_samples",
        lambda s, sf: manifest.pair_samples(fx.files(s, sf).filter("doc_id % 3 <> 0"), fx.files(s, sf).filter("doc_id % 5 <> 0"), fx.files(s, sf).filter("doc_id % 7 <> 0")),
        FILES + """SELECT sample_id, concat_ws(';', CASE WHEN doc_id % 3 = 0 THEN 'missing_new' END, CASE WHEN doc_id % 5 = 0 THEN 'missing_old' END, CASE WHEN doc_id % 7 = 0 THEN 'missing_image' END) AS reject_reason,
        doc_id % 3 <> 0 AND doc_id % 5 <> 0 AND doc_id % 7 <> 0 AS paired FROM files WHERE doc_id % 15 <> 0""",
    ),
    Query(
        "recover_warnings", lambda s, sf: manifest.recover_warnings(status_rows(s, sf).select("sample_id", "status"), fx.files(s, sf).filter("doc_id % 4 = 0")),
        FILES + f""", t AS (SELECT *, CASE WHEN quality IS NOT NULL THEN {MARK} END AS st FROM files)
        SELECT sample_id, CASE WHEN st = 'auto_excluded' AND doc_id % 4 <> 0 THEN 'manual_quality_review' ELSE st END AS status, CASE WHEN st = 'auto_excluded' AND doc_id % 4 <> 0 THEN 'auto_excluded' END AS legacy_status,
        CASE WHEN st = 'auto_excluded' AND doc_id % 4 = 0 THEN 'manual_annotation_already_exists' END AS error FROM t""",
    ),
    Query(
        "resolve_paths",
        lambda s, sf: manifest.resolve_paths(
            fx.files(s, sf).select(F.when(c("doc_id") % 3 == 0, c("path")).otherwise("gone").alias("image_path"), "tree_id", c("task").alias("stage"), c("sample_id").alias("view")),
            fx.files(s, sf).filter("doc_id % 4 <> 0").select("path").unionByName(fx.files(s, sf).filter("doc_id % 5 = 0").select(F.concat(F.lit("raw/"), "tree_id", F.lit("/"), "task", F.lit("/"), "sample_id", F.lit(".jpg")).alias("path"))), "raw"),
        FILES + """, u AS (SELECT *, concat('raw/', tree_id, '/', task, '/', sample_id, '.jpg') AS usual FROM files)
        SELECT CASE WHEN doc_id % 3 = 0 THEN path ELSE 'gone' END AS image_path, tree_id, task AS stage, sample_id AS view, CASE WHEN doc_id % 3 = 0 AND doc_id % 4 <> 0 THEN path WHEN doc_id % 5 = 0 THEN usual END AS resolved_path,
        NOT ((doc_id % 3 = 0 AND doc_id % 4 <> 0) OR doc_id % 5 = 0) AS rejected FROM u""",
    ),
    Query(
        "parse_sample_key",
        lambda s, sf: fx.files(s, sf).select("sample_id", parse_sample_key(F.concat(F.lit("tree_"), "sample_id",
            F.when(c("doc_id") % 3 == 0, "_before").when(c("doc_id") % 3 == 1, "_after").when(c("doc_id") % 9 == 2, "x").otherwise(""), F.lit("_view_"), (c("n_chars") % 12).cast("string"), F.lit(".jpg"))).alias("k"))
        .select("sample_id", "k.tree_id", "k.stage", "k.view_id"),
        FILES + """, z AS (SELECT *, NOT (doc_id % 9 = 2) AS ok FROM files)
        SELECT sample_id, CASE WHEN ok THEN CASE WHEN length(sample_id) >= 3 THEN sample_id ELSE lpad(sample_id, 3, '0') END END AS tree_id,
        CASE WHEN ok THEN CASE doc_id % 3 WHEN 0 THEN 'before' WHEN 1 THEN 'after' ELSE 'single' END END AS stage, CASE WHEN ok THEN lpad(CAST(n_chars % 12 AS VARCHAR), 2, '0') END AS view_id FROM z""",
    ),
    Query(
        "build_review", _review,
        fx.with_views("lines", "candidates", extra=f"{ADJ}, {TOP3}") + f""", t AS (SELECT sample_id, segment_id AS truth_id FROM candidates WHERE model = 'A' AND label = 1)
        SELECT x.sample_id, CASE WHEN {FLIP.replace('sample_id', 'x.sample_id')} = (model = 'A') THEN 'Panel A' ELSE 'Panel B' END AS panel, model, rank, x.segment_id, label::INT AS exact_truth,
        greatest(label::INT, (EXISTS (SELECT 1 FROM adj JOIN t ON t.sample_id = adj.sample_id AND t.truth_id = adj.neighbor_id WHERE adj.sample_id = x.sample_id AND adj.segment_id = x.segment_id))::INT) AS hop1_truth,
        (SELECT count(*) FROM t WHERE t.sample_id = x.sample_id) AS truth_cut_count FROM top3 x""",
    ),
    Query("reconcile_review", _log, fx.with_views("lines", "candidates", extra=f"{TOP3}, {RATED}") + f""", sh AS (SELECT CAST(sample_id AS VARCHAR) AS sample_id,
        CASE WHEN {FLIP} = (model = 'A') THEN 'Panel A' ELSE 'Panel B' END AS panel, model_rank AS display_slot, category FROM rt),
        lg AS (SELECT sample_id, panel, display_slot, CASE WHEN length(sample_id) % 2 = 0 THEN category ELSE 'acceptable' END AS lc FROM sh WHERE display_slot < 3 OR panel = 'Panel A'),
        s2 AS (SELECT * FROM sh WHERE panel = 'Panel A' OR display_slot > 1)
        SELECT coalesce(lg.sample_id, s2.sample_id) AS sample_id, coalesce(lg.panel, s2.panel) AS panel, coalesce(lg.display_slot, s2.display_slot) AS display_slot, lc AS log_category, category AS sheet_category,
        CASE WHEN category IS NULL THEN 'log_only' WHEN lc IS NULL THEN 'sheet_only' WHEN lc = category THEN 'match' ELSE 'mismatch' END AS agreement
        FROM lg FULL JOIN s2 ON lg.sample_id = s2.sample_id AND lg.panel = s2.panel AND lg.display_slot = s2.display_slot"""),
    Query(
        "review_rates", lambda s, sf: rounded(_tree_rates(s, sf)),
        fx.with_views("lines", "candidates", extra=f"{TOP3}, {RATED}") + f""", g AS (SELECT model, tree_id, {RATE_SQL} FROM ok GROUP BY ALL)
        SELECT *, {rsql('acceptable / recommendations', 'acceptable_rate')}, {rsql('harmless / recommendations', 'harmless_rate')}, {rsql('harmful / recommendations', 'harmful_rate')},
        {rsql('(acceptable + harmless) / recommendations', 'non_harmful_rate')}, (acceptable > 0)::BIGINT AS success, (acceptable + harmless > 0)::BIGINT AS non_harmful_success, (harmful > 0)::BIGINT AS any_harmful FROM g""",
    ),
    Query(
        "review_rates_by_rank", lambda s, sf: rounded(review.review_rates_by_rank(categorised(s, sf))),
        fx.with_views("lines", "candidates", extra=f"{TOP3}, {RATED}") + f""", g AS (SELECT model, model_rank, {RATE_SQL} FROM ok GROUP BY ALL),
        f AS (SELECT model, r::INT AS model_rank FROM (SELECT DISTINCT model FROM ok) m, range(1, 11) x(r))
        SELECT f.model, f.model_rank, coalesce(recommendations, 0) AS recommendations, coalesce(acceptable, 0) AS acceptable, coalesce(harmless, 0) AS harmless, coalesce(harmful, 0) AS harmful,
        {rsql('acceptable / recommendations', 'acceptable_rate')}, {rsql('harmful / recommendations', 'harmful_rate')} FROM f LEFT JOIN g ON g.model = f.model AND g.model_rank = f.model_rank""",
    ),
    Query(
        "paired_review", lambda s, sf: rounded(review.paired_review(_tree_rates(s, sf), ("A", "B"))),
        fx.with_views("lines", "candidates", extra=f"{TOP3}, {RATED}") + f""", g AS (SELECT model, tree_id, {RATE_SQL} FROM ok GROUP BY ALL)
        SELECT a.tree_id, {rsql('a.acceptable / a.recommendations - b.acceptable / b.recommendations', 'acceptable_difference')}, {rsql('a.harmful / a.recommendations - b.harmful / b.recommendations', 'harmful_difference')},
        (a.acceptable > 0)::BIGINT - (b.acceptable > 0)::BIGINT AS success_difference FROM g a JOIN g b ON a.tree_id = b.tree_id AND a.model = 'A' AND b.model = 'B'""",
    ),
    Query(
        "checked_join",
        lambda s, sf: review.checked_join(fx.lines(s, sf).select("sample_id", "segment_id"), table(s, sf, "orders").select(c("o_orderkey").alias("sample_id"), "o_orderpriority"), ["sample_id"], "many_to_one")
        .groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")),
        "SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    ),
    Query(
        "runtime_summary",
        lambda s, sf: rounded(summaries.runtime_summary(fx.lines(s, sf).select(c("l_linestatus").alias("stage"), c("l_suppkey").alias("sample_id"), (c("l_extendedprice") / 1000).alias("seconds")), 300)),
        fx.with_views("lines") + f""", p AS (SELECT l_linestatus AS stage, l_suppkey, avg(l_extendedprice / 1000) AS v, count(*) AS n FROM lines GROUP BY ALL)
        SELECT stage, count(*) AS samples, {rsql('avg(v)', 'mean')}, {rsql('stddev_samp(v)', 'sd')}, {rsql('min(v)', 'min')}, {rsql('max(v)', 'max')}, count_if(n <> 300) AS incomplete_samples, {rsql('quantile_cont(v, 0.5)', 'median')} FROM p GROUP BY stage""",
    ),
    Query(
        "summary_stats", lambda s, sf: rounded(summaries.summary_stats(fx.lines(s, sf), ["l_quantity", "l_extendedprice"])),
        fx.with_views("lines") + " UNION ALL ".join(f"SELECT '{m}' AS metric, {rsql(f'avg({m})', 'mean')}, {rsql(f'stddev_pop({m})', 'std')}, {rsql(f'min({m})', 'min')}, {rsql(f'max({m})', 'max')} FROM lines" for m in ("l_quantity", "l_extendedprice")),
    ),
    Query(
        "variant_summary",
        lambda s, sf: rounded(summaries.variant_summary(fx.candidates(s, sf).select(c("model").alias("variant"), F.concat_ws("/", c("sample_id").cast("string"), "segment_id").alias("sample_id"), "score", "prediction"), ["score", "prediction"], "A")),
        fx.with_views("candidates") + f""", l AS (SELECT model AS variant, concat(sample_id, '/', segment_id) AS k, 'score' AS metric, score AS v FROM candidates UNION ALL SELECT model, concat(sample_id, '/', segment_id), 'prediction', prediction FROM candidates)
        SELECT l.variant, l.metric, count(*) AS samples, {rsql('avg(l.v)', 'mean')}, {rsql('avg(l.v - b.v)', 'mean_delta')}, count_if(l.v - b.v > 1e-9) AS improved, count_if(l.v - b.v < -1e-9) AS degraded, count_if(abs(l.v - b.v) <= 1e-9) AS unchanged
        FROM l JOIN l b ON b.variant = 'A' AND b.k = l.k AND b.metric = l.metric GROUP BY ALL""",
    ),
    Query(
        "pooled_ratio", lambda s, sf: rounded(summaries.pooled_ratio(fx.candidates(s, sf), ["model"], "label", "prediction", "ratio")),
        fx.with_views("candidates") + f"SELECT model, {rsql('sum(label) / sum(prediction)', 'ratio')} FROM candidates GROUP BY model",
    ),
    Query(
        "direction_threshold",
        lambda s, sf: rounded(summaries.select_direction_threshold(fx.lines(s, sf).select((c("tree_id") % 5).alias("fold"), (c("l_quantity") / 50).alias("confidence"), (c("label") == 1).alias("correct")), 5, [0.18, 0.25, 0.35, 0.45, 0.55])),
        fx.with_views("lines") + f""", t AS (SELECT unnest([0.18::DOUBLE, 0.25::DOUBLE, 0.35::DOUBLE, 0.45::DOUBLE, 0.55::DOUBLE]) AS t),
        k AS (SELECT h AS held_out, t, count_if(l_quantity / 50 >= 0.18) AS base, count_if(l_quantity / 50 >= t) AS used, count_if(l_quantity / 50 >= t AND label = 1) AS good FROM lines, range(5) r(h), t WHERE tree_id % 5 <> h GROUP BY ALL),
        v AS (SELECT *, good / used AS acc, used / base AS cov, CASE WHEN used / base >= 0.5 THEN good / used ELSE good / used - (0.5 - used / base) END AS val FROM k)
        SELECT held_out, {rsql('t', 'threshold')}, {rsql('val', 'value')}, {rsql('acc', 'accuracy')}, {rsql('cov', 'coverage')} FROM (SELECT *, row_number() OVER (PARTITION BY held_out ORDER BY val DESC, acc DESC, cov DESC, t) AS r FROM v) WHERE r = 1""",
    ),
    Query(
        "aggregate_runs",
        lambda s, sf: rounded(summaries.aggregate_runs(fx.files(s, sf).select(c("task").alias("category"), (c("n_chars") % 3 == 0).alias("is_dag"), (c("n_chars") % 7 / 7.0).alias("attachment_rate"), c("n_chars").alias("buds")))),
        FILES + f"SELECT task AS category, count(*) AS samples, {rsql('avg((n_chars % 3 = 0)::INT)', 'dag_rate')}, {rsql('avg(n_chars % 7 / 7.0::DOUBLE)', 'attachment_rate_mean')}, sum(n_chars)::BIGINT AS total_buds FROM files GROUP BY ROLLUP (task)",
    ),
    Query(
        "mean_of_metrics", lambda s, sf: rounded(summaries.mean_of_metrics(fx.lines(s, sf).select("l_quantity", "l_tax", "label", "l_linestatus"))),
        fx.with_views("lines") + " UNION ALL ".join(f"SELECT '{m}' AS metric, {rsql(f'avg({m})', 'mean')} FROM lines" for m in ("l_quantity", "l_tax", "label")),
    ),
    Query(
        "routing_health",
        lambda s, sf: rounded(summaries.routing_health(fx.candidates(s, sf).groupBy("sample_id").agg(F.count_if(c("prediction") == 1).alias("routed"), F.count_if(c("prediction") == 0).alias("skipped"), F.count_if((c("label") == 1) & (c("score") > 0.9)).alias("trunk_fork_nodes")))),
        fx.with_views("candidates") + f"""SELECT sample_id, {rsql('count_if(prediction = 1) / count(*)', 'success_rate')}, count_if(label = 1 AND score > 0.9) AS trunk_fork_nodes, count_if(label = 1 AND score > 0.9) = 0 AS single_trunk_path FROM candidates GROUP BY 1""",
    ),
]


def _routing(s, sf):
    g = fx.strokes(s, sf).select("sample_id", F.concat_ws("_root_", (c("k") % 12).cast("string"), (c("k") % 3).cast("string")).alias("group_id"), "k", F.floor(c("x0") / 24).alias("x"), F.floor(c("y0") / 40).alias("y"))
    e = g.select("sample_id", c("x").alias("x0"), c("y").alias("y0"), (c("x") + c("k") % 2).alias("x1"), (c("y") + 1).alias("y1"))
    return audit.routing_quality(g.select("sample_id", "group_id"), e, g, 8)


ROUTE = """g AS (SELECT sample_id, k, concat(k % 12, '_root_', k % 3) AS group_id, CAST(k % 12 AS VARCHAR) AS fam, floor(x0 / 24)::BIGINT AS x, floor(y0 / 40)::BIGINT AS y FROM strokes),
 e AS (SELECT sample_id, x AS x0, y AS y0, x + k % 2 AS x1, y + 1 AS y1 FROM g)"""


def _undeclared(s, sf):
    g = fx.strokes(s, sf).select("sample_id", "k", F.floor(c("x0") / 48).alias("x"), F.floor(c("y0") / 80).alias("y"))
    e = g.select("sample_id", "k", c("x").alias("x0"), c("y").alias("y0"), (c("x") + 1).alias("x1"), (c("y") + 1).alias("y1"))
    return audit.undeclared_duplicate_edges(e.drop("k"), e.filter("k % 4 = 0").withColumn("corridor_id", c("k") % 3))


def _hierarchy(s, sf):
    kind = F.when(c("k") % 10 == 0, "trunk").when(c("k") % 3 == 0, "secondary_branch").otherwise("branch")
    return audit.hierarchy_audit(fx.strokes(s, sf).select("sample_id", kind.alias("group_type"), F.when(c("k") % 2 == 0, "p").alias("parent_group_id")))


def _rulebook(s, sf):
    p = table(s, sf, "part").select(c("p_brand").alias("section"), c("p_type").alias("field"), c("p_name").alias("statistic"), "p_retailprice")
    rows = p.groupBy("section", "field", "statistic").agg(F.max("p_retailprice").cast("string").alias("value"))
    return rounded(audit.load_rulebook(rows.withColumns({"samples_total": F.lit(100), "samples_valid": F.lit(99)}), 100, 99))


QUERIES += [
    Query("routing_quality", _routing,
          fx.with_views("strokes", extra=ROUTE) + """, d AS (SELECT sample_id, sum(n - 1)::BIGINT AS v FROM (SELECT sample_id, count(*) AS n FROM e GROUP BY sample_id, x0, y0, x1, y1) q WHERE n > 1 GROUP BY 1),
          s AS (SELECT sample_id, count(*) AS v FROM (SELECT sample_id FROM g GROUP BY sample_id, x, y HAVING count(DISTINCT group_id) > 1) q GROUP BY 1), f AS (SELECT sample_id, count(*) AS v FROM (SELECT sample_id FROM g GROUP BY sample_id, fam HAVING count(*) > 8) q GROUP BY 1),
          a AS (SELECT DISTINCT sample_id FROM g) SELECT a.sample_id, coalesce(d.v, 0) AS duplicate_edges, coalesce(s.v, 0) AS shared_points, coalesce(f.v, 0) AS oversize_families, coalesce(d.v, 0) = 0 AND coalesce(f.v, 0) = 0 AS passed
          FROM a LEFT JOIN d USING (sample_id) LEFT JOIN s USING (sample_id) LEFT JOIN f USING (sample_id)"""),
    Query("undeclared_duplicate_edges", _undeclared,
          fx.with_views("strokes") + """, e AS (SELECT sample_id, k, floor(x0 / 48)::BIGINT AS x0, floor(y0 / 80)::BIGINT AS y0 FROM strokes), c AS (SELECT sample_id, x0, y0, count(*) AS copies, count(DISTINCT CASE WHEN k % 4 = 0 THEN k % 3 END) AS corridors FROM e GROUP BY ALL)
          SELECT sample_id, x0, y0, x0 + 1 AS x1, y0 + 1 AS y1, copies, corridors FROM c WHERE copies > 1 AND corridors <> 1"""),
    Query("hierarchy_audit", _hierarchy,
          fx.with_views("strokes") + """SELECT sample_id, count(*) AS groups, count_if(k % 10 = 0) AS trunks, count_if(k % 10 <> 0 AND k % 3 <> 0) AS branches, count_if(k % 10 <> 0 AND k % 3 = 0) AS secondary_branches,
          count_if(k % 10 <> 0 AND k % 3 = 0 AND k % 2 <> 0) AS orphan_secondary FROM strokes GROUP BY 1"""),
    Query("load_rulebook", _rulebook, f"SELECT p_brand AS section, p_type AS field, p_name AS statistic, {rsql('max(p_retailprice)', 'value')} FROM part GROUP BY ALL"),
]
