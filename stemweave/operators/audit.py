"""Audits: rules on rows, across files, between pipelines and their manifests."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stemweave.functions.keys import is_pair
from stemweave.operators.issues import issue_rows, rule
from stemweave.plans.skew import attach_groups, attach_scalars, exact_quantiles, running_totals

UNIT_TOLERANCE = 1e-3


def _at(pair: str, i: int) -> Column:
    return F.get(F.col(pair), F.lit(i))


def audit_cut_lines(cuts: DataFrame, images: DataFrame, allow_unconfirmed: bool = False) -> DataFrame:
    """Rules on single cut lines.

    ``cuts(sample_id, cut_id, p0, p1, normal_pruned_side, normal_retained_side, confirmed)``,
    ``images(sample_id, width, height)`` with one row per sample. A line without usable end points
    is reported once and not examined further. A repeated id is reported once per extra copy count.
    """
    seen = cuts.select("sample_id", "cut_id", "p0", "p1", "normal_pruned_side", "normal_retained_side", "confirmed")
    joined = attach_groups(seen, images.select("sample_id", "width", "height"), ["sample_id"], "left")
    points = is_pair(F.col("p0")) & is_pair(F.col("p1"))
    pruned, retained = is_pair(F.col("normal_pruned_side")), is_pair(F.col("normal_retained_side"))
    norm = F.hypot(_at("normal_pruned_side", 0), _at("normal_pruned_side", 1))
    opposite = (
        (F.abs(_at("normal_pruned_side", 0) + _at("normal_retained_side", 0)) <= UNIT_TOLERANCE)
        & (F.abs(_at("normal_pruned_side", 1) + _at("normal_retained_side", 1)) <= UNIT_TOLERANCE)
    )

    def outside(p: str) -> Column:
        x, y = _at(p, 0), _at(p, 1)
        return F.col("width").isNotNull() & ~((x >= 0) & (x < F.col("width")) & (y >= 0) & (y < F.col("height")))

    cut = F.col("cut_id")
    rules = [
        rule(F.coalesce(cut, F.lit("")) == "", "error", "missing_cut_id"),
        rule(~points, "error", "invalid_endpoint", cut),
        rule(points & (_at("p0", 0) == _at("p1", 0)) & (_at("p0", 1) == _at("p1", 1)), "error", "zero_length_cut", cut),
        rule(points & outside("p0"), "error", "coordinate_out_of_bounds", F.concat(cut, F.lit(".p0"))),
        rule(points & outside("p1"), "error", "coordinate_out_of_bounds", F.concat(cut, F.lit(".p1"))),
        rule(points & ~pruned, "error", "invalid_pruned_normal", cut),
        rule(points & pruned & (F.abs(norm - 1.0) > UNIT_TOLERANCE), "error", "non_unit_pruned_normal", cut),
        rule(points & ~retained, "error", "invalid_retained_normal", cut),
        rule(points & pruned & retained & ~opposite, "error", "normal_direction_mismatch", cut),
        rule(points & F.col("confirmed").isNull(), "error", "invalid_confirmed_value", cut),
    ]
    if not allow_unconfirmed:
        rules.append(rule(points & (F.col("confirmed") == F.lit(False)), "error", "unconfirmed_cut", cut))
    repeated = (
        cuts.filter(F.coalesce(cut, F.lit("")) != "").groupBy("sample_id", "cut_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    )
    return issue_rows(joined, "sample_id", rules).unionByName(
        issue_rows(repeated, "sample_id", [rule(F.lit(True), "error", "duplicate_cut_id", F.concat_ws(" x", cut, F.col("n").cast("string")))])
    )


def audit_documents(docs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Rules on annotation documents: names, stage, image pair, empty list.

    ``docs(sample_id, directory_tree, directory_view, tree_id, view, image_stage, n_cut_lines)``;
    images have ``(sample_id, width, height)``.
    """
    b = before.select("sample_id", F.col("width").alias("bw"), F.col("height").alias("bh"))
    a = after.select("sample_id", F.col("width").alias("aw"), F.col("height").alias("ah"))
    joined = docs.join(b, "sample_id", "left").join(a, "sample_id", "left")
    differ = (F.col("bw") != F.col("aw")) | (F.col("bh") != F.col("ah"))
    return issue_rows(joined, "sample_id", [
        rule(~F.col("tree_id").eqNullSafe(F.col("directory_tree")), "error", "tree_id_mismatch", F.col("tree_id")),
        rule(~F.col("view").eqNullSafe(F.col("directory_view")), "error", "view_mismatch", F.col("view")),
        rule(~F.col("image_stage").eqNullSafe(F.lit("before")), "error", "invalid_stage", F.col("image_stage")),
        rule(F.col("bw").isNull(), "error", "missing_or_invalid_before_image"),
        rule(F.col("aw").isNull(), "error", "missing_or_invalid_after_image"),
        rule(differ, "warning", "image_size_mismatch"),
        rule(F.col("n_cut_lines").isNull(), "error", "invalid_cut_lines"),
        rule(F.coalesce(F.col("n_cut_lines"), F.lit(0)) == 0, "warning", "empty_annotation"),
    ])


def audit_duplicates(df: DataFrame, key: str, digest: str, expected: int | None = None) -> DataFrame:
    """Repeated samples, repeated contents (one issue per row of the content) and the row count."""
    repeated = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    issues = issue_rows(repeated, F.col(key).cast("string"), [rule(F.lit(True), "error", "duplicate_sample", F.col("n"))])
    copies = df.filter(F.coalesce(F.col(digest), F.lit("")) != "").groupBy(digest).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = attach_groups(df.select(key, digest), copies, [digest])
    issues = issues.unionByName(
        issue_rows(shared, F.col(key).cast("string"), [rule(F.lit(True), "warning", "duplicate_json_content", F.col(digest))])
    )
    if expected is not None:
        total = df.agg(F.count(F.lit(1)).alias("n"))
        issues = issues.unionByName(issue_rows(total, F.lit("__dataset__"), [
            rule(F.col("n") != expected, "error", "unexpected_sample_count", F.concat_ws(" != ", F.col("n").cast("string"), F.lit(str(expected))))
        ]))
    return issues


def derive_status(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """invalid with any error, complete when every line is confirmed, else incomplete.

    ``rows(sample_id, num_cut_lines, num_confirmed)``.
    """
    counts = issues.groupBy("sample_id").agg(
        F.count_if(F.col("severity") == "error").alias("error_count"), F.count_if(F.col("severity") == "warning").alias("warning_count")
    )
    errors = F.coalesce(F.col("error_count"), F.lit(0))
    status = F.when(errors > 0, "invalid").when(F.col("num_confirmed") == F.col("num_cut_lines"), "complete").otherwise("incomplete")
    return rows.join(counts, "sample_id", "left").select(
        *rows.columns, status.alias("status"), errors.alias("error_count"), F.coalesce("warning_count", F.lit(0)).alias("warning_count")
    )


def audit_summary(rows: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts by severity, code and status, as (facet, name, n)."""
    by = lambda df, c: df.groupBy(F.lit(c).alias("facet"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return by(issues, "severity").unionByName(by(issues, "code")).unionByName(by(rows, "status"))


def validate_table(df: DataFrame, required: Sequence[str], key: Sequence[str], allowed: Mapping[str, Sequence]) -> DataFrame:
    """Contract of a table in one pass plus one key count: (check, violations)."""
    missing = [c for c in required if c not in df.columns]
    checks = [F.struct(F.lit(f"missing_column:{c}").alias("check"), F.lit(1).cast("long").alias("violations")) for c in missing]
    present = [c for c in key if c in df.columns]
    aggs = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in present]
    aggs += [F.count_if(~F.coalesce(F.col(c).isin(list(v)), F.lit(False))).alias(f"allowed_{c}") for c, v in allowed.items() if c in df.columns]
    one = df.agg(*aggs)
    copies = df.groupBy(*present).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_key"))
    rows = attach_scalars(one, copies)
    checks += [F.struct(F.lit(c).alias("check"), F.col(c).alias("violations")) for c in rows.columns]
    return rows.select(F.explode(F.array(*checks)).alias("c")).select("c.*")


SIGNATURE_FIELDS = ("image_sha256", "cut_truth_sha256", "graph_schema_version")
FINAL_STATES = ("complete", "manual_quality_review", "auto_excluded")


def reconcile(manifest: DataFrame, markers: DataFrame, graphs: DataFrame, cuts: DataFrame, annotations: DataFrame, schema_version: str = "2.0") -> DataFrame:
    """Differences between what a run should have produced and what is there: (sample_id, reason).

    All inputs have one row per ``sample_id``: ``manifest`` and ``markers`` carry the signature
    fields, ``markers`` also ``status`` and ``failed``; ``graphs(schema_version, valid, n_mappings,
    graph_sha256, cut_truth_sha256)``, ``cuts(n_cuts, sha256)``, ``annotations(graph_sha256)``.
    """
    def prefixed(df: DataFrame, p: str) -> DataFrame:
        return df.select("sample_id", F.lit(True).alias(f"{p}_here"), *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "sample_id"])

    joined = prefixed(manifest, "e")
    for df, p in ((markers, "m"), (graphs, "g"), (cuts, "c"), (annotations, "a")):
        joined = joined.join(prefixed(df, p), "sample_id", "full" if p == "m" else "left")
    c = F.col
    expected, marked = c("e_here").isNotNull(), c("m_here").isNotNull()
    both = expected & marked
    annotatable = both & c("m_status").isin("complete", "manual_quality_review")
    graph = annotatable & c("g_here").isNotNull()
    reason = lambda cond, text: F.when(cond, F.lit(text))
    reasons = [
        reason(expected & F.coalesce(c("m_failed"), F.lit(False)), "stale_failure_marker"),
        reason(expected & ~marked, "missing_complete_marker"),
        reason(marked & ~expected, "unexpected_sample_directory"),
        *[
            reason(both & ~c(f"m_{f}").eqNullSafe(c(f"e_{f}")), f"marker_manifest_signature_mismatch:{f}")
            for f in SIGNATURE_FIELDS
        ],
        reason(both & ~F.coalesce(c("m_status").isin(*FINAL_STATES), F.lit(False)), "unexpected_marker_status"),
        reason(both & c("c_here").isNull(), "missing_raw_cut_truth"),
        reason(both & c("c_here").isNotNull() & ~c("c_sha256").eqNullSafe(c("m_cut_truth_sha256")), "raw_cut_truth_hash_mismatch"),
        reason(annotatable & c("g_here").isNull(), "missing_artifacts"),
        reason(graph & ~c("g_schema_version").eqNullSafe(F.lit(schema_version)), "graph_schema_mismatch"),
        reason(graph & ~F.coalesce(c("g_valid"), F.lit(False)), "invalid_atomic_partition"),
        reason(graph & ~c("g_cut_truth_sha256").eqNullSafe(c("m_cut_truth_sha256")), "graph_cut_truth_hash_mismatch"),
        reason(graph & (c("g_n_mappings") != F.coalesce(c("c_n_cuts"), F.lit(0))), "cut_mapping_count_mismatch"),
        reason(graph & c("a_here").isNotNull() & ~c("a_graph_sha256").eqNullSafe(c("g_graph_sha256")), "manual_annotation_graph_hash_mismatch"),
    ]
    return joined.select("sample_id", F.explode(F.array_compact(F.array(*reasons))).alias("reason"))


def rollup_tree_state(status: DataFrame) -> DataFrame:
    """Trees with any excluded view, none annotatable, all annotatable, and mixed."""
    per_tree = status.groupBy("tree_id").agg(
        F.bool_or(F.coalesce(F.col("status").isin("complete", "manual_quality_review"), F.lit(False))).alias("some"),
        F.bool_or(F.coalesce(F.col("status") == "auto_excluded", F.lit(False))).alias("excluded"),
    )
    return per_tree.agg(
        F.count(F.lit(1)).alias("trees"),
        F.count_if("excluded").alias("with_excluded_view"),
        F.count_if(~F.col("some")).alias("none_annotatable"),
        F.count_if(~F.col("excluded")).alias("all_annotatable"),
        F.count_if(F.col("some") & F.col("excluded")).alias("mixed"),
    )


def distribution(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, min, p05, median, p95 and max of columns in long form."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])).alias("m")).select("m.*")
    counts = long.filter("value IS NOT NULL").groupBy("metric", "value").agg(F.count(F.lit(1)).alias("n"))
    quantiles = exact_quantiles(counts, ["metric"], "value", [0.0, 0.05, 0.5, 0.95, 1.0], "q", weight="n")
    pick = lambda p, name: F.max(F.when(F.col("prob") == p, F.col("q"))).alias(name)
    wide = quantiles.groupBy("metric").agg(pick(0.0, "min"), pick(0.05, "p05"), pick(0.5, "median"), pick(0.95, "p95"), pick(1.0, "max"))
    return counts.groupBy("metric").agg(F.sum("n").alias("count")).join(wide, "metric")


def export_gate(samples: DataFrame) -> DataFrame:
    """Classify every expected sample and open the gate only when nothing is open or broken.

    ``samples(sample_id, marker_status, annotation_status, graph_valid, hashes_match)`` has one row
    per expected sample, nulls where the part is missing. Returns one row per class with the gate.
    """
    c = F.col
    state = (
        F.when(c("marker_status").isNull(), "invalid:missing_complete_marker")
        .when(c("marker_status") == "auto_excluded", "auto_excluded")
        .when(~c("marker_status").isin("complete", "manual_quality_review"), "invalid:unexpected_complete_marker_status")
        .when(c("annotation_status").isNull(), "missing")
        .when(~F.coalesce(c("graph_valid"), F.lit(False)), "invalid:graph_not_complete_or_geometry_invalid")
        .when(~F.coalesce(c("hashes_match"), F.lit(False)), "invalid:graph_hash_mismatch")
        .otherwise(c("annotation_status"))
    )
    counts = samples.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("samples"))
    closed = F.col("state").isin("accepted", "excluded", "auto_excluded")
    gate = counts.agg(F.coalesce(F.bool_and(closed), F.lit(True)).alias("gate_complete"))
    return attach_scalars(counts, gate)


def check_interval_partition(parents: DataFrame, pieces: DataFrame, gap: float = 0.5, mismatch: float = 1.0) -> DataFrame:
    """Overlaps, gaps and length errors of pieces against the arc of their parent.

    ``parents(parent_id, length_px)``, ``pieces(parent_id, segment_id, start_arc_px, end_arc_px, length_px)``.
    The furthest end so far is a running maximum over the pieces in arc order.
    """
    order = [F.col("start_arc_px"), F.col("end_arc_px"), F.col("segment_id")]
    reached = running_totals(pieces, ["parent_id"], order, {"_reached": F.col("end_arc_px")}, exclusive=True, running="max")
    walked = reached.withColumn("cursor", F.greatest(F.col("_reached"), F.lit(0.0)))
    start = F.col("start_arc_px")
    kinds = F.array_compact(F.array(F.when(start < F.col("cursor") - gap, F.lit("overlap")), F.when(start > F.col("cursor") + gap, F.lit("gap"))))
    local = walked.select("parent_id", F.col("segment_id").cast("string").alias("segment_id"), F.explode(kinds).alias("kind"))
    sums = pieces.groupBy("parent_id").agg(F.sum("length_px").alias("observed"), F.max("end_arc_px").alias("covered"))
    observed, covered = F.coalesce("observed", F.lit(0.0)), F.greatest(F.coalesce("covered", F.lit(0.0)), F.lit(0.0))
    bad = (F.abs(covered - F.col("length_px")) > mismatch) | (F.abs(observed - F.col("length_px")) > mismatch)
    whole = parents.join(sums, "parent_id", "left").filter(bad).select("parent_id", F.lit(None).cast("string").alias("segment_id"), F.lit("length_mismatch").alias("kind"))
    return local.unionByName(whole)


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows whose number of copies differs, with the signed difference; empty when equal."""
    signed = a.withColumn("_d", F.lit(1)).unionByName(b.withColumn("_d", F.lit(-1)))
    return signed.groupBy(*a.columns).agg(F.sum("_d").alias("difference")).filter("difference <> 0")


def compare_rankings(a: DataFrame, b: DataFrame, keys: Sequence[str], item: str, atol: float = 1e-6) -> DataFrame:
    """Per key: same items, same order, largest score difference, and whether the gate opens.

    The order is the same when the rank of every item is the same in both runs.
    """
    def ranked(df: DataFrame, name: str) -> DataFrame:
        r = running_totals(df.select(*keys, item, "score"), keys, [F.col("score").desc(), F.col(item)], {"r": F.lit(1).cast("long")})
        return r.select(*keys, item, F.col("score").alias(f"s_{name}"), F.col("r").alias(f"r_{name}"))

    joined = ranked(a, "a").join(ranked(b, "b"), [*keys, item], "full")
    inside = F.col("s_a").isNotNull() & F.col("s_b").isNotNull()
    result = joined.groupBy(*keys).agg(
        F.bool_and(inside).alias("same_set"),
        F.bool_and(F.coalesce(F.col("r_a") == F.col("r_b"), F.lit(False))).alias("same_order"),
        F.max(F.abs(F.col("s_a") - F.col("s_b"))).alias("max_abs_delta"),
    )
    return result.withColumn("passed", F.col("same_set") & F.col("same_order") & (F.coalesce("max_abs_delta", F.lit(0.0)) <= atol))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected form: the smaller end point first."""
    a = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"))
    b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return edges.withColumn("_lo", F.least(a, b)).withColumn("_hi", F.greatest(a, b))


def routing_quality(groups: DataFrame, edges: DataFrame, points: DataFrame, max_family: int = 3) -> DataFrame:
    """Duplicate physical edges, points shared by groups and oversize root families per sample."""
    physical = canonical_edges(edges).groupBy("sample_id", "_lo", "_hi").agg(F.count(F.lit(1)).alias("n"))
    duplicates = physical.filter("n > 1").groupBy("sample_id").agg(F.sum(F.col("n") - 1).alias("duplicate_edges"))
    owners = points.groupBy("sample_id", "x", "y").agg(F.min("group_id").alias("lo"), F.max("group_id").alias("hi"))
    shared = owners.filter("lo <> hi").groupBy("sample_id").agg(F.count(F.lit(1)).alias("shared_points"))
    family = groups.groupBy("sample_id", F.element_at(F.split("group_id", "_root_"), 1).alias("family")).agg(F.count(F.lit(1)).alias("n"))
    big = family.filter(F.col("n") > max_family).groupBy("sample_id").agg(F.count(F.lit(1)).alias("oversize_families"))
    joined = groups.select("sample_id").distinct()
    names = ["duplicate_edges", "shared_points", "oversize_families"]
    for part in (duplicates, shared, big):
        joined = joined.join(part, "sample_id", "left")
    joined = joined.select("sample_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    return joined.withColumn("passed", (F.col("duplicate_edges") == 0) & (F.col("oversize_families") == 0))


def undeclared_duplicate_edges(edges: DataFrame, corridors: DataFrame) -> DataFrame:
    """Duplicate physical edges that no or several declared corridors cover.

    ``corridors(sample_id, x0, y0, x1, y1, corridor_id)`` lists the declared shared edges.
    """
    physical = canonical_edges(edges).groupBy("sample_id", "_lo", "_hi").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    declared = canonical_edges(corridors).groupBy("sample_id", "_lo", "_hi").agg(F.count_distinct("corridor_id").alias("corridors"))
    joined = physical.join(declared, ["sample_id", "_lo", "_hi"], "left")
    return joined.filter(F.coalesce("corridors", F.lit(0)) != 1).select(
        "sample_id", F.col("_lo.x").alias("x0"), F.col("_lo.y").alias("y0"), F.col("_hi.x").alias("x1"), F.col("_hi.y").alias("y1"), "copies",
        F.coalesce("corridors", F.lit(0)).alias("corridors"),
    )


def hierarchy_audit(groups: DataFrame) -> DataFrame:
    """Counts of trunks, branches, secondary branches and orphans per sample."""
    kind = F.col("group_type")
    orphan = (kind == "secondary_branch") & F.col("parent_group_id").isNull()
    return groups.groupBy("sample_id").agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if(kind == "trunk").alias("trunks"),
        F.count_if(kind == "branch").alias("branches"),
        F.count_if(kind == "secondary_branch").alias("secondary_branches"),
        F.count_if(orphan).alias("orphan_secondary"),
    )


def load_rulebook(df: DataFrame, total: int, valid: int) -> DataFrame:
    """Long rulebook ``(section, field, statistic, value)`` after its contract is met.

    The input holds one row per number with ``samples_total`` and ``samples_valid`` repeated; a
    wrong sample count or a leaf that is not a number stops the job when the plan runs.
    """
    bad_count = (F.col("samples_total") != total) | (F.col("samples_valid") != valid)
    number = F.col("value").try_cast(T.DoubleType())
    checked = F.when(bad_count, F.raise_error(F.lit("rulebook sample counts differ")).cast("double")).when(
        number.isNull(), F.raise_error(F.concat(F.lit("not a number: "), "section", F.lit("."), "field")).cast("double")
    ).otherwise(number)
    return df.select("section", "field", "statistic", checked.alias("value"))
