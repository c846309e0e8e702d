"""Manifests: inventories, content identity, resume, freeze and merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stemweave.plans.skew import attach_groups, grouped_rank

DONE_STATES = ("complete", "auto_excluded", "manual_quality_review")


def dedupe_by_content(files: DataFrame) -> DataFrame:
    """One row per content: its sorted tasks, first source, numbers of sources and of records.

    ``files(digest, task, source_id)``; task names are a closed vocabulary. The sources themselves
    are rows of ``content_sources``, as their number grows with the data.
    """
    return files.groupBy("digest").agg(
        F.array_join(F.sort_array(F.collect_set("task")), ";").alias("tasks"), F.min("source_id").alias("first_source"),
        F.count_distinct("source_id").alias("sources"), F.count(F.lit(1)).alias("source_count"),
    )


def content_sources(files: DataFrame) -> DataFrame:
    """(digest, source_id, place): the sources of each content in order, one row each."""
    sources = files.select("digest", "source_id").distinct()
    return grouped_rank(sources, ["digest"], [F.col("source_id")], "place")


def row_text(columns: Sequence[str]) -> Column:
    """Unambiguous text of a row: lengths before values, a mark for null."""
    cells = []
    for c in columns:
        v = F.col(c).cast("string")
        cells.append(F.coalesce(F.concat(F.length(v).cast("string"), F.lit(":"), v), F.lit("-")))
    return F.concat_ws("|", *cells)


def dataset_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Row count and a digest that does not depend on row order or partitioning.

    Eight 32-bit lanes of every row's SHA-256 are summed and the sums hashed, so rows are never
    gathered; it finds drift, it is not a defence against someone who picks rows to collide.
    """
    digest = F.sha2(row_text(columns), 256)
    lanes = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"l{i}") for i in range(8)]
    sums = df.select(*lanes).agg(F.count(F.lit(1)).alias("rows"), *[(F.coalesce(F.sum(f"l{i}"), F.lit(0)) % F.lit(2**32)).alias(f"l{i}") for i in range(8)])
    text = F.concat_ws(":", F.col("rows").cast("string"), *[F.col(f"l{i}").cast("string") for i in range(8)])
    return sums.select("rows", F.sha2(text, 256).alias("fingerprint"))


def pending(manifest: DataFrame, done: DataFrame, retry_failed: bool = False, legacy_config: Sequence[str] = ()) -> DataFrame:
    """Samples whose stored signature does not cover the current one.

    ``manifest(sample_id, inputs, config)`` and ``done(sample_id, inputs, config, status)``. A
    finished sample with equal inputs also counts when only its config hash is a listed old one.
    Failed samples are left out unless they are to be retried.
    """
    d = done.select("sample_id", F.col("inputs").alias("_i"), F.col("config").alias("_c"), "status")
    same = F.col("inputs").eqNullSafe(F.col("_i"))
    config = F.col("config").eqNullSafe(F.col("_c"))
    if legacy_config:
        config = config | F.coalesce(F.col("_c").isin(list(legacy_config)), F.lit(False))
    finished = F.coalesce(F.col("status").isin(*DONE_STATES), F.lit(False)) & same & config
    skip = finished if retry_failed else finished | (F.coalesce(F.col("status") == "failed", F.lit(False)) & same & config)
    return manifest.join(d, "sample_id", "left").filter(~skip).select(*manifest.columns)


def freeze_manifest(source: DataFrame, exclusions: DataFrame, images: DataFrame, truths: DataFrame) -> DataFrame:
    """Every row with whether it is in and, if not, the first reason that applies.

    ``exclusions``, ``images`` and ``truths`` are keyed by ``sample_id``; truths carry ``sha256``.
    """
    x = exclusions.select("sample_id").distinct().withColumn("_x", F.lit(True))
    i = images.select("sample_id").distinct().withColumn("_i", F.lit(True))
    t = truths.select("sample_id", F.col("sha256").alias("_t"))
    joined = source.join(x, "sample_id", "left").join(i, "sample_id", "left").join(t, "sample_id", "left")
    reason = (
        F.when(F.col("_x").isNotNull(), "derived_exclusion_register")
        .when(F.col("_i").isNull(), "missing_before_image")
        .when(F.col("_t").isNull(), "missing_cut_truth")
    )
    return joined.select(
        *source.columns, reason.isNull().alias("included"), F.coalesce(reason, F.lit("")).alias("reason"),
        F.when(reason.isNull(), F.col("_t")).otherwise("").alias("cut_truth_sha256"),
    )


def validate_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Existence and hash of every listed file: missing, hash_mismatch or ok."""
    f = files.select("path", F.col("sha256").alias("_found"))
    state = F.when(F.col("_found").isNull(), "missing").when(
        F.col("sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("_found")), "hash_mismatch"
    ).otherwise("ok")
    return manifest.join(f, "path", "left").select(*manifest.columns, state.alias("state"))


def merge_manifests(parts: Sequence[DataFrame], listing: DataFrame | None = None, name: str = "sample_name") -> DataFrame:
    """Rows of the last manifest that names a sample; samples only found in ``listing`` are added.

    Manifests hold one row per name, so the last one wins by an aggregate over at most
    ``len(parts)`` rows of a name.
    """
    columns = parts[0].columns
    tagged = None
    for order, part in enumerate(parts):
        p = part.select(*columns).withColumn("_order", F.lit(order))
        tagged = p if tagged is None else tagged.unionByName(p)
    rest = [c for c in columns if c != name]
    merged = tagged.groupBy(name).agg(F.max_by(F.struct(*rest), "_order").alias("r")).select(name, *[F.col(f"r.{c}").alias(c) for c in rest])
    merged = merged.select(*columns)
    if listing is None:
        return merged
    return merged.unionByName(listing.select(name).distinct().join(merged.select(name), name, "left_anti"), allowMissingColumns=True)


def pair_samples(new: DataFrame, old: DataFrame, images: DataFrame) -> DataFrame:
    """Both annotation versions and the image of every sample, with what is missing."""
    flag = lambda df, n: df.select("sample_id").distinct().withColumn(n, F.lit(True))
    joined = flag(new, "new").join(flag(old, "old"), "sample_id", "full").join(flag(images, "image"), "sample_id", "left")
    absent = F.concat_ws(";", *[F.when(F.col(n).isNull(), F.lit(f"missing_{n}")) for n in ("new", "old", "image")])
    return joined.select("sample_id", absent.alias("reject_reason"), (absent == "").alias("paired"))


def recover_warnings(status: DataFrame, annotations: DataFrame) -> DataFrame:
    """auto_excluded becomes manual_quality_review where nobody has annotated the sample yet."""
    done = annotations.select("sample_id").distinct().withColumn("_a", F.lit(True))
    excluded = F.col("status") == "auto_excluded"
    joined = status.join(done, "sample_id", "left")
    return joined.select(
        "sample_id",
        F.when(excluded & F.col("_a").isNull(), "manual_quality_review").otherwise(F.col("status")).alias("status"),
        F.when(excluded & F.col("_a").isNull(), "auto_excluded").alias("legacy_status"),
        F.when(excluded & F.col("_a").isNotNull(), "manual_annotation_already_exists").alias("error"),
    )


def resolve_paths(df: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """The stored path if the file is there, else tree/stage/view below ``root``, else a reject."""
    known = files.select(F.col("path").alias("_p")).distinct()
    usual = F.concat_ws("/", F.lit(root), "tree_id", "stage", F.concat("view", F.lit(".jpg")))
    first = df.join(known.select(F.col("_p").alias("image_path"), F.lit(True).alias("_first")), "image_path", "left").withColumn("_usual", usual)
    second = first.join(known.select(F.col("_p").alias("_usual"), F.lit(True).alias("_second")), "_usual", "left")
    path = F.when(F.col("_first").isNotNull(), F.col("image_path")).when(F.col("_second").isNotNull(), F.col("_usual"))
    return second.select(*df.columns, path.alias("resolved_path"), path.isNull().alias("rejected"))
