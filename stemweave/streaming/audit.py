"""Audit of annotation files as they arrive; a restart goes on where it stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemweave.operators.audit import audit_cut_lines
from stemweave.sources.annotations import CUT, CUT_FILE


def audit_stream(spark: SparkSession, incoming: str, images: DataFrame, issues_path: str, checkpoint: str):
    """Audit every new file content once and append its issues; stops when nothing is left.

    The file source remembers the files it has seen, ``dropDuplicates`` the contents by SHA-256 of all
    fields: state is one key per content. A batch writes to its own folder and replaces it when it is run again, so a
    restart after a failure adds nothing twice.
    """
    names = [f.name for f in CUT.fields]
    stream = spark.readStream.schema(CUT_FILE).option("multiLine", True).option("mode", "PERMISSIVE").json(incoming)
    signed = stream.withColumn("signature", F.sha2(F.to_json(F.struct(*[F.col(f.name) for f in CUT_FILE.fields])), 256)).dropDuplicates(["signature"])

    def audit(batch: DataFrame, number: int) -> None:
        lines = batch.filter("_corrupt_record IS NULL").select(F.concat_ws("_", "tree_id", "view").alias("sample_id"), F.explode("cut_lines").alias("c")).select(
            "sample_id", *[F.col(f"c.{n}").alias(n) for n in names]
        )
        broken = batch.filter("_corrupt_record IS NOT NULL").select(
            F.lit("").alias("sample_id"), F.lit("error").alias("severity"), F.lit("invalid_json").alias("code"), F.substring("_corrupt_record", 1, 80).alias("detail")
        )
        audit_cut_lines(lines, images).unionByName(broken).write.mode("overwrite").json(f"{issues_path}/batch={number}")

    return signed.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
