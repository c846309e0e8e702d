"""Cutting lineage through a written table that survives the loss of any executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own_folder: str | None = None
_open: list["Scratch"] = []


def shared_folder(spark: SparkSession) -> str:
    """Folder the session names in ``spark.checkpoint.dir``; a private one only in local mode, where it may be unset."""
    global _own_folder
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


class Scratch:
    """Tables written since it was opened; all but those that are kept are deleted when it closes."""

    def __init__(self) -> None:
        self.paths: list[str] = []
        self.kept: set[str] = set()

    def keep(self, table: DataFrame) -> DataFrame:
        self.kept.add(table._written_to)
        return table


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """What is written inside is deleted at the end, unless kept: for intermediate tables that no plan reads any more.

    A kept table belongs to the enclosing scratch, if there is one. After an error nothing is deleted.
    """
    own = Scratch()
    _open.append(own)
    try:
        yield own
    finally:
        _open.remove(own)
        if _open:
            _open[-1].paths.extend(p for p in own.paths if p in own.kept)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for path in own.paths:
        if path not in own.kept:
            where = path_of(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    The result can be read by several branches of a plan without recomputing (or re-sampling)
    its source, keeps column pruning, and has no lineage behind it. The shuffle files of the write
    go with its end, as nobody reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("errorifexists").option("compression", "lz4_raw").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    if _open:
        _open[-1].paths.append(path)
    return table
