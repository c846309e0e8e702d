"""A corpus through quality rules, near and exact duplicates, decontamination and encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemweave.llm import containment, fst, host_rules, probminhash, repeats
from stemweave.llm.queries import PIECE_MODEL
from stemweave.plans.durable import written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words of a passage that counts as repeated: more than fifty, whatever their bytes.
REPEATED_WORDS = 51


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules themselves or come from a rejected host go."""
    return host_rules.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return probminhash.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of ``REPEATED_WORDS`` words or more that occur again are taken out of the texts, wherever they stand."""
    return repeats.without_repeats(docs, unit=repeats.words_of_length(REPEATED_WORDS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return containment.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their pieces."""
    return fst.encode(docs, fst.load_model(PIECE_MODEL), carry=tuple(docs.columns))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("decontaminate", decontaminate),
    ("encode", encode),
]

#: Minima of random arrivals, suffix order and the shortest path are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
