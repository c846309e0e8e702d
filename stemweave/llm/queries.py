"""Registered queries of the operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stemweave.llm import containment, fst, host_rules, langmix, licenses, merkle, ppm, probminhash, repeats, spelling, toxicity, warc, wordpiece
from stemweave.llm import sql as twin

PIECE_MODEL = os.environ.get("TOKENIZERS", "/opt/tokenizers") + "/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(_table(spark, sf_dir, "documents"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judge(_table(spark, sf_dir, "documents")).drop("rate_base", "rate_symbols", "rate_dup_lines")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), wordpiece.pieces_of_model(PIECE_MODEL))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst.encode(_table(spark, sf_dir, "documents"), fst.load_model(PIECE_MODEL))


def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.held_out_languages(_table(spark, sf_dir, "documents"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.spans(_table(spark, sf_dir, "documents"))


def op10_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audited(_table(spark, sf_dir, "documents"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_ppm": op2_ppm,
    "op3_toxicity": op3_toxicity,
    "op4_probminhash": op4_probminhash,
    "op5_host_rules": op5_host_rules,
    "op6_token_counts": op6_token_counts,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_language_mixture": op8_language_mixture,
    "op9_repeats": op9_repeats,
    "op10_containment": op10_containment,
    "op11_merkle": op11_merkle,
    "op12_licenses": op12_licenses,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_warc": twin.WARC,
    "op5_host_rules": twin.HOST_RULES,
    "op10_containment": twin.CONTAINMENT,
    "op11_merkle": twin.MERKLE,
    "op12_licenses": twin.licenses_sql(licenses.PHRASES, licenses.templates_of(licenses.TEMPLATES), licenses.THRESHOLD),
    "op13_spelling": twin.SPELLING,
}
