"""Declarative rules that turn rows into issue rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rule(condition: Column, severity: str, code: str, detail: Column | None = None) -> Column:
    """An issue struct where ``condition`` holds, else null."""
    text = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))
    return F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), text.alias("detail")))


def issue_rows(df: DataFrame, key: Column | str, rules: Sequence[Column]) -> DataFrame:
    """One row per broken rule: (sample_id, severity, code, detail)."""
    key = F.col(key) if isinstance(key, str) else key
    return df.select(key.alias("sample_id"), F.explode(F.array_compact(F.array(*rules))).alias("i")).select("sample_id", "i.*")
