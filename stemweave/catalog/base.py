"""A registered query: how it is built on Spark and, where SQL can say it, the same as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def r6(value: Column | str) -> Column:
    """Six decimals, no negative zero: the form in which doubles are compared."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def rsql(expr: str, name: str) -> str:
    return f"round(({expr})::DOUBLE, 6) + 0.0 AS {name}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
