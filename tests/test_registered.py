"""Registered queries against their SQL on the smallest tables, and their contract."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from check import TABLES, compare  # noqa: E402

SF = "/root/testdata/sf0.001"
PICKED = ["ranking_vs_random", "average_precision", "threshold_quantile", "nested_folds", "audit_cut_lines", "dedupe_by_content", "poly_slice", "assign_points", "map_cuts", "trace_segments", "segment_features", "region_features"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_registry_loads_without_a_session():
    import subprocess

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", PICKED)
def test_query_equals_sql(spark, duck, name):
    status, rows, _, _, note = compare(spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert status == "ok" and rows > 0, note


def test_average_precision_ignores_monotone_rescaling(spark):
    from pyspark.sql import functions as F

    from stemweave import fixtures as fx
    from stemweave.operators.curves import areas

    df = fx.candidates(spark, SF)
    a = sorted(map(tuple, areas(df).collect()))
    b = sorted(map(tuple, areas(df.withColumn("score", F.exp("score") * 3)).collect()))
    assert all(abs(x[1] - y[1]) < 1e-12 and abs(x[2] - y[2]) < 1e-12 for x, y in zip(a, b))
