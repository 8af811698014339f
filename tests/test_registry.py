"""Every registered query against DuckDB over the smallest tables."""

import glob
import importlib.util
import os

import duckdb
import pandas as pd
import pytest

from tessera.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()
#: Iterative jobs that the other tests run on planted data.
SLOW = {"c07_hierarchy", "c08_probabilities", "c09_outlier_scores", "c12_focus_recluster", "m06_chunk_analysis"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def shown(value) -> str:
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "NULL"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def canonical(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(map(shown, row)) for row in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got) and not got.isna().all().any()
        return
    want = duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert {"pipeline", "op1_language_id", "op10_secrets"} <= set(__spark_entry__.queries()) or importlib.util.find_spec("tessera.llm") is None
    assert set(SQL) <= set(QUERIES)
