"""The corpus queries that SQL can express, against DuckDB over the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from tessera.llm import queries


def canonical(frame):
    return sorted(tuple("NULL" if pd.isna(v) else str(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    want = duck.execute(queries.oracle_sql()[name]).fetch_df()
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(want.columns)
    rows = pd.DataFrame([tuple(r) for r in got.collect()], columns=got.columns, dtype=object)
    ints = want.select_dtypes("float").columns  # DuckDB's integers with nulls
    want[ints] = want[ints].astype("Int64")
    assert canonical(rows) == canonical(want)
