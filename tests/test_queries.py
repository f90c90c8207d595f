"""Every query with SQL against DuckDB on the smallest tables, where those are there."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from lodestar.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not Path(DIR).exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return f"{x:.6g}" if isinstance(x, float) else str(x)

    return sorted((tuple(text(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, DIR).toPandas()
    want = duck.execute(registry.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
