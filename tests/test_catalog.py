"""Every catalog query that has SQL, against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from paperloom.plans.catalog import QUERIES
from paperloom.plans import oracles, oracles_rules

SQL = oracles.SQL | oracles_rules.SQL
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def flat(df: pd.DataFrame) -> pd.DataFrame:
    def one(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.6f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, (bool, float)) else str(v)

    out = df[sorted(df.columns)].map(one)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = flat(QUERIES[name](spark, str(DATA)).toPandas()), flat(duck.execute(SQL[name]).fetch_df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_all_oracles_have_queries():
    assert set(SQL) <= set(QUERIES)
