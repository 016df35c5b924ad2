"""Every query with an oracle agrees with it at the smallest scale."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
REFERENCE = [n for n in entry.oracle_sql() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def rows(df):
    cell = lambda v: None if pd.isna(v) else (round(v, 6) + 0.0 if isinstance(v, float) else str(v))
    df = df[sorted(df.columns)].astype(object)
    return sorted([tuple(str(cell(v)).removesuffix(".0") for v in r) for r in df.itertuples(index=False)])


@pytest.mark.parametrize("name", REFERENCE)
def test_oracle(spark, duck, name):
    got, want = entry.queries()[name](spark, D).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
