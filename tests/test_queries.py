"""Every graph query against its DuckDB twin, over the same Parquet files."""

import duckdb
import pytest

from tests.conftest import SF
from tessera import queries as Q

TABLES = "lineitem embeddings"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df, cols):
    return sorted(map(str, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, sf, duck, name):
    got = Q.queries()[name](spark, sf).toPandas()
    want = duck.execute(Q.oracle_sql()[name]).fetchdf()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_runs(spark, sf, name):
    assert Q.queries()[name](spark, sf).count() > 0
