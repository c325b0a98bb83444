"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from auditlake import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", [*Q.oracle_sql()])
def test_query(spark, duck, name):
    df = Q.queries()[name](spark, SF)
    names = sorted(df.columns)
    duck.execute(Q.oracle_sql()[name])
    found, rows = [c[0] for c in duck.description], duck.fetchall()
    assert sorted(found) == names
    want = sorted((tuple(plain(r[found.index(c)]) for c in names) for r in rows), key=repr)
    assert sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want


def test_every_query_has_sql():
    assert Q.queries().keys() == Q.oracle_sql().keys()
