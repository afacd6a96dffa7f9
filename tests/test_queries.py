"""Every query with SQL gives the rows that DuckDB gives for it; the others run."""

import math
import os

import duckdb
import pytest

from folioscope.plans import registry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def same(x) -> str:
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    return str(x)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(same(r[c]) for c in columns) for r in df.collect())
    if name in registry.ORACLE:
        out = duck.sql(registry.ORACLE[name])
        assert sorted(out.columns) == columns
        at = [out.columns.index(c) for c in columns]
        assert got == sorted(tuple(same(r[k]) for k in at) for r in out.fetchall())
