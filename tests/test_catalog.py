"""Every registered query of the general operators against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

import stylometra.plans  # noqa: F401  (fills the registry)
from stylometra.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def cell(v):
    return f"{float(v):.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    rows = df.collect()
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert cols == sorted(df.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(tuple(cell(r[c]) for c in cols) for r in rows) == sorted(tuple(cell(r[i]) for i in at) for r in want.fetchall())
