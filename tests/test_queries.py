"""Every query with SQL against DuckDB; the others must give rows."""

import duckdb
import pytest

from wavegrid import queries as core

SF = "/root/testdata/sf0.001"
TABLES = ("events", "embeddings")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query(spark, con, name):
    got = core.queries()[name](spark, SF)
    rows = [tuple(r[c] for c in sorted(got.columns)) for r in got.collect()]
    sql = core.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, rows)) == sorted(str(tuple(r[k] for k in order)) for r in cursor.fetchall())
