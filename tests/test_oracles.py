"""Every core query against its SQL oracle on the smallest tables."""

import duckdb
import pytest

from codelode.plans.registry import core
from codelode.sources.tables import TABLES
from verify import rows

QUERIES, ORACLES = core()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert len(set(df.columns)) == len(df.columns)
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert rows(df.columns, got) == rows(names, cur.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() >= 0 and df.columns == ["repo", "path", "scan_id", "hash", "change"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
