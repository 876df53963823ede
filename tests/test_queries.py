"""Every registered query against its SQL on the smallest tables, and a look at its plan."""

import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry
from skirmish.plans.queries import QUERIES as OWN

TABLES = ("events", "documents", "conversations")
QUERIES = {name: entry.queries()[name] for name in OWN}
ORACLES = {name: entry.oracle_sql()[name] for name in OWN}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan
    cur = db.execute(ORACLES[name])
    head = [d[0] for d in cur.description]
    assert sorted(head) == sorted(df.columns)
    want = sorted(repr([plain(r[head.index(c)]) for c in sorted(head)]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in sorted(head)]) for r in df.collect())
    assert got == want


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "total_damage" in df.columns


def test_every_query_has_sql():
    assert set(OWN) <= set(entry.queries()) and set(OWN) <= set(entry.oracle_sql())
