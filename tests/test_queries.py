"""Every query that SQL can express, against DuckDB on the smallest tables; the others run."""

import math

import duckdb
import pytest

from evidra.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "conversations", "pages", "labels", "events")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canonical(rows, cols):
    at = sorted(range(len(cols)), key=lambda k: cols[k])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        return v

    return sorted((tuple(plain(r[k]) for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    want = con.execute(SQL[name]).fetchall()
    cols = [d[0] for d in con.description]
    assert sorted(cols) == sorted(df.columns)
    assert canonical(df.collect(), df.columns) == canonical(want, cols)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_others_run(spark, name):
    df = QUERIES[name](spark, SF)
    assert len(df.columns) > 1 and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
