"""Each query against its SQL twin on the smallest tables."""

import decimal

import duckdb
import pytest

import twinmark.plans.more_queries
import twinmark.plans.study_queries  # noqa: F401
from twinmark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: round(float(v), 9) if isinstance(v, (float, decimal.Decimal)) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE_SQL:
        return
    q = duck.execute(ORACLE_SQL[name])
    columns = [x[0] for x in q.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon(rows, df.columns) == canon(q.fetchall(), columns)
