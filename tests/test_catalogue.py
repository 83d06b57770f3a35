"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from memoryloom.plans import catalogue, extensions, governance, requests, streams  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(x):
    return "null" if x is None or x != x else repr(float(x)) if isinstance(x, float) else str(x)


@pytest.fixture(scope="session")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{data}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, duck, name):
    ours, theirs = catalogue.QUERIES[name](spark, data).toPandas(), duck.execute(catalogue.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    cols = sorted(ours.columns)
    rows = [sorted(tuple(map(shown, r)) for r in x[cols].itertuples(index=False)) for x in (ours, theirs)]
    assert rows[0] == rows[1]
