"""Every catalogue query against its SQL text, and the ones without a text for sane output."""

import duckdb
import pytest

from scanweave.plans.catalogue import QUERIES
from scanweave.plans.oracles import ORACLES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name in ORACLES:
        rel = duck.sql(ORACLES[name])
        assert got == rows_of([c[0] for c in rel.description], rel.fetchall())
    else:
        assert got[1]
