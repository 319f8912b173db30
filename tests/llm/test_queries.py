"""Every query of the subpackage that has SQL, against it."""

import duckdb
import pytest

from scanweave.llm.queries import ORACLES, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations".split()


def plain(v):
    return repr(round(float(v), 9)) if isinstance(v, (int, float)) and not isinstance(v, bool) else v


def rows_of(columns, rows):
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return order, sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", list(ORACLES))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    rel = con.sql(ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of([c[0] for c in rel.description], rel.fetchall())
