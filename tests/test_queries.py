"""Every registered query of the derived network against its SQL, at the smallest scale."""

import glob
import os

import duckdb
import pytest

from waymill.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(rows):
    tidy = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(tidy(v) for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = plain(tuple(r[c] for c in columns) for r in df.collect())
    if name not in ORACLE_SQL:
        assert got
        return
    result = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = plain(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())
    assert got == want
