"""Every query beside its SQL on the smallest tables."""

import os

import pytest

from voxelith import queries as Q

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def canon(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    cell = lambda v: round(float(v), 6) + 0.0 if isinstance(v, float) else v
    return [names[k] for k in order], sorted((tuple(cell(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, duck, name):
    got = Q.queries()[name](spark, SF)
    want = duck.execute(Q.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert canon([tuple(r) for r in got.collect()], got.columns) == canon(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql())))
def test_query_without_sql_gives_rows(spark, name):
    assert Q.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
