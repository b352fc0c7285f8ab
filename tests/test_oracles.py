"""Every query with an oracle against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from mergetide.plans import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(found):
    return sorted(tuple("" if x is None else repr(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    mine = rows(tuple(r) for r in df.select(*columns).collect())
    if name in catalog.ORACLES:
        theirs = duck.sql(catalog.ORACLES[name])
        assert sorted(theirs.columns) == columns
        assert mine == rows(theirs.select(*[f'"{c}"' for c in columns]).fetchall())
    else:
        assert mine
