"""Every registered query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from kickframe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(cell(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, SF)
    found = [tuple(r) for r in got.collect()]
    if name in catalog.ORACLE_SQL:
        want = con.execute(catalog.ORACLE_SQL[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, found) == rows(names, want.fetchall())
    else:
        assert found
