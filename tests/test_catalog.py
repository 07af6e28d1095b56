"""Every registered query against its SQL over the smallest tables, where they are there."""

import math
import os

import duckdb
import pytest

from tesserine.plans import catalog, catalog_files, catalog_jobs, catalog_state  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    assert len(df.columns) == len(set(df.columns))
    if name in catalog.SQL:
        r = con.sql(catalog.SQL[name])
        assert sorted(r.columns) == sorted(df.columns)
        at = [r.columns.index(c) for c in df.columns]
        assert sorted((tuple(map(plain, x)) for x in got), key=repr) == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)
