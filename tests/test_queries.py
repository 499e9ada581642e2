"""Every registered query runs; those with SQL give the same rows in another engine."""

import datetime
import math

import duckdb
import pytest

from skein.plans import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        return f"{float(v):.5g}" if not isinstance(v, (bool, str)) else str(v)
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted("|".join(plain(r[n]) for n in names) for r in df.collect())
    if name in catalog.ORACLE_SQL:
        want = con.execute(catalog.ORACLE_SQL[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == names
        assert got == sorted("|".join(plain(r[columns.index(n)]) for n in names) for r in want.fetchall())
