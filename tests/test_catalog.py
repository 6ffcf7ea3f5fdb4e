"""Queries and their SQL agree on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from outrider.plans import catalog, round_trips  # noqa: F401

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.5g}"
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(v)
    return str(v)


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_sql(spark, sql, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    rel = sql.execute(catalog.ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    a = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rel.fetchall())
    assert a == b
