"""Every registered core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpusgrid.queries import QUERIES, SQL
from corpusgrid.sources.tables import TABLES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def oracle():
    made = duckdb.connect()
    for t in TABLES:
        made.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return made


def norm(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list | tuple):
        return tuple(map(norm, value))
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    found = df.collect()
    assert found, "a query that finds nothing shows nothing"
    if name not in SQL:
        return
    cursor = oracle.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(columns) == sorted(df.columns)
    got = sorted(repr([norm(r[c]) for c in sorted(columns)]) for r in found)
    wanted = sorted(repr([norm(v) for _, v in sorted(zip(columns, r, strict=True))]) for r in expected)
    assert got == wanted
