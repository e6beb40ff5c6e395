"""Every engine query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import breakweave.plans.amplicons
import breakweave.plans.structures  # noqa: F401  (add their queries)
from breakweave.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def rounded(rows):
    return sorted((tuple(round(x, 5) + 0.0 if isinstance(x, float) else x for x in r) for r in rows), key=lambda r: [(x is None, str(x)) for x in r])


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    expected = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    assert rounded(frame.select(*columns).collect()) == rounded(expected)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() >= 0
