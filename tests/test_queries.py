"""Every registered query of the library against its SQL, and the rest by their rows, at the smallest size."""

import math

import duckdb
import pytest

from hyperslice.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, (list, tuple)):
        return str([canonical(v) for v in value])
    return str(value)


def rows(names, found):
    order = [names.index(n) for n in sorted(names)]
    return sorted(tuple(canonical(r[i]) for i in order) for r in found)


@pytest.fixture(scope="module")
def connection():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, connection, name):
    df = QUERIES[name](spark, SF)
    found = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert found
        return
    expected = connection.execute(ORACLES[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, found) == rows(names, expected.fetchall())
