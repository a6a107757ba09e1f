"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

import os

import duckdb
import pytest

from quarry.plans import registry

FOLDER = os.environ.get("QUARRY_TEST_DATA", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def _norm(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, duck, name):
    found = registry.queries()[name](spark, FOLDER)
    cur = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(found.columns) == sorted(columns)
    assert _norm([tuple(r) for r in found.collect()], found.columns) == _norm(cur.fetchall(), columns)


def test_names_and_flagship(spark):
    assert set(registry.oracle_sql()) <= set(registry.queries())
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
