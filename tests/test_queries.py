"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points

SF = "/root/testdata/sf0.001"
TABLES = "orders lineitem events documents embeddings pages benchmark labels conversations"
ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    result = db.execute(ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical([tuple(r) for r in df.collect()], df.columns) == canonical(result.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_probe_query_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
    for r in rows:
        values = r.asDict()
        assert values.get("converged", True)
        assert all(0 <= v <= 1 for k, v in values.items() if k.endswith(("auc", "precision", "recall", "f1")))


def test_entry(spark):
    assert entry_points.entry(spark).count() == 8


def test_names():
    assert set(ORACLES) <= set(QUERIES)
