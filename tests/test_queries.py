"""Every registered query beside its SQL twin on the smallest tables, and rows from the others."""

import os

import duckdb
import pytest

import __spark_entry__ as driver

FOLDER = os.environ.get("QUERY_TEST_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = driver.queries(), driver.oracle_sql()
#: Queries that may be empty on small tables.
MAY_BE_EMPTY = {"p4_found", "p4_pairs", "training_frame"}
MODELS = {"train_predict", "model_metrics", "feature_importance", "shap_contributions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    db = duckdb.connect()
    for name in os.listdir(FOLDER):
        db.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return db


def plain(table):
    names = sorted(table.column_names)
    return names, sorted(tuple("∅" if r[c] is None else repr(r[c]) for c in names) for r in table.to_pylist())


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got, want = plain(QUERIES[name](spark, FOLDER).toArrow()), plain(db.execute(SQL[name]).to_arrow_table())
    assert got == want
    assert got[1] or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - MODELS))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_names_match():
    assert set(SQL) <= set(QUERIES)


def test_flagship(spark):
    assert len(driver.entry(spark).columns) == 15
