"""Every registered query over empty tables, and over tables with null rows, repeated rows and clashing columns."""

import os
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
QUERIES = driver.queries()
#: Names that operators use inside.
CLASHING = ["key", "t", "day", "ref", "delta", "task", "heavy", "kind", "partner", "node", "root", "item", "basket", "chunk", "word", "doc", "record", "tokens", "bucket", "rating", "features", "pos", "row_id", "reason", "at", "name", "low", "n", "s"]
#: Slow fits, run on one of the two only.
MODELS = {"model_checks", "model_metrics", "feature_importance", "shap_contributions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def tables():
    for name in sorted(os.listdir(FOLDER)):
        yield name, pq.read_table(f"{FOLDER}/{name}")


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for name, table in tables():
        pq.write_table(table.slice(0, 0), at / name)
    return str(at)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Each table with every value of some rows nulled in turn, repeated rows, a very long text, and clashing columns."""
    at, rng = tmp_path_factory.mktemp("odd"), random.Random(5)
    for name, table in tables():
        rows = table.to_pylist()
        for column in table.column_names:
            rows += [r | {column: None} for r in rng.sample(rows, min(3, len(rows)))]
        rows += rows[:5] + [dict.fromkeys(table.column_names)]
        if "text" in table.column_names:
            rows += [rows[0] | {"text": "long " * 100_000}, rows[0] | {"text": ""}, rows[0] | {"text": "é" * 100_000}]
        wide = pa.Table.from_pylist(rows, table.schema)
        for column in CLASHING:
            wide = wide.append_column(column, pa.array(["x"] * len(wide)))
        pq.write_table(wide, at / name)
    return str(at)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty(spark, empty, name):
    rows = QUERIES[name](spark, empty).collect()
    known = {"table_row_counts", "regression_metrics", "people_lookup"}
    assert not rows or name in known, rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_odd(spark, odd, name):
    QUERIES[name](spark, odd).write.format("noop").mode("overwrite").save()
