"""Shapes of physical plans that must hold whatever the size of the data."""

import os
import re

import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
QUERIES = driver.queries()
MODELS = {"model_checks", "train_predict", "model_metrics", "feature_importance", "shap_contributions"}

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def shuffled(spark):
    """No broadcast by statistics: joins show what they do with large sides."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "5000"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODELS))
def test_no_cross_join(shuffled, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(QUERIES[name](shuffled, FOLDER)))


def test_snapshots_shuffle_once(shuffled):
    text = plan(QUERIES["p1_found"](shuffled, FOLDER))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_max" in text


def test_parsing_shuffles_nothing(shuffled):
    for name in ("p7_found", "p7_loaded", "p7_edits"):
        assert "Exchange" not in plan(QUERIES[name](shuffled, FOLDER))


def test_key_counts_send_rows_once(shuffled):
    text = plan(QUERIES["p5_key_counts"](shuffled, FOLDER))
    assert "shufflepartitionidpassthrough" in text.lower()
    assert all("task" in line for line in text.splitlines() if "Exchange" in line and "Broadcast" not in line and "hashpartitioning" not in line)


@pytest.mark.parametrize("name,columns", [("genre_counts", {"tconst", "titleType", "primaryTitle", "startYear", "runtimeMinutes", "genres"}), ("director_ordering", {"tconst", "ordering", "nconst", "category"}), ("p6_found", {"tconst", "genres"})])
def test_columns_are_pruned(shuffled, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(QUERIES[name](shuffled, FOLDER)))
    assert schemas and all({c.split(":")[0] for c in s.split(",")} <= columns for s in schemas)


def test_filters_reach_the_scan(shuffled):
    text = plan(QUERIES["load_basics"](shuffled, FOLDER))
    assert "EqualTo(titleType,movie)" in text and "IsNotNull(startYear)" in text


def test_top_actors_are_limited_before_the_shuffle(shuffled):
    assert plan(QUERIES["top3_actors"](shuffled, FOLDER)).count("WindowGroupLimit") == 2
