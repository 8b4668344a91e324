import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from filmloom.operators.skew import fragment_replicate_join, pack, per_key_counts, plan_loads


def rows():
    rng = random.Random(3)
    out = [(0, "hot", f"p{rng.randrange(700)}", rng.choice("abc")) for _ in range(3000)]
    out += [(1, "hot", f"q{rng.randrange(20)}", rng.choice(["a", None])) for _ in range(2000)]
    out += [(rng.randrange(2), f"k{rng.randrange(300)}", rng.choice([f"p{rng.randrange(40)}", None]), rng.choice("abcd")) for _ in range(4000)]
    return out + [(0, None, "p1", "a"), (0, "only", None, None)] + out[:100]


SCHEMA = "kind int, key string, partner string, category string, task int, heavy string, n int"


@pytest.fixture
def keyed(spark):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows()], SCHEMA).drop("task", "heavy", "n")


def test_packing():
    placed = pack([(10.0, "a"), (6.0, "b"), (5.0, "c"), (4.0, "d")], 2)
    loads = defaultdict(float)
    for unit, task in placed.items():
        loads[task] += {"a": 10, "b": 6, "c": 5, "d": 4}[unit]
    assert max(loads.values()) <= 15


@pytest.mark.parametrize("tasks", [1, 6])
def test_counts(keyed, tasks):
    plan = plan_loads(keyed.select("kind", "key"), keyed.count(), tasks)
    if tasks > 1:
        assert (0, "hot") in plan.heavy and len(plan.heavy[0, "hot"]) > 1
    want = defaultdict(lambda: (0, set(), set()))
    for kind, key, partner, category in rows():
        if key is not None:
            n, partners, categories = want[kind, key]
            want[kind, key] = (n + 1, partners | {partner} - {None}, categories | {category} - {None})
    got = {(r["kind"], r["key"]): (r["n_rows"], r["n_partners"], r["n_categories"]) for r in per_key_counts(keyed, plan).collect()}
    assert got == {k: (n, len(p), len(c)) for k, (n, p, c) in want.items()}


def test_tasks_are_even(keyed):
    plan = plan_loads(keyed.select("kind", "key"), keyed.count(), 6)
    from filmloom.operators.skew import assign

    loads = [r["count"] for r in assign(keyed.where("key is not null"), plan, F.xxhash64("partner", "category")).groupBy("task").count().collect()]
    assert max(loads) < 2.2 * sum(loads) / 6


def test_join(spark, keyed):
    plan = plan_loads(keyed.select("kind", "key"), keyed.count(), 6)
    lookup = spark.createDataFrame([(0, "hot", "H"), (0, "k1", "K"), (0, "k1", "L"), (1, "k2", "M"), (0, None, "N"), (0, "unused", "U")], "kind int, key string, name string")
    got = sorted(map(str, fragment_replicate_join(keyed, lookup, plan, F.xxhash64("partner")).select("kind", "key", "partner", "category", "name").collect()))
    want = sorted(map(str, keyed.join(lookup, ["kind", "key"], "left").select("kind", "key", "partner", "category", "name").collect()))
    assert got == want


def test_empty(keyed):
    none = keyed.limit(0)
    plan = plan_loads(none.select("kind", "key"), 0, 4)
    assert plan.heavy == {} and per_key_counts(none, plan).count() == 0


def test_rows_without_a_key_are_spread(spark):
    """5 % of the rows have no key, a third one key; 64 tasks."""
    from filmloom.operators.skew import assign

    rows = spark.range(60_000).selectExpr("0 as kind", "case when id % 20 = 0 then null when id % 3 = 0 then 'hot' else 'k' || id % 7000 end as key", "id as x").repartition(8)
    plan = plan_loads(rows.select("kind", "key"), tasks=64)
    assert plan.rows == 60_000
    loads = [r["count"] for r in assign(rows, plan, F.xxhash64("x")).groupBy("task").count().collect()]
    assert len(loads) == 64 and max(loads) < 2 * sum(loads) / 64
    lookup = spark.createDataFrame([(0, "hot", "H"), (0, None, "N")], "kind int, key string, name string")
    joined = fragment_replicate_join(rows, lookup, plan, F.xxhash64("x"))
    assert joined.count() == 60_000 and joined.where("name = 'H'").count() == rows.where("key = 'hot'").count()
    assert joined.where("key is null and name is not null").count() == 0


def test_a_hot_pair_is_spread(spark):
    """A third of all rows are one key with one partner, in several categories."""
    from filmloom.operators.skew import assign

    rows = spark.range(30_000).selectExpr("0 as kind", "case when id % 3 = 0 then 'hot' else 'k' || id % 5000 end as key", "case when id % 3 = 0 and id % 30 > 0 then 'p' else 'q' || id % 900 end as partner", "'c' || id % 4 as category").repartition(16)
    plan = plan_loads(rows.select("kind", "key", "partner"), tasks=8)
    assert len(plan.hot_pairs) == 1
    counts = per_key_counts(rows, plan)
    got = {r["key"]: (r["n_rows"], r["n_partners"], r["n_categories"]) for r in counts.collect()}
    want = {r["key"]: tuple(r)[1:] for r in rows.groupBy("key").agg(F.count("*"), F.count_distinct("partner"), F.count_distinct("category")).collect()}
    assert got == want
    marked = rows.withColumn("origin", F.spark_partition_id())
    hot = F.xxhash64("kind", "key", "partner").isin(plan.hot_pairs)
    loads = [r["count"] for r in assign(marked, plan, F.when(hot, F.xxhash64("origin")).otherwise(F.xxhash64("partner"))).groupBy("task").count().collect()]
    assert max(loads) < 2 * sum(loads) / 8
