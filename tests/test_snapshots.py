import random
from datetime import date, datetime

from pyspark.sql import functions as F

from filmloom.operators.snapshots import snapshot_changes


def run(df):
    return {tuple(r) for r in snapshot_changes(df, F.col("day"), F.col("k"), [F.col("a"), F.col("b")], F.col("at")).collect()}


def plain(rows):
    latest = {}
    for day, k, a, b, at in rows:
        if day is not None and k is not None:
            order = (at is not None, at or datetime.min)
            if (day, k) not in latest or order > latest[day, k][0]:
                latest[day, k] = (order, (a, b))
    days = sorted({d for d, _ in latest} | {r[0] for r in rows if r[0]})
    out = set()
    for before, after in zip(days, days[1:]):
        x, y = ({k: v for (d, k), (_, v) in latest.items() if d == day} for day in (before, after))
        out |= {(after, k, "added") for k in y.keys() - x.keys()} | {(after, k, "removed") for k in x.keys() - y.keys()}
        out |= {(after, k, "changed") for k in x.keys() & y.keys() if x[k] != y[k]}
    return out


SCHEMA = "day date, k string, a double, b bigint, at timestamp, row string, later boolean, key int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", True, 1) for r in rows], SCHEMA)


def test_against_plain(spark):
    rng = random.Random(1)
    rows = []
    for i in range(2000):
        day = date(2024, rng.choice([1, 2, 4, 9]), 1)
        rows.append((day, f"k{int(rng.paretovariate(0.5)) % 90}", rng.choice([None, 1.0, 2.0]), rng.choice([None, 1, 2]), datetime(2024, 1, 1, 0, i // 60, i % 60)))
    rows += rows[:200]
    assert run(frame(spark, rows)) == plain(rows) != set()


def test_nulls_and_moves(spark):
    d1, d2, t = date(2024, 1, 1), date(2024, 2, 1), datetime(2024, 1, 1)
    rows = [(d1, "p", None, 5, t), (d2, "p", 5.0, None, t), (d1, "q", None, None, None), (d2, "q", None, None, t), (d1, None, 1.0, 1, t), (None, "z", 1.0, 1, t), (d2, "n", 1.0, 1, None)]
    assert run(frame(spark, rows)) == {(d2, "p", "changed"), (d2, "n", "added")}


def test_few_snapshots(spark):
    rows = [(date(2024, 1, 1), "p", 1.0, 1, None)]
    assert run(frame(spark, rows)) == run(frame(spark, rows).limit(0)) == set()


def test_ties_are_settled(spark):
    t = datetime(2024, 1, 1)
    rows = [(date(2024, 1, 1), "p", 1.0, 1, t), (date(2024, 2, 1), "p", 1.0, 1, t), (date(2024, 2, 1), "p", 2.0, 1, t)]
    assert len({frozenset(run(frame(spark, rows).repartition(n))) for n in (1, 3, 7)}) == 1
