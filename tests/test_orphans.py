import random
from datetime import datetime, timedelta

from filmloom.operators.orphans import orphan_references

START = datetime(2024, 1, 1)


def plain(refs, target):
    covered = lambda k, t: any(k2 == k and a is not None and a <= t and (d is None or d > t) for k2, a, d in target)
    return {(t.strftime("%Y-%m"), k) for k, t in refs if k is not None and t is not None and not covered(k, t)}


def run(spark, refs, target):
    r = spark.createDataFrame([(*x, 7, "d") for x in refs], "key string, t timestamp_ntz, delta int, day string")
    d = spark.createDataFrame([(*x, 7) for x in target], "key string, start timestamp_ntz, `end` timestamp_ntz, net int")
    return {tuple(x) for x in orphan_references(r, d).collect()}


def test_against_plain(spark):
    rng = random.Random(2)
    when = lambda: START + timedelta(hours=rng.randrange(24 * 75))
    target = []
    for i in range(60):
        start = when()
        for _ in range(rng.randrange(1, 4)):
            end = rng.choice([None, start + timedelta(hours=rng.randrange(-10, 300))])
            target += [(f"k{i}", start, end)] * rng.randrange(1, 3)
            start = start + timedelta(hours=rng.randrange(400))
    target += [("k1", None, None), (None, START, None), ("k2", START, START)]
    refs = [(f"k{int(rng.paretovariate(0.4)) % 80}", when()) for _ in range(3000)]
    refs += [(k, a) for k, a, _ in target if a] + [(k, d) for k, _, d in target if d] + [(None, START), ("k3", None)] + refs[:50]
    assert run(spark, refs, target) == plain(refs, target) != set()


def test_borders(spark):
    t = START + timedelta(hours=5)
    target = [("k", t, t + timedelta(hours=1)), ("k", t + timedelta(hours=1), None)]
    assert run(spark, [("k", t), ("k", t + timedelta(hours=1))], target) == set()
    assert run(spark, [("k", t - timedelta(microseconds=1))], target) == {("2024-01", "k")}
    assert run(spark, [("k", t)], [("k", t, t)]) == {("2024-01", "k")}


def test_empty(spark):
    assert run(spark, [("k", START)], []) == {("2024-01", "k")}
    assert run(spark, [], [("k", START, None)]) == set()


def test_counts(spark):
    from filmloom.operators.orphans import count_deltas, current_orphans, merge_counts

    refs = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "key string")
    target = spark.createDataFrame([("b", START, None), ("c", START, START + timedelta(1)), ("c", START, START)], "key string, start timestamp_ntz, `end` timestamp_ntz")
    deltas = count_deltas(refs, target)
    counts = merge_counts(deltas.limit(0), deltas)
    assert {tuple(r) for r in current_orphans(counts).collect()} == {("a", 2, 0), ("c", 1, 0)}
    more = spark.createDataFrame([("a", 0, 1), ("c", -1, 0), ("b", 0, -1), ("d", 1, 0)], "key string, refs bigint, existing bigint")
    assert {r["key"] for r in current_orphans(merge_counts(counts, more)).collect()} == {"b", "d"}


def test_stream(spark, tmp_path):
    from filmloom.streaming.orphans import keep_orphan_report, latest_report

    schema = "key string, refs bigint, existing bigint"

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = keep_orphan_report(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state")
        q.awaitTermination(60)
        assert q.exception() is None
        return {r["key"] for r in latest_report(spark.read.parquet(f"{tmp_path}/out")).collect()}

    assert step([("a", 2, 0), ("b", 1, 1), (None, 1, 0)]) == {"a"}
    assert step([("b", 0, -1), ("c", 1, 0)]) == {"a", "b", "c"}
    assert step([("a", -2, 0), ("c", 0, 1)]) == {"b"}


def test_half_of_all_rows_on_one_open_day(spark):
    """One key is referred to all day while it is deleted and returns twice; others only before or after."""
    day = START + timedelta(days=3)
    target = [("hot", START, day + timedelta(hours=2)), ("hot", day + timedelta(hours=3), day + timedelta(hours=9)), ("hot", day + timedelta(hours=11), None)]
    target += [(f"k{i}", day + timedelta(minutes=i), None) for i in range(50)]
    covered = [day + timedelta(hours=h, seconds=s) for h in (0, 1, 4, 8, 12, 23) for s in range(300)]
    refs = [("hot", t) for t in covered] + [(f"k{i % 60}", day + timedelta(minutes=30 + i % 7)) for i in range(1800)]
    assert run(spark, refs, target) == plain(refs, target) and ("2024-01", "hot") not in run(spark, refs, target)
    gap = [*refs, ("hot", day + timedelta(hours=10))]
    assert ("2024-01", "hot") in run(spark, gap, target) and run(spark, gap, target) == plain(gap, target)


def test_stream_is_compacted(spark, tmp_path):
    from filmloom.streaming.orphans import keep_orphan_report, latest_report

    schema, folder = "key string, refs bigint, existing bigint", f"{tmp_path}/out"
    want, rng = {}, random.Random(13)
    for step in range(7):
        rows = [(f"k{rng.randrange(6)}", rng.choice([1, 1, -1]), rng.choice([0, 1, -1])) for _ in range(8)]
        if step == 5:
            rows += [(k, -refs, -existing) for k, (refs, existing) in want.items()]  # nothing is left
        for k, refs, existing in rows:
            a, b = want.get(k, (0, 0))
            want[k] = (a + refs, b + existing)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = keep_orphan_report(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), folder, f"{tmp_path}/state", compact_every=3)
        q.awaitTermination(60)
        assert q.exception() is None
        got = {r["key"]: r["refs"] for r in latest_report(spark.read.parquet(folder)).collect()}
        assert got == {k: refs for k, (refs, existing) in want.items() if refs > 0 and existing == 0}
        if step == 5:
            base = spark.read.parquet(folder)
            assert {r["batch"] for r in base.select("batch").distinct().collect()} <= {5} and base.count() <= 6
