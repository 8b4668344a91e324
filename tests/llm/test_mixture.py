import random

import pytest

from filmloom.llm import mixture
from filmloom.llm.mixture import Target, mix, mix_report, route
from filmloom.llm.tokens import token_count


def test_route_repeats_least():
    targets = [Target("a", 0.5, 4), Target("b", 0.5, 1)]
    total, arcs = route([((0,), 100), ((0, 1), 50), ((1,), 300)], targets)
    assert total >= 700 - 2
    given = {}
    for p, s, tokens in arcs:
        given[s] = given.get(s, 0) + tokens
        assert tokens <= [100, 50, 300][p] * targets[s].repeats
    assert given[0] == given[1]
    total, arcs = route([((0,), 100), ((0, 1), 50), ((1,), 300)], targets, 200)
    assert total == 200 and all(t <= [100, 50, 300][p] for p, _, t in arcs)
    assert route([], targets) == (0, []) and route([((0,), 10)], [Target("a", 0.0, 1)]) == (0, [])


@pytest.mark.parametrize("bucket", [mixture.BUCKET_RECORDS, 5])
def test_mix(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixture, "BUCKET_RECORDS", bucket)
    rng = random.Random(8)
    targets = [Target("a", 0.3, 2), Target("b", 0.6, 3), Target("empty", 0.1, 5)]
    rows = [(i, rng.choice("ab"), f"r{i}", rng.randrange(1, 20)) for i in range(300)]
    rows += [(1000 + i, "b" if s == "a" else "a", r, t) for i, s, r, t in rows[:60]] + rows[:9]
    rows += [(2000, "other", "x", 5), (2001, None, "y", 5), (2002, "a", None, 5), (2003, "a", "z", 0), (None, "a", "q", 4)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, record string, tokens long, uses int")
    chosen = mix(df, targets, seed=1)
    got = chosen.collect()
    repeats = {t.source: t.repeats for t in targets}
    known = {(r[1], r[0]): r for r in rows}
    assert got and all(1 <= r["uses"] <= repeats[r["source"]] and known[r["source"], r["doc_id"]][3] == r["tokens"] for r in got)
    assert len({(r["source"], r["doc_id"]) for r in got}) == len(got)
    per_record = {}
    for r in got:
        record = known[r["source"], r["doc_id"]][2]
        per_record[record] = per_record.get(record, 0) + r["uses"]
    assert max(per_record.values()) <= 3
    report = {r["source"]: r for r in mix_report(chosen, targets).collect()}
    assert abs(report["a"]["actual_share"] - 1 / 3) < 0.02 and report["empty"]["actual_share"] == 0 and report["empty"]["tokens"] == 0
    assert sorted(map(tuple, got)) == sorted(map(tuple, mix(df.repartition(5), targets, seed=1).collect()))
    assert mix(df.limit(0), targets).count() == 0


def test_uses_are_exact_in_large_patterns(spark):
    """One token beyond a full turn uses the first record twice."""
    df = spark.createDataFrame([(i, "a", f"r{i}", 4_000_000_000_000 + i) for i in range(3)], "doc_id long, source string, record string, tokens long")
    whole = sum(r["tokens"] for r in df.collect())
    uses = lambda total: sorted(r["uses"] for r in mix(df, [Target("a", 1.0, 2)], total=total).collect())
    assert uses(whole) == [1, 1, 1] and uses(whole + 1) == [1, 1, 2] and uses(2 * whole) == [2, 2, 2] and uses(1) == [1]


def test_tokens(spark):
    rows = [("hello world",), ("",), (None,), ("<|endoftext|>",), ("a" * 100_000,)]
    counts = [r[0] for r in spark.createDataFrame(rows, "text string").select(token_count()("text")).collect()]
    assert counts[:3] == [2, 0, 0] and counts[3] > 1 and counts[4] > 1000
