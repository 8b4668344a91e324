import heapq
import random

import numpy as np
import pyarrow as pa
import pytest

from filmloom.llm import components
from filmloom.llm.components import connected_components, forest
from filmloom.llm.splits import RANK_BUCKET, assign_splits, greedy_counts, groups_of


def plain_groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = {}
    for x in list(parent):
        out.setdefault(find(x), set()).add(x)
    return {frozenset(g) for g in out.values()}


def test_forest():
    rng = random.Random(1)
    for n in (1, 5, 200):
        pairs = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(n)]
        hashed = [np.array([hash((7, x)) for x in side], np.int64) for side in zip(*pairs)]
        nodes, places, _ = forest(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), *hashed)
        got = {}
        for node, root in zip(nodes.to_pylist(), places.tolist()):
            got.setdefault(root, set()).add(node)
        assert {frozenset(g) for g in got.values()} == plain_groups(pairs)


@pytest.mark.parametrize("limit", [components.EDGES_PER_TASK, 30])
def test_components_over_levels(spark, monkeypatch, limit):
    monkeypatch.setattr(components, "EDGES_PER_TASK", limit)
    rng = random.Random(2)
    pairs = [(f"n{i}", f"n{i + 1}") for i in range(300)] + [("hub", f"leaf{i}") for i in range(300)]
    pairs += [(f"r{rng.randrange(400)}", f"r{rng.randrange(400)}") for _ in range(250)] + [("a", "a"), ("a", "a"), ("b", None)]
    rng.shuffle(pairs)
    df = spark.createDataFrame([(*p, 1) for p in pairs], "a string, b string, node int").repartition(7)
    got = {}
    for r in connected_components(df).collect():
        got.setdefault(r["root"], []).append(r["node"])
    assert all(len(set(g)) == len(g) for g in got.values())
    assert {frozenset(g) for g in got.values()} == plain_groups([p for p in pairs if p[1]])
    assert connected_components(df.limit(0)).count() == 0


def test_groups(spark):
    rows = [("t2", "d1"), ("t1", "d1"), ("t3", "d2"), ("t1", "d3"), ("t4", "d3"), ("t5", None), (None, "d2"), ("t1", "d1")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "item string, owner string, root string")
    assert sorted(map(tuple, groups_of(df).collect())) == [("t1", "t1", 3), ("t2", "t1", 3), ("t3", "t3", 1), ("t4", "t1", 3)]


def plain_greedy(sizes, shares):
    total = sum(s * c for s, c in sizes)
    heap = [(-share * total, i) for i, share in enumerate(shares)]
    heapq.heapify(heap)
    out = []
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(shares)
        for _ in range(count):
            d, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (d + size, i))
        out.append((size, got))
    return out


def test_greedy_in_bulk():
    sizes = [(9000, 1), (70, 3), (3, 2500), (2, 4001), (1, 20_000)]
    shares = [0.8, 0.13, 0.07]
    fast, slow = greedy_counts(sizes, shares), plain_greedy(sizes, shares)
    for (s, a), (t, b) in zip(fast, slow):
        assert s == t and sum(a) == sum(b) and all(abs(x - y) <= 1 for x, y in zip(a, b))


def test_assignment(spark, monkeypatch):
    monkeypatch.setattr("filmloom.llm.splits.RANK_BUCKET", 50)
    rng = random.Random(3)
    rows, n = [], 0
    for size in [40, 7, 7, 5] + [rng.randrange(1, 4) for _ in range(400)]:
        rows += [(f"i{n + k:05d}", f"i{n:05d}", size) for k in range(size)]
        n += size
    df = spark.createDataFrame(rows, "item string, group string, items bigint")
    out = assign_splits(df, [("train", 0.8), ("test", 0.1), ("none", 0.0), ("dev", 0.1), (None, 0.5)]).collect()
    assert len(out) == n and len({r["item"] for r in out}) == n
    by_group, count = {}, {}
    for r in out:
        by_group.setdefault(r["group"], set()).add(r["split_name"])
        count[r["split_name"]] = count.get(r["split_name"], 0) + 1
    assert all(len(s) == 1 for s in by_group.values())
    assert set(count) == {"train", "test", "dev"} and abs(count["train"] - 0.8 * n) <= 2 and abs(count["dev"] - 0.1 * n) <= 2
    assert RANK_BUCKET > 50
    assert assign_splits(df, [("none", 0.0)]).count() == 0
    assert assign_splits(df.limit(0), [("train", 1.0)]).count() == 0


def test_forest_of_many_batches(monkeypatch):
    monkeypatch.setattr(components, "EDGES_PER_TASK", 10)
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(150)}", f"n{rng.randrange(150)}") for _ in range(120)]
    hashed = [np.array([hash((7, x)) for x in side], np.int64) for side in zip(*pairs)]
    whole = pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), *map(pa.array, hashed)], ["a", "b", "a_hash", "b_hash"])
    got = {}
    for batch in components._local_forest(whole.slice(at, 7) for at in range(0, 120, 7)):
        for row in batch.to_pylist():
            got.setdefault(row["root"], set()).add(row["node"])
    assert {frozenset(g) for g in got.values()} == plain_groups(pairs)
