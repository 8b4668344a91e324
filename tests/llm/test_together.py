import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from filmloom.llm import together
from filmloom.llm.together import chunk_product, pairs_together


def plain(rows, least, lift):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    alone, pairs, n = Counter(), Counter(), len(baskets)
    for items in baskets.values():
        alone.update(items)
        pairs.update(combinations(sorted(items), 2))
    return {(a, b, c, alone[a], alone[b], n) for (a, b), c in pairs.items() if c >= least and c * n >= lift * alone[a] * alone[b]}


def test_chunk_product():
    item = np.array([4, 1, 3, 1, 4])
    basket = np.array([0, 0, 0, 1, 1])
    codes, n = chunk_product(item, basket, np.zeros(5, int), 0, 0, 10)
    assert dict(zip(codes.tolist(), n.tolist())) == {13: 1, 14: 2, 34: 1}
    codes, n = chunk_product(item, basket, (item == 4).astype(int), 0, 1, 10)
    assert dict(zip(codes.tolist(), n.tolist())) == {14: 2, 34: 1}


@pytest.mark.parametrize("least,lift", [(1, 0), (2, 1.5), (3, 3)])
def test_against_counting(spark, monkeypatch, least, lift):
    monkeypatch.setattr(together, "ORDINARY", 8)
    monkeypatch.setattr(together, "CHUNK_ITEMS", 10)
    monkeypatch.setattr(together, "TASK_ROWS", 60)
    rng = random.Random(4)
    rows = [(f"b{rng.randrange(60)}", f"i{int(rng.paretovariate(0.6)) % 70}") for _ in range(700)]
    for huge in ("h1", "h2", "h3"):
        rows += [(huge, f"i{k}") for k in rng.sample(range(70), 45)]
    rows += rows[:50] + [(None, "i1"), ("b1", None), ("lonely", "only")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "basket string, item string, size int")
    got = pairs_together(df, least, lift)
    assert got.columns == ["a", "b", "n_ab", "n_a", "n_b", "n"]
    assert {tuple(r) for r in got.collect()} == plain(rows, least, lift)
    assert pairs_together(df.limit(0), least, lift).count() == 0


def test_rows_are_copied_by_their_own_basket(spark):
    """One basket of 5,000 items beside thousands of 65 to 100."""
    sizes = {"huge": 5000} | {f"b{i}": 65 + i % 36 for i in range(2000)}
    huge = spark.createDataFrame(list(sizes.items()), "basket string, size long")
    rows = huge.selectExpr("basket", "explode(sequence(1, size)) as i").selectExpr("basket", "'i' || i as item", "1L as holders")
    spread = together.spread_chunks(rows, huge)
    copies = {r["basket"]: (r["count"], r["chunks"]) for r in spread.groupBy("basket", "chunks").count().collect()}
    assert copies.pop("huge") == (5000 * 8, 8)
    assert all(copies[b] == (n, 1) for b, n in sizes.items() if b != "huge")
    tasks = [r["count"] for r in spread.groupBy("chunks", "part", "left", "right").count().collect()]
    assert max(tasks) < 2 * together.TASK_ROWS and len(tasks) >= 8 * 9 // 2 + 5


def test_huge_basket_among_others(spark, monkeypatch):
    monkeypatch.setattr(together, "ORDINARY", 8)
    rng = random.Random(12)
    rows = [("huge", f"i{k}") for k in range(300)] + [(f"b{b}", f"i{k}") for b in range(80) for k in rng.sample(range(300), 9 + b % 30)]
    df = spark.createDataFrame(rows, "basket string, item string")
    assert {tuple(r) for r in pairs_together(df, 3, 1.2, chunk_items=16).collect()} == plain(rows, 3, 1.2)
