import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from filmloom.llm import leaks as module
from filmloom.llm.fm_index import FMIndex, suffix_array
from filmloom.llm.leaks import WORD, leaks, removal_spans


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.lists(st.lists(st.integers(1, 6), min_size=2, max_size=2), min_size=1, max_size=5))
def test_index_finds_all(text, patterns):
    text, patterns = np.array(text, np.int64), np.array(patterns, np.int64)
    whole = np.concatenate([text, [0]])
    assert [tuple(whole[i:]) for i in suffix_array(whole)] == sorted(tuple(whole[i:]) for i in range(len(whole)))
    index = FMIndex(text)
    low, high = index.search(patterns)
    for pattern, a, b in zip(patterns, low, high):
        places = sorted(index.locate(np.arange(a, b)).tolist())
        assert places == [i for i in range(len(text) - 1) if (text[i : i + 2] == pattern).all()]


def plain(docs, items, width):
    def windows(text):
        words = [w.casefold() for w in WORD.findall(text or "")]
        return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}

    return {(d, i) for d, t in docs for i, x in items if windows(t) & windows(x)}


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)] + ["Straße", "été", "12"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(3, 40)))) for i in range(12)] + [(3, "other text of a repeated item number"), (50, None), (51, "")]
    docs = []
    for d in range(60):
        words = rng.choices([*vocabulary, "new", "old", "x"], k=rng.randrange(40))
        if d % 3 == 0:
            source = rng.choice(items[:12])[1].split()
            at = rng.randrange(len(source))
            words += [w.upper() for w in source[at : at + rng.randrange(1, 12)]]
        docs.append((d, rng.choice([", ", " ", "--", "_", " "]).join(words)))
    docs += [(100, None), (101, ""), (102, "w1 " * 5000), (5, docs[6][1])]
    return docs, items


def test_against_windows(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame([(*x, "e") for x in docs], "doc_id long, text string, item string")
    e = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc int")
    want = plain(docs, items, 5)
    assert len(want) > 10
    assert {tuple(r) for r in leaks(d, e, 5).collect()} == want
    monkeypatch.setattr(module, "BLOCK_CHARS", 300)
    assert {tuple(r) for r in leaks(d, e, 5).collect()} == want
    monkeypatch.setattr(module, "BLOCK_CHARS", 10**7)
    assert leaks(d.limit(0), e, 5).count() == leaks(d, e.limit(0), 5).count() == 0


def test_pieces_and_shards(monkeypatch):
    monkeypatch.setattr(module, "PIECE_WORDS", 7)
    symbols = {f"w{i}": i + 2 for i in range(5)}
    words = [f"w{i % 5}" for i in range(23)]
    runs = list(module._runs(" ".join(words), symbols, 4))
    covered = {(at + k, tuple(run[k : k + 4])) for at, run in runs for k in range(len(run) - 3)}
    assert covered == {(i, tuple(symbols[w] for w in words[i : i + 4])) for i in range(20)}


def test_spans(spark):
    item = "one two three four five six"
    text = "start, ONE-two three; four five six! and one two three four end"
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    e = spark.createDataFrame([(9, item)], "item_id long, text string")
    rows = removal_spans(d, e, 4).collect()
    assert [(text[r["span_start"] : r["span_end"]], list(r["items"])) for r in rows] == [("ONE-two three; four five six", [9]), ("one two three four", [9])]


def test_blocks_change_nothing(spark, monkeypatch):
    """Spans and items are those of all items together, however many blocks these are held in."""
    docs, items = corpus()
    d, e = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    rows = lambda: sorted((r["doc_id"], tuple(r["items"]), r["span_start"], r["span_end"]) for r in removal_spans(d, e, 5).collect())
    whole = rows()
    for chars in (1, 200, 700):
        monkeypatch.setattr(module, "BLOCK_CHARS", chars)
        assert rows() == whole
    found = plain(docs, items, 5)
    assert {(doc, item) for doc, of, _, _ in whole for item in of} == found


def test_equal_windows_are_kept_once():
    texts = [np.array([2, 3, 4, 5, 2, 3, 4], np.int32), np.array([3, 4, 5], np.int32), np.array([9], np.int32)]
    windows = module.Windows([7, 8, 9], texts, 3)
    at = np.arange(len(windows))
    rows = list(zip(*(windows[at, k].tolist() for k in range(3))))
    owners = [windows.owners[a:b].tolist() for a, b in zip(windows.owner_start, windows.owner_start[1:])]
    assert dict(zip(rows, owners)) == {(2, 3, 4): [7], (3, 4, 5): [7, 8], (4, 5, 2): [7], (5, 2, 3): [7]}
    assert len(module.Windows([], [], 3)) == 0
