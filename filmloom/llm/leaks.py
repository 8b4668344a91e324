"""Evaluation passages inside training text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.llm.fm_index import FMIndex
from filmloom.scratch import cut

WORD = re.compile(r"[^\W_]+")
#: Consecutive words of an item that make a leak.
LEAK_WORDS = 12
#: Words of one shard's index, and of the pieces that a longer run of words is cut into.
SHARD_WORDS, PIECE_WORDS = 1_000_000, 100_000
#: Characters of evaluation text that a task holds at once; a shard is searched for more block by block.
BLOCK_CHARS = 32_000_000


def folded(text: str) -> list[str]:
    """The words of a text in comparable form."""
    return [m.group().casefold() for m in WORD.finditer(text)]


@lru_cache(1)
def _symbols(files: tuple[str, ...]) -> dict[str, int]:
    """The number of each word of a stored vocabulary, from 2; 1 stands for whatever separates."""
    words = (w for batch in _batches(files) for w in batch.column(0).to_pylist())
    return {word: i for i, word in enumerate(words, 2)}


def _batches(files: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    for name in files:
        system, path = FileSystem.from_uri(name)
        with system.open_input_file(path) as source:
            yield from pq.ParquetFile(source).iter_batches(4096)


class Windows:
    """All windows of `width` symbols of a block of items, equal ones once; an array of rows, without their storage."""

    def __init__(self, items: list[int], texts: list[np.ndarray], width: int):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.text = np.concatenate([*texts, np.zeros(0, np.int32)]).astype(np.int32)
        first = np.cumsum(sizes) - sizes
        many = np.maximum(sizes - width + 1, 0)
        start = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(sizes) else np.zeros(0, np.int64)
        owner = np.repeat(np.array(items, np.int64), many)
        code = np.zeros(len(start), np.uint64)
        for k in range(width):
            code = code * np.uint64(0x9E3779B97F4A7C15) + self.text[start + k].astype(np.uint64) + np.uint64(1)
        _, chosen, place = np.unique(code, return_index=True, return_inverse=True)
        other = np.zeros(len(start), bool)  # of equal code, but another window
        for k in range(width):
            other |= self.text[start + k] != self.text[start[chosen[place]] + k]
        place[other] = len(chosen) + np.arange(other.sum())
        self.start = np.concatenate([start[chosen], start[other]])
        pairs = np.unique(np.stack([place, owner], axis=1), axis=0)
        self.owner_start = np.searchsorted(pairs[:, 0], np.arange(len(self.start) + 1))
        self.owners = pairs[:, 1]
        self.shape = (len(self.start), width)

    def __len__(self) -> int:
        return len(self.start)

    def __getitem__(self, at: tuple[np.ndarray, int]) -> np.ndarray:
        return self.text[self.start[at[0]] + at[1]]


@dataclass(frozen=True)
class Phrases:
    """Evaluation items as files in the shared folder: their vocabulary, and (item, chars, symbols) of each."""

    vocabulary: tuple[str, ...]
    items: tuple[str, ...]
    width: int
    block_chars: int

    def symbols(self) -> dict[str, int]:
        return _symbols(self.vocabulary)

    def blocks(self) -> Iterator[Windows]:
        """The windows of all items, in blocks of about `block_chars`; a single block is read once by a worker."""
        if (kept := _only_block.get(self)) is not None:
            yield kept
            return
        items, texts, chars, number = [], [], 0, 0
        for batch in _batches(self.items):
            for item, size, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                items.append(item)
                texts.append(symbols.values.to_numpy(zero_copy_only=False))
                chars += size
                if chars >= self.block_chars:
                    yield Windows(items, texts, self.width)
                    items, texts, chars, number = [], [], 0, number + 1
        last = Windows(items, texts, self.width)
        if not number:
            _only_block.clear()
            _only_block[self] = last
        yield last


_only_block: dict[Phrases, Windows] = {}


def store_phrases(items: DataFrame, width: int) -> Phrases:
    """Writes the items (item_id, text) as numbers of words; tasks do the work, and the driver sees file names only."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w for t in batch.column(0).to_pylist() for w in folded(t)}), pa.string())], ["word"])

    vocabulary = cut(items.select("text").mapInArrow(words, "word string").distinct())
    files = tuple(sorted(vocabulary.inputFiles()))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _symbols(files)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            symbols = pa.array([[number[w] for w in folded(t)] for t in texts], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), symbols], ["item", "chars", "symbols"])

    stored = cut(items.mapInArrow(encode, "item bigint, chars bigint, symbols array<int>"))
    return Phrases(files, tuple(sorted(stored.inputFiles())), width, BLOCK_CHARS)


def _runs(text: str, symbols: dict[str, int], width: int) -> Iterator[tuple[int, list[int]]]:
    """Runs (first word, symbols) of words that all occur in evaluation text; shorter ones than `width` hold no phrase.

    A run of more than PIECE_WORDS is cut into pieces that overlap by one word less than a phrase.
    """
    now: list[int] = []
    get, at = symbols.get, 0
    for at, match in enumerate(WORD.finditer(text)):
        code = get(match.group().casefold())
        if code is not None:
            now.append(code)
            if len(now) == PIECE_WORDS:
                yield at + 1 - len(now), now
                now = now[1 - width :]
        elif now:
            if len(now) >= width:
                yield at - len(now), now
            now = []
    if len(now) >= width:
        yield at + 1 - len(now), now


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs in their order."""
    least, width = (b.min(), int(b.max()) - int(b.min()) + 1) if len(b) else (0, 1)
    if len(a) and (int(a.max()) + 1) * width > np.iinfo(np.int64).max:
        both = np.unique(np.stack([a, b], axis=1), axis=0)
        return both[:, 0], both[:, 1]
    codes = np.unique(a * width + (b - least))
    return codes // width, codes % width + least


def _search_shard(docs: list[int], firsts: list[int], runs: list[list[int]], phrases: Phrases, places: bool) -> tuple[np.ndarray, ...]:
    """Distinct (document index, item) of the matches in the runs of a shard; with `places` (document index, first word) as well."""
    sizes = np.array([len(r) + 1 for r in runs])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    text = np.ones(starts[-1], np.int64)
    for at, run in zip(starts, runs):
        text[at : at + len(run)] = run
    index = FMIndex(text)
    words, items = [], []
    for windows in phrases.blocks():
        low, high = index.search(windows)
        hit = np.flatnonzero(high > low)
        many = (high - low)[hit]
        rows = np.repeat(low[hit] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        position = index.locate(rows)
        run = np.searchsorted(starts, position, side="right") - 1
        doc = np.array(docs)[run]
        if places:
            words.append((doc, np.array(firsts)[run] + position - starts[run]))
        doc, phrase = _distinct(doc, np.repeat(hit, many))
        owned = (windows.owner_start[phrase + 1] - windows.owner_start[phrase]).astype(np.int64)
        owner = windows.owners[np.repeat(windows.owner_start[phrase] - np.concatenate([[0], np.cumsum(owned)[:-1]]), owned) + np.arange(owned.sum())]
        items.append((np.repeat(doc, owned), owner))
    return tuple(x for pairs in (items, words) if pairs for x in _distinct(*(np.concatenate(side) for side in zip(*pairs))))


def _merged(text: str, words: np.ndarray, width: int) -> list[dict[str, int]]:
    """Character spans of the matched words, merged where they touch or overlap."""
    wanted = np.unique(words)
    spans: list[dict[str, int]] = []
    bounds = [(m.start(), m.end()) for m in WORD.finditer(text)]
    last = -1
    for first in wanted:
        if spans and first <= last + 1:
            spans[-1]["end"] = bounds[first + width - 1][1]
        else:
            spans.append({"start": bounds[first][0], "end": bounds[first + width - 1][1]})
        last = first + width - 1
    return spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scan(phrases: Phrases, spans: bool):
    def close(ids: pa.Array, texts: list[str], docs: list[int], firsts: list[int], runs: list[list[int]]) -> Iterator[pa.RecordBatch]:
        if not runs:
            return
        doc, item, *places = _search_shard(docs, firsts, runs, phrases, spans)
        if spans:
            hit, first = np.unique(places[0], return_index=True)
            _, first_item = np.unique(doc, return_index=True)
            merged = pa.array([_merged(texts[d], w, phrases.width) for d, w in zip(hit, np.split(places[1], first[1:]))], _SPANS)
            owners = pa.array([x.tolist() for x in np.split(item, first_item[1:])][: len(hit)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(hit)), owners, merged], ["doc", "items", "spans"])
        else:
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(item)], ["doc", "item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, docs, firsts, runs, size = [], [], [], [], [], 0
        symbols_of = phrases.symbols()
        for batch in batches:
            ids.append(batch.column(0))
            for text in batch.column(1).to_pylist():
                found = False
                for first, symbols in _runs(text or "", symbols_of, phrases.width):
                    docs.append(len(texts))
                    firsts.append(first)
                    runs.append(symbols)
                    size += len(symbols) + 1
                    found = True
                texts.append(text if found and spans else None)
            if size >= SHARD_WORDS:
                yield from close(pa.chunked_array(ids).combine_chunks(), texts, docs, firsts, runs)
                ids, texts, docs, firsts, runs, size = [], [], [], [], [], 0
        if ids:
            yield from close(pa.chunked_array(ids).combine_chunks(), texts, docs, firsts, runs)

    return run


def _found(documents: DataFrame, items: DataFrame, width: int, spans: bool) -> DataFrame:
    items = items.select(F.col("item_id").cast("bigint"), "text").where("item_id is not null and text is not null")
    docs = documents.select(F.col("doc_id").alias("doc"), "text").where("doc_id is not null and text is not null")
    kind = docs.schema["doc"].dataType.simpleString()
    schema = f"doc {kind}, items array<bigint>, spans array<struct<start: bigint, `end`: bigint>>" if spans else f"doc {kind}, item bigint"
    return docs.mapInArrow(_scan(store_phrases(items, width), spans), schema)


def leaks(documents: DataFrame, items: DataFrame, width: int = LEAK_WORDS) -> DataFrame:
    """Distinct (doc_id, item_id) where a document (doc_id, text) has `width` consecutive words of an item in its order.

    Words are maximal runs of letters and digits and compare by case folding. Each task indexes its documents in shards
    of about SHARD_WORDS words: a wavelet matrix over the Burrows-Wheeler transform, in which all phrases of the items
    are sought backwards at once and found by sampled positions. Runs of fewer than `width` words that occur in the
    items at all can hold no phrase and stay out of the index. No shuffle but that of the result's distinct rows.

    Null and empty texts hold nothing; items of fewer than `width` words leak nowhere; a document id that occurs twice
    stands for both texts; other columns are not read. The items are written once as numbers of words; tasks read them
    from the shared folder, in blocks of BLOCK_CHARS, each shard meets all blocks in the one pass over the documents.
    """
    return _found(documents, items, width, False).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def removal_spans(documents: DataFrame, items: DataFrame, width: int = LEAK_WORDS) -> DataFrame:
    """(doc_id, items, span_start, span_end): the leaked stretches of each document, as character offsets of its text.

    Matches that overlap or touch are one span, whichever items they are of.
    """
    found = _found(documents, items, width, True)
    return found.select(F.col("doc").alias("doc_id"), "items", F.explode("spans").alias("s")).select("doc_id", "items", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"))
