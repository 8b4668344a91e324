"""Several values packed into one field: vectorised splitting over Arrow string buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Separators accepted side by side in one field: comma, semicolon, slash, bar, middle dot, full-width comma.
DELIMITERS = (",", ";", "/", "|", "·", "，")
#: Bytes of text that are scanned at once; longer batches are sliced at row borders.
SCAN_BYTES = 16 << 20


def _inclusive(mask: np.ndarray) -> np.ndarray:
    return np.cumsum(mask, dtype=np.int64)


def _strip(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without outer blanks; a span of blanks only becomes empty."""
    solid = np.concatenate([[0], _inclusive(data != 0x20)])
    places = np.flatnonzero(data != 0x20)
    some = solid[end] > solid[start]
    if not some.any():
        return start, start.copy()
    first = places[np.minimum(solid[start], len(places) - 1)]
    last = places[np.maximum(solid[end], 1) - 1] + 1
    return np.where(some, first, start), np.where(some, last, start)


def _take(data: np.ndarray, start: np.ndarray, end: np.ndarray, drop: np.ndarray | None = None) -> pa.StringArray:
    """The spans as strings, without the bytes marked in `drop`."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    if drop is not None:
        kept = ~drop[at]
        counts = np.concatenate([[0], _inclusive(kept)])
        at, offsets = at[kept], counts[offsets]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))


def split_packed(column: pa.StringArray, delimiters: tuple[str, ...] = DELIMITERS, null_text: str = "\\N") -> pa.ListArray:
    r"""A list of {pos, value} for each field of `column`.

    Works on the text buffer as a whole: the running count of double quotes gives each byte's quote parity, delimiter
    bytes outside quotes become child offsets, blanks are trimmed and quotes removed by masks, and list offsets tie the
    children to their parents. A quote run never leaks into the next field, as parity counts from the field's start; an
    unclosed quote keeps the rest of the field in one value. `pos` counts from 1 and includes empty places, which give
    no value. Null, `\N` and empty fields give an empty list. A value wholly in double quotes loses them and its
    doubled quotes become single; any other quote stays.
    """
    column = column.cast(pa.string()).combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    none = pc.or_kleene(pc.is_null(column), pc.equal(pc.utf8_trim(column, " "), null_text))
    column = pc.if_else(none, "", column)
    raw = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[raw[0] : raw[-1]]
    bounds = raw - raw[0]
    quotes = np.concatenate([[0], _inclusive(data == 0x22)])
    row_quotes = quotes[bounds]
    before = quotes[:-1]  # quotes before each byte

    # Delimiters: first byte of each, outside quotes counted from the field's start.
    mark = np.zeros(len(data), dtype=np.int8)
    for d in delimiters:
        code = d.encode()
        hit = data == code[0]
        for k, byte in enumerate(code[1:], 1):
            hit[: len(data) - k] &= data[k:] == byte
            hit[len(data) - k :] = False
        mark[hit] = len(code)
    places = np.flatnonzero(mark)
    row = np.searchsorted(bounds, places, side="right") - 1
    outside = (before[places] - row_quotes[row]) % 2 == 0
    places, row = places[outside], row[outside]

    # Spans: each field's start and each delimiter's end open one; starts sort before delimiters of the same row.
    per_row = np.bincount(row, minlength=n) + 1
    first = np.concatenate([[0], np.cumsum(per_row)])
    start, end = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    rank = np.arange(len(places)) - np.concatenate([[0], np.cumsum(per_row - 1)])[row]
    start[first[:-1]], end[first[1:] - 1] = bounds[:-1], bounds[1:]
    slot = first[row] + rank
    start[slot + 1], end[slot] = places + mark[places], places
    parent = np.repeat(np.arange(n), per_row)
    pos = np.arange(first[-1]) - first[parent] + 1

    start, end = _strip(data, start, end)
    quoted = end - start >= 2
    quoted[quoted] &= (data[start[quoted]] == 0x22) & (data[end[quoted] - 1] == 0x22)
    # Wholly quoted: every inner quote is one of a doubled pair, so each run of inner quotes has even length.
    is_quote = data == 0x22
    inner_start, inner_end = start + quoted, end - quoted
    drop = np.zeros(len(data), dtype=bool)
    q = np.flatnonzero(is_quote)
    if len(q):
        span = np.searchsorted(start, q, side="right") - 1
        inside = (span >= 0) & (q >= inner_start[span]) & (q < inner_end[span]) & quoted[span]
        q, span = q[inside], span[inside]
        if len(q):
            new_run = np.concatenate([[True], (np.diff(q) != 1) | (np.diff(span) != 0)])
            run = np.cumsum(new_run) - 1
            length = np.bincount(run)
            odd_span = np.unique(span[new_run][length % 2 == 1])
            quoted[odd_span] = False
            step = np.arange(len(q)) - np.flatnonzero(new_run)[run]
            drop[q[(step % 2 == 1) & quoted[span]]] = True
    start, end = start + quoted, end - quoted
    trimmed_start, trimmed_end = start, end
    keep = trimmed_end > trimmed_start
    values = _take(data, trimmed_start[keep], trimmed_end[keep], drop)
    parent, pos = parent[keep], pos[keep]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(parent, minlength=n))]).astype(np.int32)
    children = pa.StructArray.from_arrays([pa.array(pos, pa.int64()), values], ["pos", "value"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), children)


def _slices(batch: pa.RecordBatch, index: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about SCAN_BYTES of text."""
    step = max(1, batch.num_rows * SCAN_BYTES // max(SCAN_BYTES, batch.column(index).nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def explode_packed(df: DataFrame, key: str, field: str, delimiters: tuple[str, ...] = DELIMITERS) -> DataFrame:
    """One row (key, pos, value) per value packed in `field`; see `split_packed` for the rules.

    No shuffle: rows stay in their partition. Rows with a null key keep their values under a null key; repeated rows
    give repeated values; other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch, 1):
                lists = split_packed(piece.column(1), delimiters)
                child = lists.flatten()
                yield pa.RecordBatch.from_arrays(
                    [pc.take(piece.column(0), pc.list_parent_indices(lists)), child.field(0), child.field(1)], ["key", "pos", "value"]
                )

    slim = df.select(F.col(key).alias("key"), F.col(field).cast("string").alias("field"))
    return slim.mapInArrow(scan, f"key {slim.schema['key'].dataType.simpleString()}, pos bigint, value string")
