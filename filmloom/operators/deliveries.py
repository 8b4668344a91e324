"""Delimited lines: sound ones become typed fields, the others get the edits a parse of least cost would need."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost of one inserted or deleted quote in units of a delimiter edit: quotes are only touched where parity demands it.
QUOTE_COST = 1 << 32
#: Structural bytes of a line up to which `parse_lines` by itself keeps the places of the edits; deliveries have no bound.
TRACED_TOKENS = 4096
#: Tokens between stored costs, from which the steps of a wide line are found again, last segment first.
SEGMENT = 1024
#: States held at once by the dynamic programme.
DP_CELLS = 8 << 20
_FAR = np.int64(1) << 60


def least_cost_edits(kinds: np.ndarray, lengths: np.ndarray, fields: int, traced: bool) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Cost of the cheapest parse of each row of structural tokens, and its edits.

    kinds: rows by tokens, 1 for a quote, 0 for a delimiter; lengths: tokens of each row. A state is (inside quotes,
    delimiters so far). Between tokens a quote may be inserted at QUOTE_COST, outside quotes a delimiter at 1; a quote
    may be deleted at QUOTE_COST, a delimiter outside quotes at 1; one inside quotes is text. A parse ends outside
    quotes with `fields` fields. Edits: (rows, token index, code) with codes 0 insert quote, 1 insert delimiter,
    2 delete quote, 3 delete delimiter.
    """
    n, width = kinds.shape
    rows, states = np.arange(n), 2 * fields
    cost = np.full((n, states), _FAR)
    cost[:, 0] = 0
    identity = np.broadcast_to(np.arange(states, dtype=np.int16), (n, states))

    def gap(cost: np.ndarray, k: int, back: list | None) -> np.ndarray:
        alive = lengths >= k
        swapped = np.concatenate([cost[:, fields:], cost[:, :fields]], axis=1) + QUOTE_COST
        better = (swapped < cost) & alive[:, None]
        if back is not None:
            back.append(("quote", k, np.where(better, (identity + fields) % states, identity)))
        cost = np.where(better, swapped, cost)
        source = identity.copy()
        for f in range(1, fields):
            better = (cost[:, f - 1] + 1 < cost[:, f]) & alive
            cost[:, f] = np.where(better, cost[:, f - 1] + 1, cost[:, f])
            source[:, f] = np.where(better, source[:, f - 1], f)
        if back is not None:
            back.append(("delimiter", k, source))
        return cost

    def token(cost: np.ndarray, k: int, back: list | None) -> np.ndarray:
        alive = lengths > k
        quote = kinds[:, k] == 1
        # a quote: kept it toggles the half, deleted it leaves the state
        toggled = np.concatenate([cost[:, fields:], cost[:, :fields]], axis=1)
        deleted = cost + QUOTE_COST
        as_quote, from_quote = np.minimum(toggled, deleted), np.where(toggled <= deleted, (identity + fields) % states, identity)
        # a delimiter: outside quotes it opens a field or is deleted, inside it is text
        as_tab, from_tab = cost.copy(), identity.copy()
        as_tab[:, :fields] += 1
        opens = np.full((n, fields), _FAR)
        opens[:, 1:] = cost[:, : fields - 1]
        better = opens <= as_tab[:, :fields]
        as_tab[:, :fields] = np.where(better, opens, as_tab[:, :fields])
        from_tab[:, :fields] = np.where(better, identity[:, :fields] - 1, identity[:, :fields])
        new, source = np.where(quote[:, None], as_quote, as_tab), np.where(quote[:, None], from_quote, from_tab)
        if back is not None:
            back.append(("token", k, np.where(alive[:, None], source, identity).astype(np.int16)))
        return np.where(alive[:, None], new, cost)

    final = np.full(n, _FAR)
    saved: list[np.ndarray] = []
    first: list | None = [] if traced and width < SEGMENT else None
    for k in range(width + 1):
        if traced and k % SEGMENT == 0:
            saved.append(cost)
        cost = gap(cost, k, first)
        done = lengths == k
        final[done] = cost[done, fields - 1]
        if k < width:
            cost = token(cost, k, first)
    edits = []
    state = np.full(n, fields - 1)
    while saved:
        cost, back = saved.pop(), first or []
        at = len(saved) * SEGMENT
        for k in range(at, min(at + SEGMENT, width + 1)) if first is None else ():
            cost = gap(cost, k, back)
            if k < width:
                cost = token(cost, k, back)
        for what, k, source in reversed(back):
            active = lengths >= k if what != "token" else lengths > k
            prior = source[rows, state]
            if what == "quote":
                hit = np.flatnonzero(active & (prior != state))
                edits.append((hit, np.full(len(hit), k), np.zeros(len(hit), np.int8)))
            elif what == "delimiter":
                many = np.where(active, state - prior, 0)
                hit = np.repeat(rows, many)
                edits.append((hit, np.full(len(hit), k), np.ones(len(hit), np.int8)))
            else:
                hit = np.flatnonzero(active & (prior == state) & ((kinds[:, k] == 1) | (state < fields)))
                edits.append((hit, np.full(len(hit), k), np.where(kinds[hit, k] == 1, 2, 3).astype(np.int8)))
            state = np.where(active, prior, state)
    return final, edits[::-1]


_NAMES = np.array(['+"', "+delimiter", '-"', "-delimiter"], dtype=object)


def parse_lines(lines: pa.StringArray, fields: int, delimiter: str = "\t", traced_tokens: int | None = TRACED_TOKENS) -> pa.StructArray:
    """{fields, quote_edits, delimiter_edits, edits} of each line; `fields` is null unless the parse costs nothing.

    Quote and delimiter bytes are found over the whole text buffer; running counts give each delimiter's quote parity,
    so lines of cost zero are cut without looking at single rows. The others go through `least_cost_edits`. A null line
    counts as an empty one. Of lines of more than `traced_tokens` quotes and delimiters (None: no bound) only the numbers
    of edits are given, whatever other lines there are.
    """
    n = len(lines)
    lines = pc.fill_null(lines, "")
    raw = np.frombuffer(lines.buffers()[1], dtype=np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", dtype=np.uint8)[raw[0] : raw[-1]]
    bounds = raw - raw[0]
    is_quote, is_tab = data == 0x22, data == ord(delimiter)
    quotes = np.concatenate([[0], np.cumsum(is_quote, dtype=np.int64)])
    tabs = np.flatnonzero(is_tab)
    row = np.searchsorted(bounds, tabs, side="right") - 1
    outside = (quotes[tabs] - quotes[bounds[row]]) % 2 == 0
    tabs, row = tabs[outside], row[outside]
    sound = ((quotes[bounds[1:]] - quotes[bounds[:-1]]) % 2 == 0) & (np.bincount(row, minlength=n) == fields - 1)

    cuts = tabs[sound[row]].reshape(-1, fields - 1)
    start = np.concatenate([bounds[:-1][sound, None], cuts + 1], axis=1).ravel()
    end = np.concatenate([cuts, bounds[1:][sound, None]], axis=1).ravel()
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    values = pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at])))
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(size) + 1, fields, dtype=np.int32)), values)
    place = np.cumsum(sound) - 1
    cells = lists.take(pa.array(place, pa.int64(), mask=~sound))

    quote_edits, delimiter_edits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    texts = np.full(n, None, dtype=object)
    tokens = np.flatnonzero(is_quote | is_tab)
    first = np.searchsorted(tokens, bounds)
    count = np.diff(first)
    bad = np.flatnonzero(~sound)
    bad = bad[np.argsort(count[bad], kind="stable")]
    while len(bad):
        widths = np.maximum(count[bad], 1)
        step = max(1, int(np.searchsorted(np.arange(1, len(bad) + 1) * widths * 2 * fields, DP_CELLS)))
        if traced_tokens is not None:  # no line within the bound shares a block with one beyond
            step = min(step, int(np.searchsorted(count[bad], traced_tokens, side="right")) or step)
        now, bad = bad[:step], bad[step:]
        width = int(count[now].max())
        kinds = np.zeros((len(now), width), np.int8)
        inner = np.arange(width)[None, :] < count[now][:, None]
        kinds[inner] = is_quote[tokens[np.concatenate([np.arange(first[r], first[r + 1]) for r in now])]] if inner.any() else 0
        cost, edits = least_cost_edits(kinds, count[now], fields, traced_tokens is None or width <= traced_tokens)
        quote_edits[now], delimiter_edits[now] = cost // QUOTE_COST, cost % QUOTE_COST
        if edits:
            r, k, code = (np.concatenate(x) for x in zip(*edits))
            order = np.lexsort((k, r))
            r, k, code = now[r[order]], k[order], code[order]
            byte = np.where(k < count[r], tokens[np.minimum(first[r] + k, max(len(tokens) - 1, 0))] if len(tokens) else 0, bounds[r + 1]) - bounds[r]
            words = _NAMES[code] + np.array([f"@{b}" for b in byte], dtype=object)
            for i, piece in zip(now_first := np.flatnonzero(np.concatenate([[True], np.diff(r) != 0])) if len(r) else [], np.split(words, now_first[1:]) if len(r) else []):
                texts[r[i]] = " ".join(piece)
        for i in now:
            if texts[i] is None:
                texts[i] = f"{quote_edits[i]} quote and {delimiter_edits[i]} delimiter edits"
    return pa.StructArray.from_arrays(
        [cells, pa.array(quote_edits), pa.array(delimiter_edits), pa.array(texts, pa.string())], ["fields", "quote_edits", "delimiter_edits", "edits"]
    )


def digits_between(text: Column, low: int, high: int) -> Column:
    r"""Whether `text`, blanks trimmed, is `\N` or ASCII digits only with a value from `low` to `high`."""
    bare = F.trim(text)
    number = F.when(bare.rlike(r"\A0*[0-9]{1,18}\z"), bare.try_cast("bigint"))
    return (bare == "\\N") | F.coalesce(number.between(low, high), F.lit(False))


def parse_deliveries(df: DataFrame, row_id: str, line: str, fields: int, checks: list[tuple[str, int, int, int]], delimiter: str = "\t") -> DataFrame:
    """Parsed lines (row_id, fields, reason, edits, quote_edits, delimiter_edits): `reason` is null for sound lines, `fields` null for the others.

    The first reason that applies: `quoting` if the cheapest parse edits a quote, `columns` if it edits delimiters, the
    name of the first failing check (name, field from 0, least, greatest). No shuffle; one pass; other columns are not
    read; rows that occur twice come out twice; a null or empty line fails by `columns`.
    """
    kind = df.schema[row_id].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, batch.num_rows * (16 << 20) // max(16 << 20, batch.nbytes))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                parsed = parse_lines(piece.column(1).cast(pa.string()), fields, delimiter, None)
                yield pa.RecordBatch.from_arrays([piece.column(0), *parsed.flatten()], ["row_id", "fields", "quote_edits", "delimiter_edits", "edits"])

    parsed = df.select(F.col(row_id).alias("row_id"), F.col(line).alias("line")).mapInArrow(
        scan, f"row_id {kind}, fields array<string>, quote_edits bigint, delimiter_edits bigint, edits string"
    )
    reason = F.when(F.col("quote_edits") > 0, "quoting").when(F.col("delimiter_edits") > 0, "columns")
    for name, index, low, high in checks:
        reason = reason.when(~digits_between(F.col("fields")[index], low, high), name)
    parsed = parsed.select("row_id", "fields", reason.alias("reason"), "edits", "quote_edits", "delimiter_edits")
    return parsed.withColumn("fields", F.when(F.col("reason").isNull(), F.col("fields")))


def plain_text(field: Column) -> Column:
    r"""A field's text: `\N` is null; one wholly in double quotes loses them and its doubled quotes become single."""
    wrapped = field.rlike(r'\A"(?s:[^"]|"")*"\z') & (F.length(field) >= 2)
    return F.when(field != "\\N", F.when(wrapped, F.replace(field.substr(F.lit(2), F.length(field) - 2), F.lit('""'), F.lit('"'))).otherwise(field))
