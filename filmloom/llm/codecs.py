"""Encodings and what a text becomes when one is mistaken for another."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property, lru_cache

# The single-byte encodings that a text may have been read in, most usual first; UTF8 names the source.
SINGLE_BYTE = (
    "cp1252", "latin_1", "cp1250", "cp1251", "cp1254", "mac_roman", "cp437", "cp850", "cp852", "cp866", "koi8_r", "koi8_u", "cp1253", "cp1257",
    "iso8859_2", "iso8859_5", "iso8859_7", "iso8859_9", "iso8859_15", "mac_cyrillic", "mac_latin2", "mac_turkish", "cp855", "cp857",
)
UTF8 = "utf_8"
# The encodings of up to two bytes a character that a text may have been stored in.
DOUBLE_BYTE = ("cp932", "gbk", "big5", "euc_jp", "euc_kr")
#: Well-formed UTF-8 sequences of several bytes, one character per byte.
_SEQUENCES = re.compile("(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
_RUN = re.compile("[\x80-\U0010ffff]+")


@lru_cache(None)
def reads(codec: str) -> tuple[str, ...]:
    """The character of each byte from 0x80; bytes without one are read as control characters."""
    return tuple(c if (c := bytes([b]).decode(codec, "replace")) != "�" else chr(b) for b in range(128, 256))


@lru_cache(None)
def writes(codec: str) -> dict[str, int]:
    """The byte of each character beyond ASCII."""
    return {c: b for b, c in enumerate(reads(codec), 128)}


@lru_cache(None)
def _as_bytes(codec: str) -> dict[int, str]:
    return {ord(c): chr(b) for c, b in writes(codec).items()}


class _Shifted(dict):
    """Characters that a codec lacks move out of the way of its bytes."""

    def __missing__(self, code: int) -> int:
        self[code] = value = code if code < 128 else 0x100000 + code % 0xFFFF
        return value


@lru_cache(None)
def _table(codec: str) -> _Shifted:
    return _Shifted(_as_bytes(codec))


def garble(text: str, source: str, read_as: str) -> str | None:
    """`text`, stored in `source`, as read in `read_as`; None if `source` can't store it."""
    if source == UTF8:
        data = text.encode("utf-8", "surrogatepass")
    elif source in DOUBLE_BYTE:
        try:
            data = text.encode(source)
        except UnicodeEncodeError:
            return None
    else:
        table = writes(source)
        try:
            data = bytes(ord(c) if c < "\x80" else table[c] for c in text)
        except KeyError:
            return None
    table = reads(read_as)
    return "".join(chr(b) if b < 128 else table[b - 128] for b in data)


@lru_cache(1 << 16)
def image(char: str, source: str, read_as: str) -> str | None:
    """`garble` of one character."""
    return garble(char, source, read_as)


def undo_double(text: str, source: str, read_as: str) -> str | None:
    """The inverse of `garble` for a source in DOUBLE_BYTE; None if it can't have made the text.

    A last character whose second byte is missing, as where a word ends before a sign, stays as it is.
    """
    back = writes(read_as)
    try:
        data = bytes(ord(c) if c < "\x80" else back[c] for c in text)
        return data.decode(source)
    except KeyError:
        return None
    except UnicodeDecodeError as e:
        return data[:-1].decode(source) + text[-1] if 0 < e.start == len(data) - 1 else None


class _Moved(dict):
    """Characters beyond ASCII by code; those that are not in the table become a zero."""

    def __missing__(self, code: int) -> int:
        self[code] = value = code if code < 128 else 0
        return value


@lru_cache(None)
def _moved(source: str, read_as: str) -> _Moved:
    table = reads(source)
    return _Moved({ord(c): ord(table[b - 128]) for c, b in writes(read_as).items()})


def undo_single(text: str, source: str, read_as: str) -> str | None:
    """The inverse of `garble` for two single-byte encodings; None if `read_as` lacks a character of the text."""
    moved = text.translate(_moved(source, read_as))
    return None if "\0" in moved and "\0" not in text else moved


@lru_cache(None)
def _starts(codec: str) -> re.Pattern:
    """The first two characters of a UTF-8 sequence read in `codec`."""
    chars = reads(codec)
    return re.compile(f"[{re.escape(''.join(chars[0x42:0x75]))}][{re.escape(''.join(chars[:0x40]))}]")


def undo_utf8(text: str, read_as: str, plausible) -> str:
    """`text` with each run beyond ASCII decoded that is, as a whole, UTF-8 read in `read_as`.

    A run stays as it is unless plausible(before, run, decoded, after) holds.
    """
    if not _starts(read_as).search(text):
        return text
    data = text.translate(_table(read_as))
    out, last = [], 0
    for run in _RUN.finditer(data):
        if _SEQUENCES.fullmatch(run.group()):
            start, end = run.span()
            decoded = run.group().encode("latin-1").decode("utf-8", "replace")
            if "\ufffd" not in decoded and plausible(text[:start], text[start:end], decoded, text[end:]):
                out += [text[last:start], decoded]
                last = end
    return "".join([*out, text[last:]])


@dataclass(frozen=True)
class Mistake:
    """A transformation of characters: one that twins have shown, by (garbled, clean) pieces, or that of a pair of encodings."""

    stored: str = ""
    read: str = ""
    pieces: tuple[tuple[str, str], ...] = ()

    @cached_property
    def _clean(self) -> dict[str, str]:
        return dict(self.pieces)

    @cached_property
    def _pattern(self) -> re.Pattern:
        return re.compile("|".join(re.escape(g) for g, _ in sorted(self.pieces, key=lambda x: (-len(x[0]), x))) + "|[\x80-\U0010ffff]")

    def undo(self, text: str) -> str | None:
        """What `text` was before, as a whole; None if the mistake can't have made it. Not for UTF8, see `undo_utf8`."""
        if self.pieces:
            try:
                return self._pattern.sub(lambda m: self._clean[m.group()], text)
            except KeyError:
                return None
        return (undo_double if self.stored in DOUBLE_BYTE else undo_single)(text, self.stored, self.read)
