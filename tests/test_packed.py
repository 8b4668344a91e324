import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filmloom.operators.packed import DELIMITERS, explode_packed, split_packed


def plain(field):
    """Character by character: the rules of split_packed."""
    if field is None or field.strip(" ") == "\\N":
        return []
    parts, now, inside = [], "", False
    for ch in field:
        inside ^= ch == '"'
        if ch in DELIMITERS and not inside:
            parts.append(now)
            now = ""
        else:
            now += ch
    out = []
    for pos, part in enumerate([*parts, now], 1):
        value = part.strip(" ")
        if len(value) >= 2 and value[0] == value[-1] == '"' and '"' not in value[1:-1].replace('""', ""):
            value = value[1:-1].replace('""', '"')
        if value:
            out.append({"pos": pos, "value": value})
    return out


CASES = [None, "", " ", "\\N", " \\N ", "Drama", " Drama ,Action", "a,,b", ",", '"Crime, Organised","Animation"', '"The ""New"" Wave" | x', "Song & Dance·3D", "Horror，Comedy", '"open, rest', 'a "b, c" d;e', '""', '"" , x', '"""', '""""', "Sci-Fi/Children's", "é/ü", "x" * 100_000 + ",y"]


def test_cases():
    assert split_packed(pa.array(CASES, pa.string())).to_pylist() == [plain(c) for c in CASES]
    assert split_packed(pa.array([], pa.string())).to_pylist() == []


def test_sliced_input():
    assert split_packed(pa.array(CASES, pa.string()).slice(5, 7)).to_pylist() == [plain(c) for c in CASES[5:12]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet='ab ",;/|·，é\\N')), max_size=8))
def test_matches_plain(fields):
    assert split_packed(pa.array(fields, pa.string())).to_pylist() == [plain(f) for f in fields]


def test_frame(spark):
    df = spark.createDataFrame([("k", "a;b", 1), (None, "c", 2), ("k", None, 3)], "key string, field string, pos int")
    assert sorted(map(tuple, explode_packed(df, "key", "field").collect()), key=str) == sorted([("k", 1, "a"), ("k", 2, "b"), (None, 1, "c")], key=str)
    assert explode_packed(df.limit(0), "key", "field").count() == 0
