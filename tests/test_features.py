import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from filmloom.functions.features import clamp_rating, round_cents, serving_actor_key, training_actor_key, votes_log, within_bounds
from filmloom.functions.keys import clean_key
from filmloom.functions.text import FRANCHISE_WORDS, is_blank, normalize_genre, normalize_genres, strip_space, title_features


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_keys(spark):
    assert values(spark, [" TT1 ", "tt1", "", "  ", "\\N", " \\n", None], clean_key) == ["tt1", "tt1", None, None, None, None, None]


@pytest.mark.parametrize(
    "genre,want",
    [("film-noir", "Film-Noir"), ("3d", "3D"), ("children's", "Children'S"), ("sci fi", "Sci-Fi"), (" Science Fiction ", "Sci-Fi"), ("RomCom", "Romance"), ("scifi", "Scifi"),
     ("a--b", "A-B"), ("-", ""), ("", ""), (None, ""), ("élan vital", "Élan Vital")],
)
def test_genre(spark, genre, want):
    assert values(spark, [genre], normalize_genre) == [want]


def test_genre_lists(spark):
    rows = ["", None, " , ", "-", "science fiction,sci-fi", "drama, ACTION ,,drama"]
    assert values(spark, rows, normalize_genres) == ["Unknown", "Unknown", "Unknown", "", "Sci-Fi,Sci-Fi", "Drama,Action,Drama"]


TITLES = ["The Author", "Spider-Man: Brand New Day", "Supergirl", "007", "a b\x85c\x1cd", " ", "x" * 50_000, "٣ films", "Émile 🎬", "SOLO"]


def test_title_features(spark):
    names = list(title_features(F.col("x")))
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TITLES, "", None])], "i int, x string")
    rows = df.orderBy("i").select(*(c.alias(n) for n, c in title_features(F.col("x")).items())).collect()
    for title, row in zip(TITLES, rows):
        low = title.lower()
        want = [int(any(w in low for w in words)) for words in FRANCHISE_WORDS.values()]
        want += [len(title), len(title.split()), int(bool(re.search(r"\d", title))), int(":" in title)]
        assert [row[n] for n in names] == want, title
    assert all(row[n] is None for row in rows[-2:] for n in names)


def test_space(spark):
    rows = ["  a b\t", "\x1cq\x85", "", None, " 　"]
    assert values(spark, rows, strip_space) == ["a b", "q", "", None, ""]
    assert values(spark, rows, is_blank) == [False, False, True, True, True]


def test_actor_keys(spark):
    rows = [("n1", None, "n3"), (None, None, None), (None, "n2", None), ("n1", "n2", "n3"), ("", "n2", "")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    out = df.select(training_actor_key(*map(F.col, "abc")), serving_actor_key(*map(F.col, "abc"))).collect()
    assert [tuple(r) for r in out] == [("n1,,n3", "n1,n3"), ("Unknown", "Unknown"), ("n2", "n2"), ("n1,n2,n3", "n1,n2,n3"), ("n2", "n2")]


def test_rounding_is_pythons(spark):
    rng = random.Random(7)
    cases = [0.0, 0.125, 0.625, 2.675, 1.115, 1.005, -0.625, -2.675, 9.995, 0.05] + [rng.uniform(-20, 20) for _ in range(500)] + [round(rng.uniform(0, 10), 3) for _ in range(3000)]
    assert values(spark, cases, round_cents, "double") == [round(c, 2) + 0.0 for c in cases]
    assert values(spark, [11.2, -1.0, None, float("nan"), 2.675], clamp_rating, "double") == [10.0, 0.0, None, None, 2.67]


def test_bounds_and_votes(spark):
    df = spark.createDataFrame([(y, m) for y in (1899, 1900, 2030, 2031, None) for m in (9, 10, 300, 301)], "y bigint, m bigint")
    assert {tuple(r) for r in df.where(within_bounds(F.col("y"), F.col("m"))).collect()} == {(y, m) for y in (1900, 2030) for m in (10, 300)}
    assert values(spark, [0, 9, None], lambda c: votes_log(c, 7.5), "bigint") == [0.0, float(np.float32(np.log1p(9))), 7.5]
