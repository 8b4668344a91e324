"""Column builders over titles and genre lists; no Python runs per row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genre spellings that stand for another.
GENRE_SYNONYMS = {
    "sci fi": "Sci-Fi",
    "science fiction": "Sci-Fi",
    "romcom": "Romance",
    "romantic comedy": "Romance",
}
# Words that mark a franchise wherever they occur in a lower-case title.
FRANCHISE_WORDS = {
    "marvel": [
        "marvel", "avengers", "iron man", "captain america", "thor", "guardians",
        "black panther", "doctor strange", "spider-man", "ant-man", "eternals", "shang-chi",
    ],
    "dc": [
        "batman", "superman", "wonder woman", "justice league", "aquaman", "shazam",
        "suicide squad", "joker", "the flash", "green lantern",
    ],
    "star_wars": ["star wars", "clone wars", "rogue one", "solo"],
    "harry_potter": ["harry potter", "fantastic beasts"],
    "bond": ["james bond", "007", "casino royale", "skyfall", "spectre", "no time to die"],
}
UNKNOWN = "Unknown"
#: Title features in their order.
TITLE_FEATURES = [*(f"is_{name}" for name in FRANCHISE_WORDS), "title_len", "title_word_count", "has_digit", "has_colon"]


#: White space as `str.split` and `str.strip` of Python see it: Unicode's and the four ASCII separators.
SPACE, NO_SPACE = r"(?U)[\s\x1c-\x1f]", r"(?U)[^\s\x1c-\x1f]"


def strip_space(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def is_blank(text: Column) -> Column:
    """Null, empty or white space only."""
    return ~F.coalesce(text.rlike(NO_SPACE), F.lit(False))


def split_genres(genres: Column) -> Column:
    """The comma-separated parts as they stand, empty ones included."""
    return F.split(genres, ",", -1)


def _title_case(word: Column) -> Column:
    """Upper case for the first of each run of letters of a lower-case word."""
    runs = F.regexp_extract_all(word, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))), "")


def normalize_genre(genre: Column) -> Column:
    """One genre in canonical spelling: synonyms first, then title case of each part between hyphens, empty parts dropped.

    Null and empty give the empty text.
    """
    word = F.lower(strip_space(F.coalesce(genre, F.lit(""))))
    parts = F.filter(F.split(word, "-", -1), lambda p: p != "")
    usual = F.array_join(F.transform(parts, _title_case), "-")
    return reduce(lambda rest, pair: F.when(word == pair[0], pair[1]).otherwise(rest), reversed(GENRE_SYNONYMS.items()), usual)


def normalize_genres(genres: Column) -> Column:
    """A comma-separated list in canonical spelling, order and repeats kept; `Unknown` if nothing is in it."""
    kept = F.filter(split_genres(genres), lambda g: ~is_blank(g))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) > 0, F.array_join(F.transform(kept, normalize_genre), ",")).otherwise(UNKNOWN)


def title_features(title: Column) -> dict[str, Column]:
    """The nine features of a title by name, as bigint; all null for a null or empty title."""
    known = F.when(title != "", title)
    low = F.lower(known)
    flag = lambda c: c.cast("bigint")
    found = {f"is_{name}": flag(reduce(lambda a, b: a | b, (F.contains(low, F.lit(w)) for w in words))) for name, words in FRANCHISE_WORDS.items()}
    return found | {
        "title_len": flag(F.length(known)),
        "title_word_count": flag(F.regexp_count(known, F.lit(f"{NO_SPACE}+"))),
        "has_digit": flag(known.rlike(r"(?U)\d")),
        "has_colon": flag(F.contains(known, F.lit(":"))),
    }
