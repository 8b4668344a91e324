"""Numeric and categorical model features as columns; training and serving share them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from filmloom.functions.text import UNKNOWN, normalize_genres, title_features

# Bounds of usable films, scaling, and what stands for missing people and votes.
YEARS, RUNTIMES = (1900, 2030), (10, 300)
DEFAULT_RATING, DEFAULT_VOTES_LOG = 6.5, 7.5
LARGEST_RATING = 10
PEOPLE_RATINGS = ["director_avg_rating", "actor_1_avg_rating", "actor_2_avg_rating", "actor_3_avg_rating"]
CATEGORICAL = ["genres_combined", "director_id", "actor_ids_combined"]


def float32(value: Column) -> Column:
    """The value as stored in 32 bits, widened again."""
    return value.cast("float").cast("double")


def scaled_year(year: Column) -> Column:
    return (year - 1900) / F.lit(100.0)


def scaled_runtime(minutes: Column) -> Column:
    return minutes / F.lit(100.0)


def votes_log(votes: Column, default: float | None = None) -> Column:
    """log1p of the votes; `default` where they are missing."""
    log = float32(F.log1p(votes))
    return log if default is None else F.coalesce(log, F.lit(default))


def within_bounds(year: Column, minutes: Column) -> Column:
    return year.between(*YEARS) & minutes.between(*RUNTIMES)


def training_actor_key(*actors: Column) -> Column:
    """Actors by slot, empty slots kept between commas but not at the ends; `Unknown` if all are empty."""
    joined = F.concat_ws(",", *(F.coalesce(a, F.lit("")) for a in actors))
    trimmed = F.regexp_replace(joined, "^,+|,+$", "")
    return F.when(trimmed == "", UNKNOWN).otherwise(trimmed)


def serving_actor_key(*actors: Column) -> Column:
    """The known actors, comma-separated, without gaps; `Unknown` if none is known."""
    joined = F.concat_ws(",", *(F.when(a != "", a) for a in actors))
    return F.when(joined == "", UNKNOWN).otherwise(joined)


def round_cents(value: Column) -> Column:
    """Two decimals, to the nearest by the exact binary value and to even on ties: as Python rounds and prints.

    Spark's own rounding looks at the shortest decimal form instead. The product with 100 is taken with its rounding
    error, so that values next to a tie fall on their side. For absolute values below 2**46; null stays null.
    """
    product = value * 100.0
    big = value * 134217729.0
    high = big - (big - value)
    error = (high * 100.0 - product) + (value - high) * 100.0
    whole = F.floor(product).cast("double")
    beyond = (product - whole - 0.5) + error
    up = (beyond > 0) | ((beyond == 0) & (whole % 2 != 0))
    return F.when(up, whole + 1).otherwise(whole) / 100.0


def clamp_rating(rating: Column) -> Column:
    """Within 0 and 10, rounded to two decimals; null stays null, and so does not-a-number."""
    usable = F.when(~F.isnan(rating), rating)
    return F.when(usable.isNotNull(), round_cents(F.greatest(F.lit(0.0), F.least(F.lit(float(LARGEST_RATING)), usable))))


def numeric_features(title: Column, director_stats: bool = True, actor_stats: bool = True) -> dict[str, Column]:
    """Numeric features of an enriched row by name, in model order; without statistics that are not asked for."""
    people = PEOPLE_RATINGS[:1] * director_stats + PEOPLE_RATINGS[1:] * actor_stats
    base = {"startYear": scaled_year(F.col("startYear")), "runtimeMinutes": scaled_runtime(F.col("runtimeMinutes")), "numVotes_log": votes_log(F.col("numVotes"))}
    return base | {name: float32(F.col(name)) for name in people} | {name: c.cast("double") for name, c in title_features(title).items()}


def categorical_features() -> dict[str, Column]:
    """Categorical features of an enriched row by name."""
    actors = [F.col(f"actor_{k}_nconst") for k in (1, 2, 3)]
    return {"genres_combined": normalize_genres(F.col("genres")), "director_id": F.coalesce("director_nconst", F.lit(UNKNOWN)), "actor_ids_combined": training_actor_key(*actors)}
