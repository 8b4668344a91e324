"""Relational operators on films, their ratings and their people."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.functions.features import CATEGORICAL, categorical_features, numeric_features, within_bounds

ACTORS = ("actor", "actress")
KEPT_CATEGORIES = ("director", *ACTORS)
#: Credits that a director's and an actor's mean needs.
DIRECTOR_CREDITS, ACTOR_CREDITS = 2, 3
#: Actors looked at, and so slots.
SLOTS = 3


@dataclass
class Films:
    """titles (tconst, titleType, primaryTitle, startYear, runtimeMinutes, genres), ratings (tconst, averageRating,
    numVotes), credits (tconst, ordering, nconst, category), people (nconst, primaryName)."""

    titles: DataFrame
    ratings: DataFrame
    credits: DataFrame
    people: DataFrame


def load_films(raw: Films) -> Films:
    """The part of each table that the pipeline keeps: films with year, runtime and genres, and what belongs to them.

    The three dependent tables are filtered by semi-joins on distinct keys; nothing is collected.
    """
    titles = usable(raw.titles)
    keys = titles.select("tconst")
    credits = raw.credits.join(keys, "tconst", "left_semi").where(F.col("category").isin(*KEPT_CATEGORIES))
    return Films(titles, raw.ratings.join(keys, "tconst", "left_semi"), credits, raw.people.join(credits.select("nconst").distinct(), "nconst", "left_semi"))


def mean_rating(total: Column, count: Column) -> Column:
    """A mean from an exact decimal sum, equal on every engine and in every order of addition."""
    return total.cast("double") / count


def exact(rating: Column) -> Column:
    return rating.cast("decimal(18,4)")


def rated_films(films: Films) -> DataFrame:
    """Films with a rating: (tconst, primaryTitle, startYear, runtimeMinutes, genres, averageRating, numVotes)."""
    return usable(films.titles).join(films.ratings.where("averageRating is not null"), "tconst").select("tconst", "primaryTitle", "startYear", "runtimeMinutes", "genres", "averageRating", "numVotes")


def usable(titles: DataFrame) -> DataFrame:
    """Films with year, runtime and genres."""
    return titles.where("titleType = 'movie' and startYear is not null and runtimeMinutes is not null and genres is not null")


def page(keys: DataFrame, key: str, after: str, rows: int, pages: int = 1) -> DataFrame:
    """The next `pages` pages of `rows` keys beyond `after`, in order; null keys are on no page.

    A top-k, not a sort: each task keeps its own first rows. Keys that occur twice fill two rows.
    """
    return keys.select(key).where(F.col(key) > after).orderBy(key).limit(rows * pages)


def pages(keys: DataFrame, key: str, rows: int, after: str = "", most: int | None = None) -> Iterator[DataFrame]:
    """The pages of `rows` keys beyond `after`, one after the other, until none is left or `most` are given.

    The driver sees the last key of each page only; where all pages are wanted at once, one plan over all keys does it.
    """
    number = 0
    while most is None or number < most:
        now = page(keys, key, after, rows)
        last, found = now.agg(F.max(key), F.count(F.lit(1))).first()
        if found:
            yield now
        if found < rows:
            return
        after, number = last, number + 1


def bound_list(spark: SparkSession, values: list[str], name: str) -> DataFrame:
    """A caller's list as a relation of one column; it is part of the plan, so it is as long as a caller may hold."""
    return spark.range(1).select(F.explode(F.lit(values).cast("array<string>")).alias(name))


def director_ordering(films: Films) -> DataFrame:
    """The least billing order of a director of each title."""
    return films.credits.where("category = 'director'").groupBy("tconst").agg(F.min("ordering").alias("min_ord"))


def first_directors(films: Films) -> DataFrame:
    """Whoever has the place of a title's first director, whatever their category: one row per such credit.

    Only titles with a director take part, and the two sides share the hash partitioning by title.
    """
    first = director_ordering(films).withColumnRenamed("min_ord", "ordering")
    return films.credits.join(first, ["tconst", "ordering"]).select("tconst", F.col("nconst").alias("director_nconst"))


def leading_actors(films: Films) -> DataFrame:
    """The first SLOTS actors of each title by billing order, ties by nconst; (tconst, ordering, nconst, place)."""
    order = Window.partitionBy("tconst").orderBy("ordering", "nconst")
    actors = films.credits.where(F.col("category").isin(*ACTORS))
    return actors.select("tconst", "ordering", "nconst", F.row_number().over(order).cast("bigint").alias("place")).where(F.col("place") <= SLOTS)


def actor_slots(films: Films, by_place: bool = False) -> DataFrame:
    """One row per title with leading actors in slots 1 to 3.

    A slot is the billing order itself, so an actor billed beyond 3 has none; with `by_place` it is the place among the
    title's actors. Of several actors for a slot the largest nconst counts.
    """
    slot = F.col("place" if by_place else "ordering")
    return leading_actors(films).groupBy("tconst").agg(*(F.max(F.when(slot == k, F.col("nconst"))).alias(f"actor_{k}_nconst") for k in range(1, SLOTS + 1)))


def role_ratings(films: Films) -> DataFrame:
    """Mean ratings of each person as director and as actor: (nconst, director_avg, director_credits, actor_avg, actor_credits).

    Credit rows in rated films count, not films. They are summed per person and title before the join with the ratings,
    so that a person or title with a third of all rows is a few rows there; both roles share one pass. A mean is null
    where the role's credits are fewer than it needs.
    """
    roles = {"director": (F.col("category") == "director", DIRECTOR_CREDITS), "actor": (F.col("category").isin(*ACTORS), ACTOR_CREDITS)}
    named = films.credits.where(F.col("category").isin(*KEPT_CATEGORIES) & F.col("nconst").isNotNull())
    held = named.groupBy("tconst", "nconst").agg(*(F.count_if(is_role).alias(role) for role, (is_role, _) in roles.items()))
    rated = held.join(rated_films(films).select("tconst", exact(F.col("averageRating")).alias("r")), "tconst")
    sums = rated.groupBy("nconst").agg(*(a for role in roles for a in (F.sum(F.col("r") * F.col(role)).alias(f"{role}_total"), F.sum(role).alias(f"{role}_credits"))))
    means = {f"{role}_avg": F.when(F.col(f"{role}_credits") >= least, mean_rating(F.col(f"{role}_total"), F.col(f"{role}_credits"))) for role, (_, least) in roles.items()}
    return sums.withColumns(means).select("nconst", "director_avg", "director_credits", "actor_avg", "actor_credits")


def director_ratings(films: Films) -> DataFrame:
    """(nconst, avg_rating, n_credits) of people with enough credits as director."""
    return role_ratings(films).where("director_avg is not null").select("nconst", F.col("director_avg").alias("avg_rating"), F.col("director_credits").alias("n_credits"))


def actor_ratings(films: Films) -> DataFrame:
    """(nconst, avg_rating, n_credits) of people with enough credits as actor."""
    return role_ratings(films).where("actor_avg is not null").select("nconst", F.col("actor_avg").alias("avg_rating"), F.col("actor_credits").alias("n_credits"))


def leading_credits(films: Films) -> DataFrame:
    """The first SLOTS directors (role 0) and actors (role 1) of each title by billing order, ties by nconst: (tconst, role,
    ordering, nconst, place), by one window."""
    role = F.when(F.col("category") == "director", 0).otherwise(1)
    order = Window.partitionBy("tconst", "role").orderBy("ordering", "nconst")
    credits = films.credits.where(F.col("category").isin(*KEPT_CATEGORIES)).select("tconst", role.alias("role"), "ordering", "nconst")
    return credits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= SLOTS)


def enriched(films: Films, by_place: bool = False) -> DataFrame:
    """Rated films with director, leading actors and their mean ratings: 15 columns, one row per film.

    Of several people at a first director's place the director with the smallest nconst counts. One window finds the
    director (slot 0) and the leading actors (slots 1 to 3) of a title; all slots are one long table that meets the
    people's means in one join by person and is folded back by title, instead of a join for each slot.
    """
    leading = leading_credits(films)
    slot = F.when(F.col("role") == 1, F.col("place" if by_place else "ordering")).when(F.col("place") == 1, 0)
    long = leading.select("tconst", "nconst", slot.cast("int").alias("slot")).where(F.col("slot").between(0, SLOTS) & F.col("nconst").isNotNull())
    means = role_ratings(films).select("nconst", "director_avg", "actor_avg").where("director_avg is not null or actor_avg is not null")
    scored = long.join(means, "nconst", "left").select("tconst", "slot", F.struct("nconst", F.when(F.col("slot") == 0, F.col("director_avg")).otherwise(F.col("actor_avg")).alias("avg")).alias("p"))
    wide = scored.groupBy("tconst").agg(*(F.max(F.when(F.col("slot") == k, F.col("p"))).alias(f"p{k}") for k in range(SLOTS + 1)))
    names = ["director", *(f"actor_{k}" for k in range(1, SLOTS + 1))]
    ids, ratings = ([F.col(f"p{k}.{part}").alias(f"{name}_{what}") for k, name in enumerate(names)] for part, what in (("nconst", "nconst"), ("avg", "avg_rating")))
    columns = ["tconst", "primaryTitle", "startYear", "runtimeMinutes", "genres", "averageRating", "numVotes"]
    return rated_films(films).join(wide, "tconst", "left").select(*columns, ids[0], ratings[0], *ids[1:], *ratings[1:])


def bounded(rows: DataFrame) -> DataFrame:
    """Rows with year, runtime, rating and votes, and year and runtime within their bounds."""
    typed = rows.withColumns({c: F.col(c).try_cast("double" if c == "averageRating" else "bigint") for c in ("startYear", "runtimeMinutes", "averageRating", "numVotes")})
    return typed.na.drop(subset=["startYear", "runtimeMinutes", "averageRating", "numVotes"]).where(within_bounds(F.col("startYear"), F.col("runtimeMinutes")))


def feature_rows(rows: DataFrame) -> DataFrame:
    """Bounded enriched rows with all features beside tconst, primaryTitle and averageRating; nothing masked yet."""
    kept = bounded(rows)
    features = numeric_features(F.col("primaryTitle")) | categorical_features()
    return kept.select("tconst", "primaryTitle", F.col("averageRating").cast("float").cast("double").alias("averageRating"), *(c.alias(n) for n, c in features.items()))


def training_rows(rows: DataFrame, director_stats: bool = True, actor_stats: bool = True) -> DataFrame:
    """Feature rows without a null in any numeric feature; statistics that are switched off are no features."""
    kept = bounded(rows)
    numeric = numeric_features(F.col("primaryTitle"), director_stats, actor_stats)
    features = numeric | categorical_features()
    out = kept.select("tconst", "primaryTitle", F.col("averageRating").cast("float").cast("double").alias("averageRating"), *(c.alias(n) for n, c in features.items()))
    return out.na.drop(subset=list(numeric)).na.fill("Unknown", CATEGORICAL)
