"""People by name, for films that are not in the tables yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.functions.features import DEFAULT_RATING
from filmloom.functions.text import is_blank
from filmloom.operators.films import Films, exact, mean_rating


def person_ratings(films: Films) -> DataFrame:
    """(nconst, avg_rating, n_credits) over all credits in rated films, whatever the category."""
    rated = films.titles.where("titleType = 'movie'").select("tconst").join(films.ratings.where("averageRating is not null"), "tconst")
    held = films.credits.where("nconst is not null").groupBy("tconst", "nconst").agg(F.count(F.lit(1)).alias("n"))
    sums = held.join(rated.select("tconst", exact(F.col("averageRating")).alias("r")), "tconst").groupBy("nconst").agg(F.sum(F.col("r") * F.col("n")).alias("total"), F.sum("n").alias("n_credits"))
    return sums.select("nconst", mean_rating(F.col("total"), F.col("n_credits")).alias("avg_rating"), "n_credits")


def people_lookup(names: DataFrame, films: Films) -> DataFrame:
    """(primaryName, nconst, avg_rating) of the people with the requested names (name), compared without case.

    A known person has one row with their mean rating if a rated film names them, else none. A name nobody has gives a
    row without nconst and the default rating, for each time it is asked. Namesakes all come. Null and blank names are
    not asked.
    """
    asked = names.where(~is_blank(F.col("name"))).select("name", F.lower("name").alias("low"))
    known = films.people.where("primaryName is not null").select("nconst", "primaryName", F.lower("primaryName").alias("low")).distinct()
    matched = known.join(asked.select("low").distinct(), "low", "left_semi")
    found = matched.join(person_ratings(films), "nconst").select("primaryName", "nconst", "avg_rating")
    missing = asked.join(known.select("low").distinct(), "low", "left_anti")
    return found.unionByName(missing.select(F.col("name").alias("primaryName"), F.lit(None).cast("string").alias("nconst"), F.lit(DEFAULT_RATING).alias("avg_rating")))


def resolve_people(names: DataFrame, films: Films) -> DataFrame:
    """One person per distinct lower-case name: (low, nconst, avg_rating), for serving.

    Of namesakes the one with most rated credits counts, then the smallest nconst; names without a rated person give no
    row.
    """
    asked = names.where(~is_blank(F.col("name"))).select(F.lower("name").alias("low")).distinct()
    known = films.people.where("primaryName is not null").select("nconst", F.lower("primaryName").alias("low")).distinct().join(asked, "low", "left_semi")
    best = Window.partitionBy("low").orderBy(F.desc("n_credits"), "nconst")
    return known.join(person_ratings(films), "nconst").withColumn("rank", F.row_number().over(best)).where("rank = 1").select("low", "nconst", "avg_rating")
