"""The project's tables as films, ratings, credits and people, in Spark and as SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions.keys import clean_key, clean_key_sql
from filmloom.scratch import cut
from filmloom.sources.tables import table


class FilmViews:
    r"""Distinct titles, the last snapshot's ratings, distinct credits and people, under clean keys; `Films`, each opened
    when it is asked for.

    Rows of a title or person that differ only in when they were added are one; of a title's ratings in the last
    snapshot the latest delivered counts; a `\N` genre field is null; categories lose case and outer blanks.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._table = lambda name: table(spark, folder, name)

    @cached_property
    def titles(self) -> DataFrame:
        genres = F.when(F.trim("genres") != "\\N", F.col("genres"))
        titles = self._table("title_basics").select(clean_key("tconst").alias("tconst"), "titleType", "primaryTitle", "startYear", "runtimeMinutes", genres.alias("genres"))
        return titles.where("tconst is not null").distinct()

    @cached_property
    def ratings(self) -> DataFrame:
        every = self._table("title_ratings")
        last = every.agg(F.max("snapshot_date").alias("snapshot_date"))
        latest = (
            every.join(F.broadcast(last), "snapshot_date")  # one row
            .groupBy(clean_key("tconst").alias("tconst"))
            .agg(F.max(F.struct("delivered_at", "averageRating", "numVotes")).alias("r"))
        )
        return latest.where("tconst is not null").select("tconst", "r.averageRating", "r.numVotes")

    @cached_property
    def credits(self) -> DataFrame:
        credits = self._table("title_principals").select(clean_key("tconst").alias("tconst"), "ordering", clean_key("nconst").alias("nconst"), F.lower(F.trim("category")).alias("category"))
        return credits.where("tconst is not null").distinct()

    @cached_property
    def people(self) -> DataFrame:
        return self._table("name_basics").select(clean_key("nconst").alias("nconst"), "primaryName").where("nconst is not null").distinct()

    def with_stored_credits(self, categories: tuple[str, ...] = ()) -> FilmViews:
        """Itself with the credits, of some categories only if given, cleaned and told apart once: for plans that read
        them more than once."""
        self.credits = cut(self.credits.where(F.col("category").isin(*categories)) if categories else self.credits)
        return self


def film_views(spark: SparkSession, folder: str) -> FilmViews:
    return FilmViews(spark, folder)


VIEWS_SQL = rf"""WITH RECURSIVE titles AS (
  SELECT DISTINCT {clean_key_sql("tconst")} AS tconst, titleType, primaryTitle, startYear, runtimeMinutes, CASE WHEN trim(genres) <> '\N' THEN genres END AS genres
  FROM title_basics WHERE {clean_key_sql("tconst")} IS NOT NULL),
ratings AS (
  SELECT {clean_key_sql("tconst")} AS tconst, averageRating, numVotes FROM title_ratings
  WHERE snapshot_date = (SELECT max(snapshot_date) FROM title_ratings) AND {clean_key_sql("tconst")} IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {clean_key_sql("tconst")} ORDER BY delivered_at DESC NULLS LAST, averageRating DESC NULLS LAST, numVotes DESC NULLS LAST) = 1),
credits AS (
  SELECT DISTINCT {clean_key_sql("tconst")} AS tconst, ordering, {clean_key_sql("nconst")} AS nconst, lower(trim(category)) AS category
  FROM title_principals WHERE {clean_key_sql("tconst")} IS NOT NULL),
people AS (SELECT DISTINCT {clean_key_sql("nconst")} AS nconst, primaryName FROM name_basics WHERE {clean_key_sql("nconst")} IS NOT NULL),
movies AS (SELECT * FROM titles WHERE titleType = 'movie' AND startYear IS NOT NULL AND runtimeMinutes IS NOT NULL AND genres IS NOT NULL),
rated AS (SELECT movies.*, averageRating, numVotes FROM movies JOIN ratings USING (tconst) WHERE averageRating IS NOT NULL),
cast_credits AS (SELECT * FROM credits WHERE category IN ('actor', 'actress')),
director_stats AS (
  SELECT nconst, CAST(sum(CAST(averageRating AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS avg_rating, count(*) AS n_credits
  FROM credits JOIN rated USING (tconst) WHERE category = 'director' AND nconst IS NOT NULL GROUP BY nconst HAVING count(*) >= 2),
actor_stats AS (
  SELECT nconst, CAST(sum(CAST(averageRating AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS avg_rating, count(*) AS n_credits
  FROM cast_credits JOIN rated USING (tconst) WHERE nconst IS NOT NULL GROUP BY nconst HAVING count(*) >= 3),
top3 AS (SELECT * FROM (SELECT tconst, ordering, nconst, row_number() OVER (PARTITION BY tconst ORDER BY ordering NULLS FIRST, nconst NULLS FIRST) AS place FROM cast_credits) WHERE place <= 3),
slots AS (SELECT tconst, max(CASE WHEN ordering = 1 THEN nconst END) AS actor_1_nconst, max(CASE WHEN ordering = 2 THEN nconst END) AS actor_2_nconst,
  max(CASE WHEN ordering = 3 THEN nconst END) AS actor_3_nconst FROM top3 GROUP BY tconst),
directors AS (SELECT tconst, nconst FROM (SELECT tconst, nconst, row_number() OVER (PARTITION BY tconst ORDER BY ordering NULLS FIRST, nconst NULLS FIRST) AS k
  FROM credits WHERE category = 'director') WHERE k = 1),
enriched AS (
  SELECT r.tconst, primaryTitle, startYear, runtimeMinutes, genres, averageRating, numVotes, d.nconst AS director_nconst, ds.avg_rating AS director_avg_rating,
    actor_1_nconst, actor_2_nconst, actor_3_nconst, a1.avg_rating AS actor_1_avg_rating, a2.avg_rating AS actor_2_avg_rating, a3.avg_rating AS actor_3_avg_rating
  FROM rated r LEFT JOIN directors d ON d.tconst = r.tconst LEFT JOIN director_stats ds ON ds.nconst = d.nconst LEFT JOIN slots s ON s.tconst = r.tconst
  LEFT JOIN actor_stats a1 ON a1.nconst = actor_1_nconst LEFT JOIN actor_stats a2 ON a2.nconst = actor_2_nconst LEFT JOIN actor_stats a3 ON a3.nconst = actor_3_nconst),
bounded AS (
  SELECT * FROM enriched WHERE averageRating IS NOT NULL AND numVotes IS NOT NULL AND startYear BETWEEN 1900 AND 2030 AND runtimeMinutes BETWEEN 10 AND 300)
"""
