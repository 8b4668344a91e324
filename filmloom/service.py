"""Ratings of films that are not in the tables yet: one request, many, or a DataFrame of them."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.operators.explain import contributions, explanation
from filmloom.operators.films import Films, enriched, training_rows
from filmloom.operators.model import RatingModel, train
from filmloom.operators.serving import serving_features

log = logging.getLogger(__name__)

#: A request as a row.
REQUEST = "request_id bigint, title string, year bigint, runtime bigint, genres string, director string, actors array<string>, num_votes bigint"
TABLES = ("title_basics", "title_ratings", "title_principals", "name_basics")


def stored_films(spark: SparkSession, folder: str) -> Films:
    """The tables that `filmloom.sources.delimited.ingest` stored."""
    return Films(*(spark.read.parquet(f"{folder}/{name}.parquet") for name in TABLES))


def fit(spark: SparkSession, folder: str, model_path: str, **settings) -> dict:
    """Trains on the stored tables and saves the model; its metadata, or {} and nothing saved without usable films."""
    model, metadata = train(training_rows(enriched(stored_films(spark, folder))), **settings)
    if model is None:
        log.error("no film has all features")
        return {}
    for row in model.importance(spark, 10).collect():
        log.info("%s: %.4f", row["feature"], row["importance"])
    model.save(model_path)
    return metadata


def request_row(number: int, year: int, runtime: int, genres: str | list[str] | None, director: str | None = None, actors: list[str] | None = None, num_votes: int | None = None, title: str | None = None) -> tuple:
    """A request as a REQUEST row; genres may be a list or comma-separated."""
    return (number, title, year, runtime, ",".join(genres) if isinstance(genres, list) else genres, director, actors, num_votes)


class RatingService:
    """A saved model beside the tables that know its people."""

    def __init__(self, spark: SparkSession, model_path: str, films: Films):
        """Loads the model; FileNotFoundError where there is none."""
        self.spark, self.films = spark, films
        self.model = RatingModel.load(spark, model_path)

    def predict_frame(self, requests: DataFrame) -> DataFrame:
        """(request_id, rating) of every row of REQUEST form, as one plan."""
        return self.model.score(serving_features(requests, self.films)).select("request_id", "rating")

    def explain_frame(self, requests: DataFrame) -> DataFrame:
        """(request_id, prediction, rating, base, contributions, explanation) of every request."""
        explained = contributions(self.model, serving_features(requests, self.films), "request_id")
        return explained.withColumn("explanation", explanation(self.model.metadata["feature_names"], F.col("contributions")))

    def predict_batch(self, movies: list[dict]) -> list[float]:
        """The ratings of many requests, in their order; one plan for all."""
        if not movies:
            return []
        rows = self.spark.createDataFrame([request_row(i, **m) for i, m in enumerate(movies)], REQUEST)
        return [r["rating"] for r in self.predict_frame(rows).orderBy("request_id").collect()]

    def predict(self, year: int, runtime: int, genres: str | list[str] | None, director: str | None = None, actors: list[str] | None = None, num_votes: int | None = None, title: str | None = None, explain: bool = False) -> float | dict:
        """The rating from 0 to 10 in two decimals; with `explain` a dict with base, contributions and text too."""
        request = {"year": year, "runtime": runtime, "genres": genres, "director": director, "actors": actors, "num_votes": num_votes, "title": title}
        if not explain:
            return self.predict_batch([request])[0]
        found = self._explained(request)
        return {"rating": found["clamped"]} | {k: found[k] for k in ("base", "contributions", "explanation")}

    def explain_prediction(self, **request) -> dict:
        """As `predict` with `explain`, but the rating neither clamped nor rounded."""
        found = self._explained(request)
        return {k: found[k] for k in ("rating", "base", "contributions", "explanation")}

    def _explained(self, request: dict) -> dict:
        row = self.explain_frame(self.spark.createDataFrame([request_row(0, **request)], REQUEST)).first()
        named = dict(zip(self.model.metadata["feature_names"], row["contributions"]))
        return {"rating": row["prediction"], "clamped": row["rating"], "base": row["base"], "contributions": named, "explanation": row["explanation"]}

    def feature_importance(self) -> DataFrame:
        """(feature, importance), largest first."""
        return self.model.importance(self.spark)


def predict_movie_rating(spark: SparkSession, films: Films, title: str, year: int, runtime: int, genres: str | list[str], director: str, actors: list[str] | None = None, *, model_path: str) -> float:
    """One rating by a saved model."""
    return RatingService(spark, model_path, films).predict(year, runtime, genres, director, actors, title=title)
