"""Features of requested films, by the names of their people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.functions.features import DEFAULT_RATING, DEFAULT_VOTES_LOG, float32, scaled_runtime, scaled_year, serving_actor_key, votes_log
from filmloom.functions.text import UNKNOWN, normalize_genres, title_features
from filmloom.operators.films import SLOTS, Films
from filmloom.operators.people import resolve_people


def serving_features(requests: DataFrame, films: Films) -> DataFrame:
    """Model features of every request (request_id, title, year, runtime, genres, director, actors, num_votes).

    `genres` is a text or an array of texts; only the first SLOTS actors count. People come by name without case; one
    nobody has, or without a rated film, has the default rating and no id. Missing votes have the default logarithm, and
    a missing title zeros for its features. Year and runtime are scaled as in training. All names of all requests are
    resolved in one pass; a request_id is unique.
    """
    genres = F.array_join("genres", ",") if requests.schema["genres"].dataType.typeName() == "array" else F.col("genres")
    actors = F.slice(F.coalesce("actors", F.array().cast("array<string>")), 1, SLOTS)
    slim = requests.select("request_id", "title", "year", "runtime", genres.alias("genres"), "director", actors.alias("actors"), "num_votes")
    people = slim.select("request_id", F.posexplode(F.concat(F.array("director"), F.col("actors"))).alias("slot", "name")).withColumn("low", F.lower("name"))
    resolved = people.where("low is not null").join(resolve_people(people.select("name"), films), "low")  # the others have defaults
    pick = lambda what, k: F.max(F.when(F.col("slot") == k, F.col(what)))
    wide = resolved.groupBy("request_id").agg(
        *(pick("nconst", k).alias(f"id_{k}") for k in range(SLOTS + 1)), *(pick("avg_rating", k).alias(f"rating_{k}") for k in range(SLOTS + 1))
    )
    rating = lambda k: float32(F.coalesce(f"rating_{k}", F.lit(DEFAULT_RATING)))
    features = {
        "startYear": scaled_year(F.col("year")),
        "runtimeMinutes": scaled_runtime(F.col("runtime")),
        "numVotes_log": votes_log(F.col("num_votes"), DEFAULT_VOTES_LOG),
        "director_avg_rating": rating(0),
        **{f"actor_{k}_avg_rating": rating(k) for k in range(1, SLOTS + 1)},
        **{name: F.coalesce(c.cast("double"), F.lit(0.0)) for name, c in title_features(F.col("title")).items()},
        "genres_combined": normalize_genres(F.col("genres")),
        "director_id": F.coalesce("id_0", F.lit(UNKNOWN)),
        "actor_ids_combined": serving_actor_key(*(F.col(f"id_{k}") for k in range(1, SLOTS + 1))),
    }
    return slim.join(wide, "request_id", "left").select("request_id", *(c.alias(n) for n, c in features.items()))
