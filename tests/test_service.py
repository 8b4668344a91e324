import json
import logging
import random

import pytest

from filmloom.__main__ import main
from filmloom.logs import set_up_logging
from filmloom.operators.explain import BECAUSE, NOTHING
from filmloom.service import RatingService, fit, predict_movie_rating, stored_films

# The four example requests of a public film-rating pipeline, as inputs.
REQUESTS = [
    {"title": "Superman", "director": "James Gunn", "year": 2025, "runtime": 129, "genres": "sci-fi,action", "actors": ["David Corenswet", "Rachel Brosnahan", "Nicholas Hoult"]},
    {"title": "Supergirl", "director": "James Gunn", "year": 2026, "runtime": 108, "genres": ["sci-fi", "action"], "actors": ["Milly Alcock"]},
    {"title": "Spider-Man: Brand New Day", "director": "Destin Daniel Cretton", "year": 2026, "runtime": 145, "genres": "sci-fi,action", "actors": None},
    {"title": "The Odyssey", "director": None, "year": 2026, "runtime": 173, "genres": None, "actors": [], "num_votes": 9},
]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Small tables with enough credits, and a model of them."""
    rng, at = random.Random(11), str(tmp_path_factory.mktemp("service"))
    titles = [(f"t{i:03d}", "movie", f"Film {i}", 1950 + i % 70, 60 + i % 90, rng.choice(["Drama", "Action,sci fi"])) for i in range(200)]
    ratings = [(t[0], round(4 + (t[3] - 1950) / 20 + rng.random(), 1), rng.randrange(1000)) for t in titles]
    credits = [(t[0], 0, f"d{rng.randrange(5)}", "director") for t in titles] + [(t[0], k, f"a{rng.randrange(9)}", "actor") for t in titles for k in (1, 2, 3)]
    people = [("d0", "James Gunn"), ("d1", "Someone"), *((f"a{k}", f"Actor {k}") for k in range(9))]
    for name, rows, schema in (
        ("title_basics", titles, "tconst string, titleType string, primaryTitle string, startYear bigint, runtimeMinutes bigint, genres string"),
        ("title_ratings", ratings, "tconst string, averageRating double, numVotes bigint"),
        ("title_principals", credits, "tconst string, ordering bigint, nconst string, category string"),
        ("name_basics", people, "nconst string, primaryName string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{at}/{name}.parquet")
    metadata = fit(spark, at, f"{at}/model", iterations=5, depth=3)
    assert metadata["total_rows"] == 200
    return at


def test_service(spark, stored):
    films = stored_films(spark, stored)
    service = RatingService(spark, f"{stored}/model", films)
    ratings = service.predict_batch(REQUESTS)
    assert len(ratings) == 4 and all(0 <= r <= 10 for r in ratings) and service.predict_batch([]) == []
    assert service.predict(**REQUESTS[0]) == ratings[0] == predict_movie_rating(spark, films, model_path=f"{stored}/model", **REQUESTS[0])
    explained = service.predict(**REQUESTS[0], explain=True)
    assert explained["rating"] == ratings[0] and explained["explanation"].startswith((BECAUSE, NOTHING)) and len(explained["contributions"]) == 19
    raw = service.explain_prediction(**REQUESTS[0])
    assert abs(raw["base"] + sum(raw["contributions"].values()) - raw["rating"]) < 1e-6
    assert service.feature_importance().count() == 19
    with pytest.raises(FileNotFoundError):
        RatingService(spark, f"{stored}/none", films)


def test_command_line(spark, stored, tmp_path, capsys):
    (tmp_path / "r.json").write_text(json.dumps(REQUESTS))
    assert main(["predict", stored, f"{stored}/model", str(tmp_path / "r.json")]) == 0
    assert [line.split("\t")[0] for line in capsys.readouterr().out.splitlines()] == [r["title"] for r in REQUESTS]
    assert main(["unknown"]) == 2


def test_logging(tmp_path):
    logger = set_up_logging(str(tmp_path), name="filmloom.test")
    assert set_up_logging(str(tmp_path), name="filmloom.test") is logger and len(logger.handlers) == 2
    logger.info("a line")
    logging.shutdown()
    assert "a line" in (tmp_path / "filmloom.test.log").read_text()
