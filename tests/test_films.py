import pytest
from pyspark.sql import functions as F

from filmloom.operators.films import Films, actor_ratings, actor_slots, bound_list, bounded, director_ratings, enriched, first_directors, leading_actors, load_films, page, pages, training_rows
from filmloom.operators.people import people_lookup, resolve_people
from filmloom.operators.serving import serving_features

TITLES = "tconst string, titleType string, primaryTitle string, startYear bigint, runtimeMinutes bigint, genres string"


@pytest.fixture
def films(spark):
    titles = [(f"t{i}", "movie", f"Film {i}: Part", 1990 + i, 100 + i, "Drama,sci fi") for i in range(1, 6)]
    titles += [("s1", "short", "Short", 2000, 9, "Drama"), ("t6", "movie", "", 2000, 90, "Drama"), ("t7", "movie", "No rating", 2000, 90, "Drama"), ("t8", "movie", "No genres", 2000, 90, None)]
    ratings = [("t1", 8.0, 10), ("t2", 6.0, 20), ("t3", 7.0, 30), ("t4", 5.0, 40), ("t5", 9.0, None), ("t6", 4.0, 5), ("s1", 1.0, 1), ("t7", None, 3)]
    credits = [("t1", 4, "d1", "director"), ("t2", 4, "d1", "director"), ("t3", 4, "d2", "director"), ("t3", 5, "d1", "director"), ("t4", 4, "w1", "writer"), ("t4", 4, "d3", "director")]
    credits += [(f"t{i}", 1, "a1", "actor") for i in (1, 2, 3)] + [(f"t{i}", 2, "a2", "actress") for i in (1, 2, 3)] + [(f"t{i}", 3, "a3", "actor") for i in (1, 2, 3)]
    credits += [("t4", 2, "a1", "actor"), ("t4", 5, "a2", "actress"), ("t5", 1, "a4", "actor"), ("t5", 1, "a5", "actor"), ("t1", 9, "a1", "self"), ("t1", 10, None, "actor")]
    people = [("d1", "Ann Lee"), ("d2", "Bo"), ("d3", "Cy"), ("a1", "Dee"), ("a2", "DEE"), ("a3", "Eve"), ("a4", "Fay"), ("a5", None), ("x", "Idle")]
    make = spark.createDataFrame
    return Films(make(titles, TITLES), make(ratings, "tconst string, averageRating double, numVotes bigint"), make(credits, "tconst string, ordering bigint, nconst string, category string"), make(people, "nconst string, primaryName string"))


def empty(films):
    return Films(films.titles.limit(0), films.ratings.limit(0), films.credits.limit(0), films.people.limit(0))


def test_load(films):
    kept = load_films(films)
    assert {r[0] for r in kept.titles.collect()} == {f"t{i}" for i in range(1, 8)}
    assert "s1" not in {r["tconst"] for r in kept.ratings.collect()}
    assert {r["category"] for r in kept.credits.collect()} == {"director", "actor", "actress"}
    assert {r["nconst"] for r in kept.people.collect()} == {"d1", "d2", "d3", "a1", "a2", "a3", "a4", "a5"}


def test_first_director_takes_whoever_has_the_place(films):
    assert sorted(map(tuple, first_directors(films).collect())) == [("t1", "d1"), ("t2", "d1"), ("t3", "d2"), ("t4", "d3"), ("t4", "w1")]


def test_slots(films):
    four = {r["tconst"]: tuple(r)[1:] for r in actor_slots(films).collect()}
    assert four["t1"] == ("a1", "a2", "a3") and four["t4"] == (None, "a1", None) and four["t5"] == ("a5", None, None)
    assert {r["tconst"]: tuple(r)[1:] for r in actor_slots(films, by_place=True).collect()}["t4"] == ("a1", "a2", None)
    assert leading_actors(films).where("tconst = 't1'").count() == 3


def test_support(films):
    assert {r["nconst"]: (r["avg_rating"], r["n_credits"]) for r in director_ratings(films).collect()} == {"d1": (7.0, 3)}
    assert {r["nconst"]: r["n_credits"] for r in actor_ratings(films).collect()} == {"a1": 4, "a2": 4, "a3": 3}


def test_enriched_and_training(films):
    rows = {r["tconst"]: r for r in enriched(films).collect()}
    assert set(rows) == {"t1", "t2", "t3", "t4", "t5", "t6"} and len(enriched(films).columns) == 15
    assert rows["t3"]["director_nconst"] == "d2" and rows["t3"]["director_avg_rating"] is None
    assert rows["t4"]["director_nconst"] == "d3" and rows["t4"]["actor_2_avg_rating"] == 6.5
    frame = training_rows(enriched(films))
    assert {r["tconst"] for r in frame.collect()} == {"t1", "t2"} and len(frame.columns) == 3 + 19
    assert {r["tconst"] for r in training_rows(enriched(films), False, False).collect()} == {"t1", "t2", "t3", "t4"}
    assert frame.first()["genres_combined"] == "Drama,Sci-Fi"
    assert enriched(empty(films)).count() == training_rows(enriched(empty(films))).count() == 0


def test_bounds(spark):
    rows = [(y, m, 5.0, 1) for y in ("1899", "1900", "2030", "2031", "x", None) for m in ("9", "10", "300", "301")]
    df = spark.createDataFrame(rows, "startYear string, runtimeMinutes string, averageRating double, numVotes bigint")
    assert {(r[0], r[1]) for r in bounded(df).collect()} == {(y, m) for y in (1900, 2030) for m in (10, 300)}


def test_people(spark, films):
    names = spark.createDataFrame([("ann LEE",), ("dee",), ("idle",), ("Nobody",), ("Nobody",), (" ",), (None,), ("Bo",)], "name string")
    got = sorted(map(str, (tuple(r) for r in people_lookup(names, films).collect())))
    assert got == sorted(map(str, [("Ann Lee", "d1", 7.0), ("Dee", "a1", (8.0 * 2 + 6 + 7 + 5) / 5), ("DEE", "a2", 6.5), ("Bo", "d2", 7.0), ("Nobody", None, 6.5), ("Nobody", None, 6.5)]))
    assert {r["low"]: r["nconst"] for r in resolve_people(names, films).collect()} == {"ann lee": "d1", "dee": "a1", "bo": "d2"}
    assert people_lookup(names.limit(0), films).count() == 0


def test_serving(spark, films):
    requests = [(1, "Superman", 2025, 129, "sci-fi,action", "ANN lee", ["Dee", "nobody", "Eve", "Fay"], None), (2, None, 2000, 100, None, None, None, 99), (3, "", 1900, 0, " ", "idle", [], 0)]
    df = spark.createDataFrame(requests, "request_id int, title string, year int, runtime int, genres string, director string, actors array<string>, num_votes bigint")
    rows = {r["request_id"]: r for r in serving_features(df, films).collect()}
    one = rows[1]
    assert (one["startYear"], one["runtimeMinutes"], one["numVotes_log"], one["is_dc"], one["genres_combined"]) == (1.25, 1.29, 7.5, 1.0, "Sci-Fi,Action")
    assert (one["director_avg_rating"], one["director_id"], one["actor_2_avg_rating"], one["actor_ids_combined"]) == (7.0, "d1", 6.5, "a1,a3")
    assert (rows[2]["title_len"], rows[2]["director_id"], rows[2]["actor_ids_combined"], rows[2]["genres_combined"]) == (0.0, "Unknown", "Unknown", "Unknown")
    assert rows[3]["director_avg_rating"] == 6.5 and rows[3]["numVotes_log"] == 0.0
    listed = df.withColumn("genres", F.array(F.lit("horror"), F.lit("sci fi")))
    assert serving_features(listed, films).first()["genres_combined"] == "Horror,Sci-Fi"


def test_pages(films):
    titles = films.titles
    seen, after = [], ""
    while rows := [r[0] for r in page(titles, "tconst", after, 4).collect()]:
        seen += rows
        after = rows[-1]
    assert seen == sorted(r["tconst"] for r in titles.collect())
    assert [r[0] for r in page(titles, "tconst", "", 2, 3).collect()] == seen[:6] and page(titles.limit(0), "tconst", "", 2).count() == 0
    assert [[r[0] for r in p.collect()] for p in pages(titles, "tconst", 4)] == [seen[i : i + 4] for i in range(0, len(seen), 4)]
    assert [p.count() for p in pages(titles, "tconst", 2, most=2)] == [2, 2] and list(pages(titles.limit(0), "tconst", 2)) == []
    assert [[r[0] for r in p.collect()] for p in pages(titles, "tconst", 100, after=seen[2])] == [seen[3:]]


def test_bound_list(spark):
    assert [r["k"] for r in bound_list(spark, ["b", "a", "b"], "k").collect()] == ["b", "a", "b"] and bound_list(spark, [], "k").count() == 0
