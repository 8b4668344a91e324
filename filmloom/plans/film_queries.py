"""Registered queries on films: loads, lookups, enrichment, features, serving."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filmloom.functions.features import CATEGORICAL, DEFAULT_RATING, YEARS, categorical_features, clamp_rating, numeric_features, serving_actor_key, training_actor_key
from filmloom.functions.text import FRANCHISE_WORDS, GENRE_SYNONYMS, TITLE_FEATURES, is_blank, normalize_genres, split_genres, title_features
from filmloom.operators import films as ops
from filmloom.operators.explain import BECAUSE, NAMED, NOTABLE, NOTHING, contributions, explanation
from filmloom.operators.model import RatingModel, held_out, regression_metrics, train
from filmloom.operators.people import people_lookup
from filmloom.operators.serving import serving_features
from filmloom.plans.film_views import VIEWS_SQL, FilmViews, film_views
from filmloom.scratch import cut
from filmloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name or another, with its SQL twin over the film views."""

    def register(function: Query) -> Query:
        QUERIES[name or function.__name__] = function
        if sql is not None:
            ORACLES[name or function.__name__] = VIEWS_SQL + sql
        return function

    return register


# Scans, loads and pages.


@query("SELECT tconst, titleType, primaryTitle, startYear, runtimeMinutes, genres FROM movies")
def load_basics(spark, folder):
    return ops.load_films(film_views(spark, folder)).titles


@query("SELECT tconst, averageRating, numVotes FROM ratings WHERE tconst IN (SELECT tconst FROM movies)")
def load_ratings(spark, folder):
    return ops.load_films(film_views(spark, folder)).ratings


@query("SELECT * FROM credits WHERE tconst IN (SELECT tconst FROM movies) AND category IN ('director', 'actor', 'actress')")
def load_principals(spark, folder):
    return ops.load_films(film_views(spark, folder)).credits


@query("""SELECT * FROM people WHERE nconst IN (SELECT nconst FROM credits
WHERE tconst IN (SELECT tconst FROM movies) AND category IN ('director', 'actor', 'actress'))""")
def load_names(spark, folder):
    return ops.load_films(film_views(spark, folder)).people


@query("""SELECT 'title_basics' AS table_name, count(*) AS n_rows FROM title_basics UNION ALL SELECT 'title_ratings', count(*) FROM title_ratings
UNION ALL SELECT 'title_principals', count(*) FROM title_principals UNION ALL SELECT 'name_basics', count(*) FROM name_basics""")
def table_row_counts(spark, folder):
    names = ["title_basics", "title_ratings", "title_principals", "name_basics"]
    counts = [table(spark, folder, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    return counts[0].union(counts[1]).union(counts[2]).union(counts[3])


#: Rows of a page, and the key after which the registered page starts.
PAGE_ROWS, PAGE_AFTER = 100, "tt90002"


@query(f"SELECT tconst FROM movies WHERE tconst > '{PAGE_AFTER}' ORDER BY tconst LIMIT {PAGE_ROWS}")
def keyset_page(spark, folder):
    """A page of film keys after a given one: the limit is the feature."""
    return ops.page(ops.usable(film_views(spark, folder).titles), "tconst", PAGE_AFTER, PAGE_ROWS)


#: Pages of the registered capped run.
PAGE_CAP = 3


@query(f"""SELECT tconst, genre FROM (SELECT tconst, unnest(string_split(genres, ',')) AS genre FROM movies
WHERE tconst IN (SELECT tconst FROM movies ORDER BY tconst LIMIT {PAGE_ROWS * PAGE_CAP}))""")
def capped_pages(spark, folder):
    """Genres of the films on the first PAGE_CAP pages, fetched page by page: the cap is the feature."""
    movies = ops.usable(film_views(spark, folder).titles)
    keys = reduce(DataFrame.union, ops.pages(movies, "tconst", PAGE_ROWS, most=PAGE_CAP), movies.select("tconst").limit(0))
    kept = movies.join(keys, "tconst", "left_semi")
    return kept.select("tconst", F.explode(split_genres(F.col("genres"))).alias("genre"))


@query("SELECT tconst, primaryTitle, startYear, runtimeMinutes, genres, averageRating, numVotes FROM rated")
def batch_movies(spark, folder):
    return ops.rated_films(film_views(spark, folder))


@query(f"""SELECT m.tconst, averageRating, numVotes FROM (SELECT unnest(list(tconst)) AS tconst FROM (
SELECT tconst FROM movies WHERE tconst > '{PAGE_AFTER}' ORDER BY tconst LIMIT {PAGE_ROWS})) m JOIN ratings USING (tconst)""")
def bound_keys(spark, folder):
    """Ratings of a list of keys that the caller holds, here those of a page: the list is a relation and is joined as one."""
    views = film_views(spark, folder)
    held = [r["tconst"] for r in ops.page(ops.usable(views.titles), "tconst", PAGE_AFTER, PAGE_ROWS).collect()]
    return ops.bound_list(spark, held, "tconst").join(views.ratings, "tconst")


# Genres.


@query("SELECT genre, count(*) AS n FROM (SELECT unnest(string_split(genres, ',')) AS genre FROM titles WHERE titleType = 'movie' AND genres IS NOT NULL) GROUP BY genre")
def genre_counts(spark, folder):
    """Films per genre as spelt, empty ones too: one row per title and part, partial counts before the shuffle."""
    movies = film_views(spark, folder).titles.where("titleType = 'movie' and genres is not null")
    return movies.select(F.explode(split_genres(F.col("genres"))).alias("genre")).groupBy("genre").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT genre FROM (SELECT unnest(string_split(genres, ',')) AS genre FROM titles WHERE titleType = 'movie' AND genres IS NOT NULL) WHERE trim(genre) <> ''")
def genre_distinct(spark, folder):
    movies = film_views(spark, folder).titles.where("titleType = 'movie' and genres is not null")
    return movies.select(F.explode(split_genres(F.col("genres"))).alias("genre")).where(~is_blank(F.col("genre"))).distinct()


_SYNONYM_SQL = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in GENRE_SYNONYMS.items())
NORMALIZE_SQL = rf"""CASE WHEN len(list_filter(string_split(coalesce(genres, ''), ','), lambda g: trim(g) <> '')) = 0 THEN 'Unknown' ELSE
  array_to_string(list_transform(list_filter(string_split(genres, ','), lambda g: trim(g) <> ''), lambda g: CASE lower(trim(g)) {_SYNONYM_SQL} ELSE
    array_to_string(list_transform(list_filter(string_split(lower(trim(g)), '-'), lambda p: p <> ''), lambda p:
      array_to_string(list_transform(regexp_extract_all(p, '(\pL+|\PL+)'), lambda r: upper(r[1:1]) || r[2:]), '')), '-') END), ',') END"""


@query(f"SELECT tconst, {NORMALIZE_SQL} AS genres_combined FROM titles")
def genre_normalized(spark, folder):
    return film_views(spark, folder).titles.select("tconst", normalize_genres(F.col("genres")).alias("genres_combined"))


# Titles.


def _title_sql(column: str, kind: str = "BIGINT") -> str:
    known = f"nullif({column}, '')"
    flags = [f"CAST({' OR '.join(f'contains(lower({known}), {chr(39)}{w}{chr(39)})' for w in words)} AS {kind}) AS is_{name}" for name, words in FRANCHISE_WORDS.items()]
    space = r"[^\s\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return ", ".join([*flags, f"CAST(length({known}) AS {kind}) AS title_len", f"CAST(len(regexp_extract_all({known}, '{space}')) AS {kind}) AS title_word_count",
                      rf"CAST(regexp_matches({known}, '\p{{Nd}}') AS {kind}) AS has_digit", f"CAST(contains({known}, ':') AS {kind}) AS has_colon"])


@query(f"SELECT tconst, {_title_sql('primaryTitle')} FROM titles", name="title_features")
def title_feature_rows(spark, folder):
    return film_views(spark, folder).titles.select("tconst", *(c.alias(n) for n, c in title_features(F.col("primaryTitle")).items()))


@query(f"SELECT doc_id, {_title_sql('text')} FROM documents", name="text_features")
def text_feature_rows(spark, folder):
    """The title features of long texts."""
    return table(spark, folder, "documents").select("doc_id", *(c.alias(n) for n, c in title_features(F.col("text")).items()))


# People of films.


@query("SELECT tconst, min(ordering) AS min_ord FROM credits WHERE category = 'director' GROUP BY tconst")
def director_ordering(spark, folder):
    return ops.director_ordering(film_views(spark, folder))


@query("""SELECT c.tconst, c.nconst AS director_nconst FROM credits c
JOIN (SELECT tconst, min(ordering) AS o FROM credits WHERE category = 'director' GROUP BY tconst) d ON c.tconst = d.tconst AND c.ordering = d.o""")
def first_director(spark, folder):
    return ops.first_directors(film_views(spark, folder))


@query("SELECT tconst, ordering, nconst, place FROM top3")
def top3_actors(spark, folder):
    return ops.leading_actors(film_views(spark, folder))


@query("SELECT * FROM slots")
def actors_pivot(spark, folder):
    return ops.actor_slots(film_views(spark, folder))


@query("""SELECT tconst, max(CASE WHEN place = 1 THEN nconst END) AS actor_1_nconst, max(CASE WHEN place = 2 THEN nconst END) AS actor_2_nconst,
max(CASE WHEN place = 3 THEN nconst END) AS actor_3_nconst FROM top3 GROUP BY tconst""")
def actors_pivot_by_place(spark, folder):
    return ops.actor_slots(film_views(spark, folder), by_place=True)


@query("SELECT nconst, avg_rating, n_credits FROM director_stats")
def director_stats(spark, folder):
    return ops.director_ratings(film_views(spark, folder))


@query("SELECT nconst, avg_rating, n_credits FROM actor_stats")
def actor_stats(spark, folder):
    return ops.actor_ratings(film_views(spark, folder))


def _enriched(spark: SparkSession, folder: str) -> DataFrame:
    return ops.enriched(film_views(spark, folder).with_stored_credits(ops.KEPT_CATEGORIES))


@query("SELECT * FROM enriched")
def enriched_titles(spark, folder):
    return _enriched(spark, folder)


@query("SELECT * FROM bounded")
def bounded_titles(spark, folder):
    return ops.bounded(_enriched(spark, folder))


# Features.

_F32 = lambda x: f"CAST(CAST({x} AS FLOAT) AS DOUBLE)"
_NUMERIC_SQL = (
    f"(startYear - {YEARS[0]}) / 100.0::DOUBLE AS startYear, runtimeMinutes / 100.0::DOUBLE AS runtimeMinutes, {_F32('ln(1 + numVotes::DOUBLE)')} AS numVotes_log, "
    f"{_F32('director_avg_rating')} AS director_avg_rating, "
    + ", ".join(f"{_F32(f'actor_{k}_avg_rating')} AS actor_{k}_avg_rating" for k in (1, 2, 3))
    + ", "
    + _title_sql("primaryTitle", "DOUBLE")
)
_ACTOR_KEY_SQL = "CASE WHEN x = '' THEN 'Unknown' ELSE x END"
_TRAIN_KEY_SQL = _ACTOR_KEY_SQL.replace("x", "trim(coalesce(actor_1_nconst, '') || ',' || coalesce(actor_2_nconst, '') || ',' || coalesce(actor_3_nconst, ''), ',')")
_SERVE_KEY_SQL = _ACTOR_KEY_SQL.replace("x", "concat_ws(',', actor_1_nconst, actor_2_nconst, actor_3_nconst)")
_CATEGORICAL_SQL = f"{NORMALIZE_SQL} AS genres_combined, coalesce(director_nconst, 'Unknown') AS director_id, {_TRAIN_KEY_SQL} AS actor_ids_combined"
_NUMERIC_NAMES = ["startYear", "runtimeMinutes", "numVotes_log", "director_avg_rating", "actor_1_avg_rating", "actor_2_avg_rating", "actor_3_avg_rating", *TITLE_FEATURES]


@query(f"SELECT tconst, {_NUMERIC_SQL} FROM bounded", name="numeric_features")
def numeric_feature_rows(spark, folder):
    return ops.bounded(_enriched(spark, folder)).select("tconst", *(c.alias(n) for n, c in numeric_features(F.col("primaryTitle")).items()))


@query(f"SELECT tconst, {_CATEGORICAL_SQL} FROM bounded", name="categorical_features")
def categorical_feature_rows(spark, folder):
    return ops.bounded(_enriched(spark, folder)).select("tconst", *(c.alias(n) for n, c in categorical_features().items()))


def _frame_sql(masked: list[str], left_out: tuple[str, ...] = ()) -> str:
    names = [n for n in [*_NUMERIC_NAMES, *CATEGORICAL] if n not in left_out]
    return f"""SELECT tconst, primaryTitle, averageRating, {', '.join(names)} FROM (
SELECT tconst, primaryTitle, {_F32('averageRating')} AS averageRating, {_NUMERIC_SQL}, {_CATEGORICAL_SQL} FROM bounded)
WHERE {' AND '.join(f'{n} IS NOT NULL' for n in masked)}"""


@query(_frame_sql(_NUMERIC_NAMES))
def training_frame(spark, folder):
    return ops.training_rows(_enriched(spark, folder))


_STATS = ("director_avg_rating", "actor_1_avg_rating", "actor_2_avg_rating", "actor_3_avg_rating")


@query(_frame_sql([n for n in _NUMERIC_NAMES if n not in _STATS], _STATS))
def training_frame_without_people(spark, folder):
    return ops.training_rows(_enriched(spark, folder), director_stats=False, actor_stats=False)


@query(f"SELECT tconst, {_TRAIN_KEY_SQL} AS actor_ids_combined FROM slots")
def actor_key_train(spark, folder):
    slots = ops.actor_slots(film_views(spark, folder))
    return slots.select("tconst", training_actor_key(*(F.col(f"actor_{k}_nconst") for k in (1, 2, 3))).alias("actor_ids_combined"))


@query(f"SELECT tconst, {_SERVE_KEY_SQL} AS actor_ids_combined FROM slots")
def actor_key_serve(spark, folder):
    slots = ops.actor_slots(film_views(spark, folder))
    return slots.select("tconst", serving_actor_key(*(F.col(f"actor_{k}_nconst") for k in (1, 2, 3))).alias("actor_ids_combined"))


# Serving.

_PERSON_STATS_SQL = """,
person_stats AS (
  SELECT nconst, CAST(sum(CAST(averageRating AS DECIMAL(18, 4))) AS DOUBLE) / count(*) AS avg_rating, count(*) AS n_credits
  FROM credits JOIN titles USING (tconst) JOIN ratings USING (tconst) WHERE titleType = 'movie' AND averageRating IS NOT NULL AND nconst IS NOT NULL GROUP BY nconst)
"""
#: A name that nobody has.
NOBODY = "Nobody By This Name"


@query(
    _PERSON_STATS_SQL
    + f""", asked AS (SELECT DISTINCT upper(primaryName) AS name FROM people WHERE trim(primaryName) <> '' UNION ALL SELECT '{NOBODY}'),
ids AS (SELECT DISTINCT nconst, primaryName FROM people JOIN asked ON lower(primaryName) = lower(name))
SELECT primaryName, nconst, avg_rating FROM ids JOIN person_stats USING (nconst)
UNION ALL SELECT name, NULL, 6.5 FROM asked WHERE NOT EXISTS (SELECT 1 FROM ids WHERE lower(ids.primaryName) = lower(asked.name))""", name="people_lookup")
def people_by_name(spark, folder):
    """The lookup of every name, asked in upper case, and of one that nobody has."""
    views = film_views(spark, folder)
    names = views.people.select(F.upper("primaryName").alias("name")).where(~is_blank(F.col("name"))).distinct()
    return people_lookup(names.union(spark.createDataFrame([(NOBODY,)], "name string")), views)


def _requests(views: FilmViews) -> DataFrame:
    """A request for each title, naming its first director and leading actors as name_basics spells them; a stored table,
    as requests are."""
    names = views.people.where("primaryName is not null").groupBy("nconst").agg(F.min("primaryName").alias("name"))
    cast = ops.leading_credits(views).where("role = 1 or place = 1").select("tconst", (F.col("place") * F.col("role")).alias("place"), "nconst").where("nconst is not null")
    named = cast.join(names, "nconst").groupBy("tconst").agg(
        F.max(F.when(F.col("place") == 0, F.col("name"))).alias("director"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", "name")))), lambda x: x["name"]).alias("actors")
    )
    votes = views.ratings.select("tconst", F.col("numVotes").alias("num_votes"))
    titles = views.titles.join(named, "tconst", "left").join(votes, "tconst", "left")
    return cut(titles.select(F.col("tconst").alias("request_id"), F.col("primaryTitle").alias("title"), F.col("startYear").alias("year"), F.col("runtimeMinutes").alias("runtime"), "genres", "director", "actors", "num_votes"))


_SERVING_SQL = (
    _PERSON_STATS_SQL
    + f""", names AS (SELECT nconst, min(primaryName) AS name FROM people WHERE primaryName IS NOT NULL GROUP BY nconst),
best AS (SELECT * FROM (SELECT lower(primaryName) AS low, nconst, avg_rating, row_number() OVER (PARTITION BY lower(primaryName) ORDER BY n_credits DESC, nconst) AS k
  FROM (SELECT DISTINCT nconst, primaryName FROM people WHERE primaryName IS NOT NULL) JOIN person_stats USING (nconst)) WHERE k = 1),
cast_names AS (
  SELECT tconst, 0 AS place, name FROM directors JOIN names USING (nconst)
  UNION ALL SELECT tconst, row_number() OVER (PARTITION BY tconst ORDER BY place) AS place, name FROM top3 JOIN names USING (nconst)),
resolved AS (SELECT tconst, place, nconst, avg_rating FROM cast_names LEFT JOIN best ON best.low = lower(name) WHERE trim(name) <> ''),
wide AS (SELECT tconst, {', '.join(f'max(CASE WHEN place = {k} THEN nconst END) AS id_{k}, max(CASE WHEN place = {k} THEN avg_rating END) AS rating_{k}' for k in range(4))} FROM resolved GROUP BY tconst)
SELECT t.tconst AS request_id, (startYear - 1900) / 100.0::DOUBLE AS startYear, runtimeMinutes / 100.0::DOUBLE AS runtimeMinutes,
  coalesce({_F32('ln(1 + numVotes::DOUBLE)')}, 7.5) AS numVotes_log, {_F32('coalesce(rating_0, 6.5)')} AS director_avg_rating,
  {', '.join(f"{_F32(f'coalesce(rating_{k}, 6.5)')} AS actor_{k}_avg_rating" for k in (1, 2, 3))},
  {', '.join(f'coalesce({n}, 0) AS {n}' for n in TITLE_FEATURES)}, genres_combined, coalesce(id_0, 'Unknown') AS director_id,
  CASE WHEN concat_ws(',', id_1, id_2, id_3) = '' THEN 'Unknown' ELSE concat_ws(',', id_1, id_2, id_3) END AS actor_ids_combined
FROM (SELECT *, {_title_sql('primaryTitle', 'DOUBLE')}, {NORMALIZE_SQL} AS genres_combined FROM titles) t LEFT JOIN wide USING (tconst) LEFT JOIN ratings USING (tconst)"""
)


@query(_SERVING_SQL, name="serving_features")
def serving_feature_rows(spark, folder):
    views = film_views(spark, folder).with_stored_credits()
    return serving_features(_requests(views), views)


@query("SELECT tconst, CAST(printf('%.2f', greatest(0.0::DOUBLE, least(10.0::DOUBLE, averageRating * 1.5::DOUBLE - 2))) AS DOUBLE) AS rating FROM ratings WHERE averageRating IS NOT NULL")
def clamped_rating(spark, folder):
    """Ratings stretched beyond their range, clamped and rounded."""
    return film_views(spark, folder).ratings.where("averageRating is not null").select("tconst", clamp_rating(F.col("averageRating") * 1.5 - 2).alias("rating"))


# Models.

def _model(spark: SparkSession, folder: str) -> tuple[RatingModel | None, dict, DataFrame]:
    rows = ops.training_rows(_enriched(spark, folder))
    return *train(rows), rows


@query()
def train_predict(spark, folder):
    """Ratings of a request for every title, by the model of the same tables; null where no film can be learned from."""
    model, _, _ = _model(spark, folder)
    views = film_views(spark, folder).with_stored_credits()
    features = serving_features(_requests(views), views)
    scored = model.score(features) if model else features.withColumn("rating", F.lit(None).cast("double"))
    return scored.select("request_id", "rating")


@query()
def model_metrics(spark, folder):
    """Rows used and held-out measures; no row where no film can be learned from."""
    _, m, _ = _model(spark, folder)
    rows = [(m["total_rows"], m["test_rows"], m["test_mae"], m["test_rmse"], m["test_r2"])] if m else []
    return spark.createDataFrame(rows, "total_rows bigint, test_rows bigint, mae double, rmse double, r2 double")


@query()
def feature_importance(spark, folder):
    model, _, _ = _model(spark, folder)
    return model.importance(spark) if model else spark.createDataFrame([], "feature string, importance double")


@query()
def shap_contributions(spark, folder):
    """Contributions and explanation of every film's predicted rating; no rows where no film can be learned from."""
    model, metadata, rows = _model(spark, folder)
    if model is None:
        return rows.select("tconst", *(F.lit(0.0).alias(n) for n in ("prediction", "rating", "base")), F.array(F.lit(0.0)).alias("contributions"), F.lit("").alias("explanation")).where("false")
    explained = contributions(model, rows, "tconst")
    return explained.select("tconst", "prediction", "rating", "base", "contributions", explanation(metadata["feature_names"], F.col("contributions")).alias("explanation"))


@query(f"""SELECT count(*) AS n, round(avg(abs(e)), 6) AS mae, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2
FROM (SELECT averageRating AS y, averageRating - coalesce(director_avg_rating, {DEFAULT_RATING}) AS e FROM bounded)""", name="regression_metrics")
def regression_measures(spark, folder):
    """The measures of a model, here of the director's mean as the prediction."""
    rows = ops.bounded(_enriched(spark, folder)).withColumn("guess", F.coalesce("director_avg_rating", F.lit(DEFAULT_RATING)))
    return regression_metrics(rows, "averageRating", "guess").select("n", *(F.round(c, 6).alias(c) for c in ("mae", "rmse", "r2")))


#: What must hold for every model.
MODEL_CHECKS = ("contributions_add_up", "importances_sum_to_one", "metrics_recomputed", "ratings_in_range")


@query("SELECT unnest([" + ", ".join(f"'{c}'" for c in MODEL_CHECKS) + "]) AS check_name, true AS holds WHERE EXISTS (SELECT 1 FROM title_basics)")
def model_checks(spark, folder):
    """Whether a model's contributions add up to its predictions, its importances to one, its ratings lie in range, and
    its measures follow from its predictions for the held-out films; no row where no film can be learned from."""
    model, metadata, rows = _model(spark, folder)
    if model is None:
        return spark.createDataFrame([], "check_name string, holds boolean")
    scored = model.score(rows.where(held_out(F.col("tconst"), metadata["test_size"])))
    error = F.col("averageRating") - F.col("prediction")
    mae, rmse, low, high, n = scored.agg(F.avg(F.abs(error)), F.sqrt(F.avg(error * error)), F.min("rating"), F.max("rating"), F.count(F.lit(1))).first()
    added = F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, b: a + b)
    gap = contributions(model, rows, "tconst").agg(F.max(F.abs(added - F.col("prediction")))).first()[0]
    near = lambda a, b: a == b or abs(a - b) < 1e-9
    holds = (
        gap < 1e-6,
        near(model.importance(spark).agg(F.sum("importance")).first()[0], 1.0) or not any(model.trees.featureImportances.toArray()),
        metadata["test_rows"] == n and near(metadata["test_mae"], mae) and near(metadata["test_rmse"], rmse),
        n == 0 or 0 <= low <= high <= 10,
    )
    return spark.createDataFrame(list(zip(MODEL_CHECKS, map(bool, holds))), "check_name string, holds boolean")


_GIVEN = {"startYear": "(startYear - 1950) / 100.0::DOUBLE", "runtimeMinutes": "(runtimeMinutes - 100) / 100.0::DOUBLE", "director_avg_rating": "director_avg_rating - averageRating",
          "actor_1_avg_rating": "actor_1_avg_rating - averageRating", "actor_2_avg_rating": "actor_2_avg_rating - averageRating", "actor_3_avg_rating": "actor_3_avg_rating - averageRating"}


@query(f"""SELECT tconst, CASE WHEN len(words) = 0 THEN '{NOTHING}' ELSE '{BECAUSE}' || array_to_string(words, '; ') END AS explanation FROM (
SELECT tconst, list_transform(list_filter(list_sort(list_filter([{', '.join(f"{{'size': -abs({v}), 'i': {i}, 'n': '{n}', 'v': {v}}}" for i, (n, v) in enumerate(_GIVEN.items()))}],
  lambda s: s.v IS NOT NULL))[:{NAMED}], lambda s: abs(s.v) > {NOTABLE}), lambda s: s.n || ': ' || CASE WHEN s.v > 0 THEN '+' ELSE '' END || printf('%.2f', s.v)) AS words FROM bounded)""")
def explanation_text(spark, folder):
    """The text of given contributions: how far a film's features lie from usual ones."""
    rows = ops.bounded(_enriched(spark, folder))
    given = [(F.col("startYear") - 1950) / F.lit(100.0), (F.col("runtimeMinutes") - 100) / F.lit(100.0), *(F.col(n) - F.col("averageRating") for n in list(_GIVEN)[2:])]
    return rows.select("tconst", explanation(list(_GIVEN), F.array(*given)).alias("explanation"))
