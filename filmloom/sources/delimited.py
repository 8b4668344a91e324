"""Gzip TSV deliveries: fetch, read with declared types, store filtered."""

from __future__ import annotations

import logging
import os
import urllib.request

from pyspark.sql import DataFrame, SparkSession

from filmloom.operators.films import Films, load_films

log = logging.getLogger(__name__)

#: Columns of each dataset that anything here reads, with their types; others of the file are skipped by name.
DATASETS = {
    "title.basics": "tconst string, titleType string, primaryTitle string, startYear bigint, runtimeMinutes bigint, genres string",
    "title.ratings": "tconst string, averageRating double, numVotes bigint",
    "title.principals": "tconst string, ordering bigint, nconst string, category string",
    "name.basics": "nconst string, primaryName string",
}


def table_name(dataset: str) -> str:
    return dataset.replace(".", "_")


def fetch(url: str, folder: str, dataset: str) -> str:
    """The path of the dataset's file in `folder`, downloaded from `url`/<dataset>.tsv.gz unless it is there.

    A file is moved into place when it is whole; an unreachable address raises URLError.
    """
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{dataset}.tsv.gz"
    if os.path.exists(path):
        log.info("%s is there already", path)
        return path
    part = f"{path}.part"
    urllib.request.urlretrieve(f"{url}/{dataset}.tsv.gz", part)
    os.replace(part, path)
    return path


def read_tsv(spark: SparkSession, path: str, dataset: str, tasks: int | None = None) -> DataFrame:
    r"""The dataset's declared columns of a TSV file with header, whatever order they stand in; `\N` is null.

    Quotes are ordinary characters. Fields that don't parse as their type are null. A gzip file is one partition, so
    its rows are spread over `tasks` before anything else works on them.
    """
    header = spark.read.text(path).first()
    names = header[0].split("\t") if header else []
    wanted = dict(c.strip().rsplit(" ", 1) for c in DATASETS[dataset].split(","))
    schema = ", ".join(f"`{n}` {wanted.get(n, 'string')}" for n in names) or DATASETS[dataset]
    rows = spark.read.schema(schema).option("sep", "\t").option("header", True).option("nullValue", "\\N").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    rows = rows.select(*wanted)
    return rows.repartition(tasks) if tasks else rows


def store(df: DataFrame, path: str, key: str) -> int:
    """Writes `df` as Parquet, replacing what is there, clustered by `key` so that row groups can be skipped; the rows."""
    df.repartition(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    log.info("%s: %d rows", path, rows)
    return rows


def ingest(spark: SparkSession, source: str, target: str, tasks: int | None = None) -> dict[str, int]:
    """Loads the four datasets of folder `source`, keeps what the pipeline needs, and stores tables in `target`.

    Returns the rows of each table. The order is that of the data: films first, then what belongs to them. Title and
    person keys must be unique in their tables; a repeated one raises ValueError.
    """
    read = lambda d: read_tsv(spark, f"{source}/{d}.tsv.gz", d, tasks)
    kept = load_films(Films(read("title.basics"), read("title.ratings"), read("title.principals"), read("name.basics")))
    parts = {"title.basics": (kept.titles, "tconst"), "title.ratings": (kept.ratings, "tconst"), "title.principals": (kept.credits, "tconst"), "name.basics": (kept.people, "nconst")}
    counts = {table_name(d): store(df, f"{target}/{table_name(d)}.parquet", key) for d, (df, key) in parts.items()}
    for name, key in (("title_basics", "tconst"), ("title_ratings", "tconst"), ("name_basics", "nconst")):
        stored = spark.read.parquet(f"{target}/{name}.parquet")
        if stored.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name} has a {key} more than once")
    return counts
