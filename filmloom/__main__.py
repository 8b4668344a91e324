"""python -m filmloom ingest SOURCE TABLES [URL] | train TABLES MODEL | predict TABLES MODEL REQUESTS.json"""

from __future__ import annotations

import json
import sys
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from filmloom.logs import set_up_logging
from filmloom.service import RatingService, fit, stored_films
from filmloom.sources.delimited import DATASETS, fetch, ingest


def main(args: list[str]) -> int:
    logger = set_up_logging()
    spark = SparkSession.builder.appName("filmloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    match args:
        case ["ingest", source, tables, *url] if len(url) < 2:
            if url:
                with ThreadPoolExecutor(len(DATASETS)) as pool:
                    list(pool.map(lambda d: fetch(url[0], source, d), DATASETS))
            logger.info("stored: %s", ingest(spark, source, tables, spark.sparkContext.defaultParallelism))
        case ["train", tables, model]:
            metadata = fit(spark, tables, model)
            logger.info("model: %s", metadata)
            return int(not metadata)
        case ["predict", tables, model, requests]:
            with open(requests, encoding="utf-8") as file:
                movies = json.load(file)
            for movie, rating in zip(movies, RatingService(spark, model, stored_films(spark, tables)).predict_batch(movies)):
                print(f"{movie.get('title')}\t{rating}")
        case _:
            print(__doc__, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
