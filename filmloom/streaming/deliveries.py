"""Delivery lines as a stream: sound rows and rejects go to their own tables as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filmloom.operators.deliveries import parse_deliveries


def line_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """New lines of the text files that arrive in `folder`, as (raw_id, line): the id is a hash of file and line."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder).withColumn("file", F.col("_metadata.file_path"))
    return lines.select(F.xxhash64("file", "value").alias("raw_id"), F.col("value").alias("line"))


def route_deliveries(lines: DataFrame, target: str, checkpoint: str, fields: int, checks: list[tuple[str, int, int, int]]) -> StreamingQuery:
    """Parses a stream of (raw_id, line) and writes `target`/valid and `target`/rejected.

    Parsing keeps no state. Each micro-batch replaces its own folder of both tables, so one that is run again after a
    failure leaves no row twice. Available files are processed, then the query ends.
    """
    parsed = parse_deliveries(lines, "raw_id", "line", fields, checks)

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.where("reason is null").select("row_id", "fields").write.mode("overwrite").parquet(f"{target}/valid/batch={number}")
        batch.where("reason is not null").select("row_id", "reason", "edits").write.mode("overwrite").parquet(f"{target}/rejected/batch={number}")
        batch.unpersist()

    return parsed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
