"""The report of current orphan keys, kept up to date from a stream of count deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filmloom.operators.orphans import current_orphans, merge_counts

#: Micro-batches after which all sums so far become one table.
COMPACT_EVERY = 50


def keep_orphan_report(deltas: DataFrame, target: str, checkpoint: str, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Sums a stream of (key, refs, existing) by key and micro-batch into `target`.

    Sums add up, so the query keeps no state. Every `compact_every` batches the sums so far are written as one base,
    without the keys that have nothing left, and older batches are deleted: what is stored and read stays in proportion
    to the keys that exist or are referred to. A batch that runs again replaces its own folder, and whatever is older
    than a base counts no more, so an interrupted compaction counts nothing twice. Available files are processed, then
    the query ends.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"{target}/batch={number}"
        sums = batch.where("key is not null").groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))
        older = _batches(spark, target, number) if (number + 1) % compact_every == 0 else []
        if not older:
            if not _exists(spark, f"{own}/_SUCCESS"):
                sums.withColumn("base", F.lit(False)).write.mode("overwrite").parquet(own)
            return
        past = _standing(spark.read.option("basePath", target).parquet(*(f"{target}/batch={n}" for n in older)))
        merged = merge_counts(past, sums).where("refs <> 0 or existing <> 0")
        merged.withColumn("base", F.lit(True)).write.mode("overwrite").parquet(own)
        for n in older:
            _path(spark, target)[1].delete(_path(spark, f"{target}/batch={n}")[0], True)

    return deltas.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_report(changes: DataFrame) -> DataFrame:
    """The orphan keys (key, refs) by what `keep_orphan_report` wrote."""
    stored = _standing(changes)
    return current_orphans(merge_counts(stored.limit(0), stored)).select("key", "refs")


def _standing(changes: DataFrame) -> DataFrame:
    """The sums from the last base on."""
    base = changes.where("base").agg(F.max("batch")).first()[0]
    return (changes if base is None else changes.where(F.col("batch") >= base)).select("key", "refs", "existing")


def _path(spark, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark, name: str) -> bool:
    path, files = _path(spark, name)
    return files.exists(path)


def _batches(spark, target: str, before: int) -> list[int]:
    path, files = _path(spark, target)
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted(n for name in names if name.startswith("batch=") and (n := int(name[6:])) < before)
