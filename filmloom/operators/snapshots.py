"""Differences between consecutive full snapshots of a table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.scratch import BROADCAST_BYTES, ROW_OVERHEAD


def row_hash(values: list[Column]) -> Column:
    """64-bit hash of a row in which a null differs from every value and equals null."""
    marked = reduce(lambda all_, c: [*all_, c.isNull(), c], values, [])
    return F.xxhash64(*marked)


def snapshot_changes(df: DataFrame, snapshot: Column, key: Column, values: list[Column], delivered: Column) -> DataFrame:
    """Added, removed and changed keys of each snapshot against the one before it.

    Every row is tagged twice: as the later side of its own snapshot and as the earlier side of the next one. One
    aggregation by (snapshot, key) with map-side combine keeps, per side, the hash of the row delivered last, and the
    two hashes classify the key. One shuffle, no join, and a key repeated any number of times is one row per map task.

    Rows without a snapshot or key are ignored; null values are values of their own. A null `delivered` comes before
    every other; of rows delivered at the same time the one with the larger hash counts. With fewer than two snapshots
    the result is empty. Result: snapshot, key, change_kind.
    """
    rows = df.select(
        snapshot.alias("at"), key.alias("key"), F.struct(delivered.alias("d"), row_hash(values).alias("h")).alias("row")
    ).where(F.col("at").isNotNull() & F.col("key").isNotNull())
    dates = [r[0] for r in df.select(snapshot.alias("at")).where("at is not null").distinct().collect()]  # one per snapshot
    dates.sort()
    following = df.sparkSession.createDataFrame(
        [(a, a if i else None, b) for i, (a, b) in enumerate(zip(dates, [*dates[1:], None]))],
        f"at {rows.schema['at'].dataType.simpleString()}, own {rows.schema['at'].dataType.simpleString()}, next {rows.schema['at'].dataType.simpleString()}",
    )
    tagged = (
        rows.join(F.broadcast(following) if len(dates) * ROW_OVERHEAD <= BROADCAST_BYTES else following, "at")
        .select("key", "row", F.explode(F.array(F.struct(F.col("own").alias("at"), F.lit(True).alias("later")), F.struct(F.col("next").alias("at"), F.lit(False).alias("later")))).alias("side"))
        .select("key", "row", "side.*")
        .where("at is not null")
    )
    both = tagged.groupBy("at", "key").agg(
        F.max(F.when(~F.col("later"), F.col("row"))).alias("before"), F.max(F.when(F.col("later"), F.col("row"))).alias("after")
    )
    kind = (
        F.when(F.col("before").isNull(), "added")
        .when(F.col("after").isNull(), "removed")
        .when(F.col("before.h") != F.col("after.h"), "changed")
    )
    return both.select(F.col("at").alias("snapshot"), "key", kind.alias("change_kind")).where("change_kind is not null")
