"""References that no row of the target table covers at their time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.scratch import cut, join_counted


def existence_deltas(target: DataFrame) -> DataFrame:
    """Signed existence changes (key, t, delta) of target rows (key, start, end).

    A row counts +1 from `start` and -1 from `end`; a null `end` never comes. Rows without key or start, and rows that
    end no later than they start, cover no time and give no change.
    """
    live = target.where("key is not null and start is not null and (`end` is null or `end` > start)")
    return live.select(
        "key", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("delta")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("delta")))).alias("x")
    ).select("key", "x.t", "x.delta").where("t is not null")


def uncovered_spans(moves: DataFrame, days: DataFrame) -> DataFrame:
    """Stretches of a day in which its key does not exist: (key, day, from, to), `to` excluded and null at the day's end.

    moves: existence changes (key, day, t, net), one row per time; days: a stored table (key, day, carried, ...) with what
    exists at its start.
    Only changes are ordered, never references.
    """
    order = Window.partitionBy("key", "day").orderBy("t")
    ran = join_counted(moves, days, ["key", "day"], "inner").select(
        "key",
        "day",
        F.col("t").alias("from"),
        F.lead("t").over(order).alias("to"),
        (F.col("carried") + F.sum("net").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("existing"),
        F.when(F.row_number().over(order) == 1, F.col("carried")).alias("before"),
    )
    start = F.when(F.col("before") == 0, F.struct(F.col("day").cast("timestamp_ntz").alias("from"), F.col("from").alias("to")))
    after = F.when(F.col("existing") == 0, F.struct("from", "to"))
    return ran.select("key", "day", F.explode(F.array_compact(F.array(start, after))).alias("s")).select("key", "day", "s.from", "s.to")


def orphan_references(refs: DataFrame, target: DataFrame) -> DataFrame:
    """Orphan references per key and month: refs (key, t) against target rows (key, start, end).

    References are first counted per key and day, with their first and last time, and signed existence deltas are
    summed, both with map-side combine, so that a key with a third of all rows is a few thousand rows. The running
    existence of a key over its days decides every day without deltas: positive references and zero existence is an
    orphan. In a day with deltas these alone are ordered, and give the stretches without existence: a first or last
    reference within one is an orphan. Only where a stretch lies between the two are references looked up again, by
    joining them with these stretches; both tables are read once otherwise.

    References without key or time are no references. Repeated rows, on either side, change nothing. An empty target
    makes every reference an orphan. Result, distinct: ref_month (yyyy-MM), key.
    """
    known = refs.where("key is not null and t is not null").select("key", "t", F.to_date("t").alias("day"))
    moves = cut(existence_deltas(target).groupBy("key", "t").agg(F.sum("delta").alias("net")).where("net <> 0").withColumn("day", F.to_date("t")))
    before = Window.partitionBy("key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = (
        known.unionByName(moves.select("key", "day", "net"), allowMissingColumns=True)
        .groupBy("key", "day")
        .agg(F.min("t").alias("first"), F.max("t").alias("last"), F.sum("net").alias("net"))
        .withColumn("carried", F.coalesce(F.sum("net").over(before), F.lit(0)))
        .where("first is not null and (net is not null or carried = 0)")
    )
    days = cut(days.select("key", "day", "first", "last", F.col("net").isNotNull().alias("open"), "carried"))
    open_days = cut(days.where("open").select("key", "day", "carried", "first", "last"))
    spans = cut(uncovered_spans(moves, open_days))
    within = lambda t: (F.col(t) >= F.col("from")) & (F.col("to").isNull() | (F.col(t) < F.col("to")))
    between = (F.col("from") > F.col("first")) & (F.col("to") <= F.col("last"))
    judged = join_counted(open_days.drop("carried"), spans, ["key", "day"], "inner").groupBy("key", "day").agg(F.max(within("first") | within("last")).alias("orphan"), F.max(between).alias("between"))
    judged = cut(judged.where("orphan or between"))
    found = days.where("not open").select("key", "day").union(judged.where("orphan").select("key", "day"))
    unsure = judged.where("not orphan").select("key", "day")
    if not unsure.isEmpty():
        asked = cut(spans.join(unsure, ["key", "day"]))
        found = found.union(join_counted(known, asked, ["key", "day"], "inner").where(within("t")).select("key", "day"))
    return found.select(F.date_format("day", "yyyy-MM").alias("ref_month"), "key").distinct()


def count_deltas(refs: DataFrame, target: DataFrame, since=None, until=None) -> DataFrame:
    """Signed changes (key, refs, existing) that reference rows (key) and target rows (key, start, end) make.

    With `since` or `until` only those of references and changes of existence at times t with since <= t < until; the
    references then have a time t.
    """

    def timely(rows: DataFrame) -> DataFrame:
        rows = rows if since is None else rows.where(F.col("t") >= F.lit(since))
        return rows if until is None else rows.where(F.col("t") < F.lit(until))

    named = timely(refs.where("key is not null")).select("key", F.lit(1).cast("bigint").alias("refs"), F.lit(0).cast("bigint").alias("existing"))
    return named.unionByName(timely(existence_deltas(target)).select("key", F.lit(0).cast("bigint").alias("refs"), F.col("delta").cast("bigint").alias("existing")))


def merge_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counts (key, refs, existing) after more deltas of the same form; removed references come with negative refs.

    Also right for a stream of deltas, where Spark keeps the sums as state. Keys with nothing left stay with zeros.
    """
    return counts.unionByName(deltas).groupBy("key").agg(F.sum("refs").alias("refs"), F.sum("existing").alias("existing"))


def current_orphans(counts: DataFrame) -> DataFrame:
    """The counts of keys that are referred to and don't exist."""
    return counts.where("refs > 0 and existing = 0")
