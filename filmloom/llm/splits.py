"""Splits that keep connected records together."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.llm.components import connected_components
from filmloom.scratch import BROADCAST_BYTES, ROW_OVERHEAD, cut, join_counted

#: Rows that one rank bucket holds about.
RANK_BUCKET = 100_000
#: Groups of one size up to which the greedy choice is simulated one by one.
SIMULATED = 1000


def groups_of(pairs: DataFrame) -> DataFrame:
    """Items that share an owner, directly or through others: (item, owner) to (item, group, items), for groups of any size.

    `group` is the smallest item of the group, `items` their number. Rows with a null item or owner connect nothing and
    give no row.
    """
    known = pairs.where("item is not null and owner is not null")
    edges = known.select(F.concat(F.lit("i"), F.col("item")).alias("a"), F.concat(F.lit("o"), F.col("owner")).alias("b"))
    labels = cut(connected_components(edges).where("node like 'i%'").select(F.substring("node", 2, 1 << 30).alias("item"), "root"))
    groups = cut(labels.groupBy("root").agg(F.min("item").alias("group"), F.count(F.lit(1)).alias("items")))
    return join_counted(labels, groups, ["root"], "inner").select("item", "group", "items")


def greedy_counts(sizes: list[tuple[int, int]], shares: list[float]) -> list[tuple[int, list[int]]]:
    """Groups of each size that each split gets: largest first, each to the split furthest below its target.

    sizes: (size, number of groups); ties go to the earlier split. Picking the largest of the deficits again and again
    takes the largest values of the falling sequences deficit - j * size, so many equal groups are placed at once by a
    bound on the value and only the last few one by one: the outcome is that of the one-by-one choice.
    """
    total = sum(s * c for s, c in sizes)
    short = [share * total for share in shares]
    out = []
    for size, count in sorted(sizes, reverse=True):
        got = [0] * len(shares)
        left = count
        if count > SIMULATED:
            low, high = min(short) - size * (count + 1), max(short)
            for _ in range(200):
                mid = (low + high) / 2
                if sum(max(0, math.ceil((d - mid) / size)) for d in short) <= count:
                    high = mid
                else:
                    low = mid
            got = [max(0, math.ceil((d - high) / size)) for d in short]
            left = count - sum(got)
        heap = [(-(d - g * size), i) for i, (d, g) in enumerate(zip(short, got))]
        heapq.heapify(heap)
        for _ in range(left):
            d, i = heapq.heappop(heap)
            got[i] += 1
            heapq.heappush(heap, (d + size, i))
        short = [d - g * size for d, g in zip(short, got)]
        out.append((size, got))
    return out


def assign_splits(items: DataFrame, targets: list[tuple[str, float]]) -> DataFrame:
    """A split for every item of (item, group, items), whole groups at a time: (item, group, split_name).

    The driver sees the histogram of group sizes only: sizes that differ are at most the square root of twice the
    number of items. Groups of one size are ranked by hash bucket, so that no task orders them all, and a rank's place
    among the counts of `greedy_counts` gives the split. Shares are scaled to sum 1; a share that is null or not
    positive gets nothing; without any positive share no item is assigned.
    """
    targets = [(n, float(s)) for n, s in targets if n is not None and s is not None and s > 0]
    if not targets:
        return items.select("item", "group", F.lit("").alias("split_name")).where("false")
    whole = sum(s for _, s in targets)
    spark = items.sparkSession
    groups = cut(items.where("item = group").select("group", "items"))
    sizes = [(r["items"], r["count"]) for r in groups.groupBy("items").count().collect()]
    buckets = max(1, sum(c for _, c in sizes) // RANK_BUCKET)
    plan = []
    for size, got in greedy_counts(sizes, [s / whole for _, s in targets]):
        upto = 0
        ends = [upto := upto + g for g in got]
        plan.append((size, ends))
    size = len(plan) * (ROW_OVERHEAD + 8 * len(targets))
    plan = spark.createDataFrame(plan, "items bigint, ends array<bigint>")
    bucketed = groups.withColumn("bucket", F.pmod(F.xxhash64("group"), F.lit(buckets)))
    offsets = (
        bucketed.groupBy("items", "bucket").count()
        .withColumn("offset", F.coalesce(F.sum("count").over(Window.partitionBy("items").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .drop("count")
    )
    rank = F.col("offset") + F.row_number().over(Window.partitionBy("items", "bucket").orderBy("group"))
    names = F.lit([n for n, _ in targets])
    chosen = (
        bucketed.join(offsets, ["items", "bucket"])
        .withColumn("rank", rank)
        .join(F.broadcast(plan) if size <= BROADCAST_BYTES else plan, "items")
        .select("group", F.element_at(names, F.size(F.filter("ends", lambda e: e < F.col("rank"))) + 1).alias("split_name"))
    )
    return join_counted(items.select("item", "group"), cut(chosen), ["group"], "inner").select("item", "group", "split_name")
