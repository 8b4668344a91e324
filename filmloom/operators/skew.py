"""Per-key work without stragglers: fragment-replicate by estimated load."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filmloom.scratch import cut

#: Hash buckets that light keys are packed by, per task, and their largest number.
BUCKETS_PER_TASK, MAX_BUCKETS = 32, 4096
#: Keys kept by the load sketch of one bucket.
TRACKED = 64


@dataclass
class LoadPlan:
    """Where rows go: light keys by bucket, each shard of a heavy key by itself."""

    tasks: int
    rows: int  # all rows of the input, with or without a key
    bucket_task: list[int]
    heavy: dict[tuple[int, str], list[int]] = field(default_factory=dict)  # (kind, key): task of each shard
    hot_pairs: list[int] = field(default_factory=list)  # hashes of (kind, key, partner) that outweigh a shard


def pack(loads: list[tuple[float, object]], tasks: int) -> dict[object, int]:
    """Largest load first, each to the task with the least so far."""
    heap = [(0.0, t) for t in range(tasks)]
    placed = {}
    for load, unit in sorted(loads, key=lambda x: (-x[0], str(x[1]))):
        have, task = heapq.heappop(heap)
        placed[unit] = task
        heapq.heappush(heap, (have + load, task))
    return placed


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64("kind", key), F.lit(buckets)).cast("int")


def _pair() -> Column:
    return F.xxhash64("kind", "key", "partner")


def plan_loads(keyed: DataFrame, rows: int | None = None, tasks: int | None = None) -> LoadPlan:
    """A plan for rows (kind int, key string), with their partner if they have one, by one aggregation over all of them.

    Per bucket it gathers the exact number of rows and sketches of the keys, and of the pairs of key and partner, that
    weigh most; all are of fixed size. A key of more than half a task's mean load is cut into shards of that size. What
    the plan estimates only steers where rows go; results never depend on it. Its size is bounded by buckets and tasks,
    not by data. Without `rows` these are counted as well: the rows of kind 0, with or without a key.
    """
    tasks = tasks or int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(MAX_BUCKETS, BUCKETS_PER_TASK * tasks)
    sketch = lambda item: F.call_function("approx_top_k", item, F.lit(8), F.lit(TRACKED))
    item = F.when(F.col("key").isNotNull(), F.concat_ws("\x00", F.col("kind").cast("string"), "key"))
    with_partner = "partner" in keyed.columns
    pair = F.when(F.col("key").isNotNull() & F.col("partner").isNotNull(), _pair()) if with_partner else None
    sums = [F.count("key").alias("n"), F.count_if(F.col("kind") == 0).alias("rows"), sketch(item).alias("top"), *([sketch(pair).alias("pairs")] if with_partner else [])]
    seen = keyed.groupBy(_bucket(F.col("key"), buckets).alias("b")).agg(*sums).collect()
    load = {r["b"]: r["n"] for r in seen}
    share = max(1.0, sum(load.values()) / tasks / 2)
    units: list[tuple[float, object]] = []
    shards: dict[tuple[int, str], int] = {}
    for r in seen:
        for top in r["top"] or ():
            if top["item"] is not None and top["count"] > share:
                kind, key = top["item"].split("\x00", 1)
                shards[int(kind), key] = n = -(-int(top["count"]) // int(share))
                load[r["b"]] = max(0, load[r["b"]] - top["count"])
                units += [(top["count"] / n, (int(kind), key, i)) for i in range(n)]
    hot = sorted(p["item"] for r in seen for p in (r["pairs"] if with_partner else None) or () if p["item"] is not None and p["count"] > share)
    placed = pack(units + [(n, b) for b, n in load.items()], tasks)
    tasks_of = {(kind, key): [placed[kind, key, i] for i in range(n)] for (kind, key), n in shards.items()}
    return LoadPlan(tasks, sum(r["rows"] for r in seen) if rows is None else rows, [placed.get(b, b % tasks) for b in range(buckets)], tasks_of, hot)


def assign(df: DataFrame, plan: LoadPlan, shard_by: Column | None) -> DataFrame:
    """`df` (kind, key, ...) with `task` and `heavy`; without `shard_by` a row of a heavy key goes to all its tasks.

    Rows without a key are spread over all tasks by `shard_by`. The heavy keys are at most two per task, so they are
    broadcast.
    """
    spark = df.sparkSession
    heavy = spark.createDataFrame([(k, key, t) for (k, key), t in plan.heavy.items()], "kind int, key string, tasks array<int>")
    light = F.element_at(F.lit(plan.bucket_task), _bucket(F.col("key"), len(plan.bucket_task)) + 1)
    df = df.join(F.broadcast(heavy), ["kind", "key"], "left").withColumn("heavy", F.col("tasks").isNotNull())
    if shard_by is None:
        return df.withColumn("task", F.explode(F.when(F.col("heavy"), F.array_distinct("tasks")).otherwise(F.array(light)))).drop("tasks")
    df = df.withColumn("shard_by", shard_by)
    shard = F.pmod("shard_by", F.size("tasks")).cast("int")
    spread = F.pmod("shard_by", F.lit(plan.tasks)).cast("int")
    return df.withColumn("task", F.when(F.col("heavy"), F.get("tasks", shard)).when(F.col("key").isNull(), spread).otherwise(light)).drop("tasks", "shard_by")


def send(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """Each row to the partition that its `task` names."""
    return df.repartitionById(plan.tasks, F.col("task"))


def per_key_counts(keyed: DataFrame, plan: LoadPlan) -> DataFrame:
    """Rows, distinct partners and distinct categories per key of (kind, key, partner, category).

    Rows are read once and go to the tasks of the plan. A heavy key's shards are cut by partner, so a partner is in one
    shard and the shards' partner counts add up; the rows of a hot pair of key and partner, which would outweigh its
    shard, are spread over all of them and the pair is told by itself. Within a task repeated (partner, category) rows
    merge first, and light keys are finished where they are. That table is written; only the few rows per category and
    hot partner of each heavy shard are shuffled again.

    Rows without a key count for nobody; a null partner or category is none, but its row counts. Result: kind, key,
    n_rows, n_partners, n_categories.
    """
    own = ["task", "kind", "key", "heavy"]
    hot = _pair().isin(plan.hot_pairs) if plan.hot_pairs else F.lit(False)
    marked = keyed.where("key is not null").select("kind", "key", "partner", "category", (F.col("partner").isNotNull() & hot).alias("hot"), F.spark_partition_id().alias("origin"))
    sent = send(assign(marked, plan, F.when(F.col("hot"), F.xxhash64("origin")).otherwise(F.xxhash64("partner"))).drop("origin"), plan)
    merged = sent.groupBy(*own, "hot", "partner", "category").agg(F.count(F.lit(1)).alias("n"))
    none, zero = F.lit(None).cast("string"), F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("partner").alias("partner"), none.alias("category"), F.col("n").alias("n"), F.col("hot").alias("hot")),
        F.struct(none.alias("partner"), F.col("category").alias("category"), zero.alias("n"), F.lit(False).alias("hot")),
    )
    single = merged.select(*own, F.explode(sides).alias("s")).select(*own, "s.*").groupBy(*own, "partner", "category", "hot").agg(F.sum("n").alias("n"))
    heavy_only = lambda c, name: F.when(F.col("heavy"), c).alias(name)
    done = single.groupBy(*own, heavy_only(F.col("category"), "shard_category"), heavy_only(F.when(F.col("hot"), F.col("partner")), "hot_partner")).agg(
        F.sum("n").alias("n"), F.count(F.when(~F.col("hot") | ~F.col("heavy"), F.col("partner"))).alias("partners"), F.count("category").alias("categories")
    )
    if not plan.heavy:
        return done.select("kind", "key", F.col("n").alias("n_rows"), F.col("partners").alias("n_partners"), F.col("categories").alias("n_categories"))
    done = cut(done.drop("task"))
    light = done.where("not heavy").select("kind", "key", F.col("n").alias("n_rows"), F.col("partners").alias("n_partners"), F.col("categories").alias("n_categories"))
    shards = done.where("heavy").groupBy("kind", "key", "shard_category", "hot_partner").agg(F.sum("n").alias("n"), F.sum("partners").alias("partners"))
    counts = [F.sum("n").alias("n_rows"), (F.sum("partners") + F.count("hot_partner")).alias("n_partners"), F.count("shard_category").alias("n_categories")]
    return light.unionByName(shards.groupBy("kind", "key").agg(*counts))


def fragment_replicate_join(rows: DataFrame, lookup: DataFrame, plan: LoadPlan, shard_by: Column) -> DataFrame:
    """Left join of `rows` (kind, key, ...) with `lookup` (kind, key, ...) in the tasks of the plan.

    A heavy key's rows are spread over its shards and only its lookup rows are replicated, to those tasks alone; all
    other lookup rows move once. Rows without a key, or without a partner in `lookup`, keep nulls; the former are spread
    over all tasks. A key that `lookup` has several times multiplies its rows. The columns besides kind and key must
    differ in name. Rows that are equal in `shard_by` are spread by where they were read.
    """
    spread = rows.withColumn("origin", F.spark_partition_id())
    left = send(assign(spread, plan, F.xxhash64(shard_by, F.col("origin"))).drop("heavy", "origin"), plan)
    right = send(assign(lookup.where("key is not null"), plan, None).drop("heavy"), plan)
    return left.hint("merge").join(right, ["task", "kind", "key"], "left").drop("task")
