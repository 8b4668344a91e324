"""How often pairs of items occur in the same basket, and how much more often than by chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.scratch import cut, drop_cut, join_counted

#: Items of a basket from which it is split into chunks.
ORDINARY = 64
#: Items of one basket in one chunk, at most about, and rows of one chunk pair over all its baskets.
CHUNK_ITEMS, TASK_ROWS = 1024, 32_768
#: Pair codes merged at once.
MERGE_PAIRS = 4_000_000


def _merge(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kept, place = np.unique(codes, return_inverse=True)
    return kept, np.bincount(place, counts, len(kept)).astype(np.int64)


def chunk_product(item: np.ndarray, basket: np.ndarray, chunk: np.ndarray, left: int, right: int, items: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes a * items + b (a < b) of the item pairs that meet between two chunks, with their numbers of baskets."""
    order = np.lexsort((item, chunk != left, basket))
    item, basket, chunk = item[order], basket[order], chunk[order]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(basket)) + 1, [len(basket)]]) if len(basket) else np.zeros(1, int)
    done, counts, waiting, size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for low, high in zip(bounds[:-1], bounds[1:]):
        if left == right:
            own = item[low:high]
            i, j = np.triu_indices(len(own), 1)
            a, b = own[i], own[j]
        else:
            middle = low + int((chunk[low:high] == left).sum())
            a, b = (x.ravel() for x in np.meshgrid(item[low:middle], item[middle:high], indexing="ij"))
        waiting.append(np.minimum(a, b) * items + np.maximum(a, b))
        size += len(a)
        if size > MERGE_PAIRS or high == len(basket):
            codes = np.concatenate([done, *waiting])
            done, counts = _merge(codes, np.concatenate([counts, np.ones(size, np.int64)]))
            waiting, size = [], 0
    return done, counts


def _products(total: int, least: int, lift: float):
    schema = pa.schema([("a", pa.string()), ("b", pa.string()), ("na", pa.int64()), ("nb", pa.int64()), ("n", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        left, right = key[2].as_py(), key[3].as_py()
        names = table.column("item").combine_chunks().dictionary_encode()
        order = np.argsort(names.dictionary.to_numpy(zero_copy_only=False), kind="stable")
        code_of = np.empty(len(order), np.int64)
        code_of[order] = np.arange(len(order))
        item = code_of[names.indices.to_numpy(zero_copy_only=False)]
        basket = table.column("basket").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        holders = np.zeros(len(order), np.int64)
        holders[item] = table.column("holders").to_numpy()
        codes, n = chunk_product(item, basket, table.column("chunk").to_numpy(), left, right, len(order))
        a, b = codes // max(1, len(order)), codes % max(1, len(order))
        here = np.bincount(item, minlength=len(order))
        most = n + np.minimum(holders[a] - here[a], holders[b] - here[b])  # with every basket outside this task
        keep = (most >= least) & (most * float(total) >= lift * holders[a] * holders[b] * (1 - 1e-9))
        sorted_names = names.dictionary.take(pa.array(order))
        a, b, n = a[keep], b[keep], n[keep]
        return pa.Table.from_arrays([sorted_names.take(pa.array(a)), sorted_names.take(pa.array(b)), pa.array(holders[a]), pa.array(holders[b]), pa.array(n)], schema=schema)

    return run


def spread_chunks(rows: DataFrame, huge: DataFrame, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """The rows (basket, item, holders) of huge baskets (basket, size), once for each chunk pair that they take part in.

    A basket has as many chunks, a power of two, as its own size asks for: a row is copied once per chunk of its basket,
    whatever the sizes of others. Result: chunks, part, left, right, basket, item, holders, chunk; baskets with the same
    number of chunks share their chunk pairs, in parts of about TASK_ROWS rows.
    """
    chunks = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("size") / chunk_items)))).cast("int")
    sized = cut(huge.select("basket", "size", chunks.alias("chunks")))
    levels = sized.groupBy("chunks").agg(F.sum("size").alias("rows")).collect()  # one row per power of two
    parts = F.element_at(F.create_map(*(F.lit(x) for r in levels for x in (r["chunks"], max(1, -(-2 * r["rows"] // ((r["chunks"] + 1) * TASK_ROWS)))))), F.col("chunks"))
    return (
        join_counted(rows, sized, ["basket"], "inner")
        .withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("basket"), parts).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("chunks", "part", F.least("chunk", "other").alias("left"), F.greatest("chunk", "other").alias("right"), "basket", "item", "holders", "chunk")
    )


def pairs_together(baskets: DataFrame, least: int, lift: float, chunk_items: int = CHUNK_ITEMS) -> DataFrame:
    """Pairs (a, b, n_ab, n_a, n_b, n) of items of (basket, item), a < b, in at least `least` baskets and with n_ab * n
    of at least lift * n_a * n_b; n counts the baskets with an item, n_a and n_b those of each item.

    Repeated rows count once. Items in fewer than `least` baskets, or in more than n / lift, can be in no such pair and
    leave first; both bounds are exact. Ordinary baskets give their pairs in place. A basket of more than ORDINARY
    items is split by item hash into chunks of about `chunk_items`, and each pair of chunks is a task of its own that
    counts over its baskets (`spread_chunks`); it passes on a pair only if the pair could still reach both bounds were
    the two items together in every basket elsewhere. One aggregation adds both kinds up. No task holds a whole huge
    basket, and its size is bounded by TASK_ROWS.

    Rows with a null basket or item are ignored. `least` is at least 1; a `lift` of 0 asks for nothing.
    """
    least = max(1, least)
    held = cut(baskets.select(F.col("basket").cast("string"), F.col("item").cast("string")).where("basket is not null and item is not null").distinct())
    total = held.select("basket").distinct().count()
    enough = held.groupBy("item").agg(F.count(F.lit(1)).alias("holders")).where(F.col("holders") >= least)
    if lift > 0:
        enough = enough.where(F.col("holders") * F.lit(float(lift)) <= F.lit(float(total)))
    enough = cut(enough)
    rows = cut(join_counted(held, enough, ["item"], "inner"))
    drop_cut(held, enough)
    huge = cut(rows.groupBy("basket").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > ORDINARY))

    ordered = F.array_sort(F.collect_list(F.struct("item", "holders")))
    ordinary = join_counted(rows, huge, ["basket"], "left_anti").groupBy("basket").agg(ordered.alias("x"))  # at most ORDINARY each
    pairs = (
        ordinary.select(F.posexplode("x").alias("at", "a"), "x")
        .select("a", F.explode(F.slice("x", F.col("at") + 2, F.greatest(F.lit(0), F.size("x") - F.col("at") - 1))).alias("b"))
        .groupBy(F.col("a.item").alias("a"), F.col("b.item").alias("b"), F.col("a.holders").alias("na"), F.col("b.holders").alias("nb"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    if not huge.isEmpty():
        spread = spread_chunks(rows, huge, chunk_items)
        huge_pairs = spread.groupBy("chunks", "part", "left", "right").applyInArrow(_products(total, least, lift), "a string, b string, na bigint, nb bigint, n bigint")
        pairs = pairs.unionByName(huge_pairs)
    summed = pairs.groupBy("a", "b").agg(F.sum("n").alias("n_ab"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))
    asked = (F.col("n_ab") >= least) & (F.col("n_ab").cast("decimal(38,0)") * total >= F.lit(lift).cast("decimal(18,6)") * F.col("n_a") * F.col("n_b"))
    return summed.withColumn("n", F.lit(total).cast("bigint")).where(asked)
