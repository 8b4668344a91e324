"""Connected components: local union-find forests, merged level by level."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filmloom.scratch import cut, drop_cut, join_counted

#: Edges that one task merges at once; a level of no more is finished by one task.
EDGES_PER_TASK = 2_000_000


def forest(a: pa.Array, b: pa.Array, a_hash: np.ndarray, b_hash: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), the place of each one's root among them, and their hashes.

    A component's root is its node of least hash. Vectorised union-find on Arrow's own node codes: the larger root of
    each edge is hooked to the smaller, then paths are halved, until no edge joins two roots.
    """
    both = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
    codes = both.indices.to_numpy(zero_copy_only=False)
    n = len(both.dictionary)
    hashes = np.empty(n, np.int64)
    hashes[codes] = np.concatenate([a_hash, b_hash])
    order = np.argsort(hashes, kind="stable")
    rank_of = np.empty(n, np.int64)
    rank_of[order] = np.arange(n)
    u, v = rank_of[codes[: len(a)]], rank_of[codes[len(a) :]]
    root = np.arange(n)
    while len(u):
        low, high = np.minimum(root[u], root[v]), np.maximum(root[u], root[v])
        open_ = low != high
        u, v, low, high = u[open_], v[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while not np.array_equal(step := root[root], root):
            root = step
    return both.dictionary, order[root[rank_of]], hashes


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a task's edges (a, b, a_hash, b_hash) as (node, root)."""
    held: list[pa.RecordBatch | pa.Table] = []
    rows, limit = 0, EDGES_PER_TASK

    def merged() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        columns = [pa.chunked_array([c for t in held for c in (t.column(i).chunks if isinstance(t, pa.Table) else [t.column(i)])]).combine_chunks() for i in range(4)]
        return forest(columns[0], columns[1], columns[2].to_numpy(), columns[3].to_numpy())

    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows > limit:  # keep the forest only: memory follows the nodes, not the edges
            nodes, place, hashes = merged()
            held, rows = [pa.table([nodes, nodes.take(pa.array(place)), pa.array(hashes), pa.array(hashes[place])], ["a", "b", "a_hash", "b_hash"])], len(nodes)
            limit = max(EDGES_PER_TASK, 2 * rows)
    if rows:
        nodes, place, _ = merged()
        for at in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([nodes.slice(at, 100_000), nodes.take(pa.array(place[at : at + 100_000]))], ["node", "root"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the string edges (a, b); nodes are connected exactly if their roots are equal.

    Each task reduces its edges to a forest by union-find. A node meets the roots that tasks gave it, at most one per
    task; it keeps the least, and the others, linked to it, are the edges of the next level, a graph of roots only.
    Levels shrink, their tasks with them, and one of at most EDGES_PER_TASK edges is finished by one task. Labels then
    come down again by one join a level. Roots are least by a hash that changes with the level, so chains shrink as
    well as stars. A node of any number of edges is one row per task after the first step; links of one hot root are
    spread by the rebalancing that Spark does at run time. Each level is cut into the shared folder.

    Edges with a null end join nothing and are ignored; loops make their node known; repeated edges change nothing.
    """
    edges = edges.select(F.col("a").cast("string"), F.col("b").cast("string")).where("a is not null and b is not null")
    levels, links = [], []
    while True:
        hashed = edges.select("a", "b", F.xxhash64(F.lit(len(levels)), "a").alias("a_hash"), F.xxhash64(F.lit(len(levels)), "b").alias("b_hash"))
        met = (
            hashed.mapInArrow(_local_forest, "node string, root string")
            .groupBy("node")
            .agg(F.collect_set("root").alias("roots"))  # at most one per task
            .select("node", F.array_min("roots").alias("root"), "roots")
        )
        met = cut(met)
        drop_cut(*links)
        levels.append(met.select("node", "root"))
        links = [cut(met.where("size(roots) > 1").select(F.explode("roots").alias("a"), F.col("root").alias("b")).where("a <> b").distinct())]
        rest = links[0].count()
        if rest == 0:
            break
        edges = links[0].coalesce(1) if rest <= EDGES_PER_TASK else links[0].hint("rebalance", "b")
    labels = levels.pop()
    while levels:
        lower = levels.pop()
        upper = labels.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = join_counted(lower, upper, ["root"], "left").select("node", F.coalesce("top", "root").alias("root"))
        if levels:
            labels = cut(labels)
    return labels
