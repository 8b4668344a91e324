"""Mixing sources to target shares of the total size."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filmloom.scratch import BROADCAST_BYTES, ROW_OVERHEAD, cut

#: Records of one pattern ordered by one task, about.
BUCKET_RECORDS = 100_000


class Flow:
    """Cheapest flow in a small network with whole capacities and costs of at least 0."""

    def __init__(self, nodes: int):
        self.edges: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []
        self.cost: list[int] = []

    def add(self, a: int, b: int, capacity: int, cost: int = 0) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.edges[x].append(len(self.to))
            self.to.append(y)
            self.left.append(c)
            self.cost.append(w)
        return len(self.to) - 2

    def run(self, source: int, sink: int) -> int:
        """Sends as much as goes, always along cheapest paths, all of one cost at a time; returns the amount."""
        total = 0
        while (far := self._distances(source))[sink] is not None:
            total += self._send(far, source, sink)
        return total

    def _distances(self, source: int) -> list[int | None]:
        far: list[int | None] = [None] * len(self.edges)
        far[source], queue, waiting = 0, deque([source]), {source}
        while queue:
            at = queue.popleft()
            waiting.discard(at)
            for e in self.edges[at]:
                if self.left[e] and (far[self.to[e]] is None or far[at] + self.cost[e] < far[self.to[e]]):
                    far[self.to[e]] = far[at] + self.cost[e]
                    if self.to[e] not in waiting:
                        waiting.add(self.to[e])
                        queue.append(self.to[e])
        return far

    def _send(self, far: list[int | None], source: int, sink: int) -> int:
        """A flow along edges on cheapest paths that depth-first search can't enlarge."""
        total, tried = 0, [0] * len(self.edges)
        path: list[int] = []
        visited, at = {source}, source
        while True:
            if at == sink:
                amount = min(self.left[e] for e in path)
                for e in path:
                    self.left[e] -= amount
                    self.left[e ^ 1] += amount
                total += amount
                path, visited, at = [], {source}, source
                continue
            while tried[at] < len(self.edges[at]):
                e = self.edges[at][tried[at]]
                to = self.to[e]
                if self.left[e] and to not in visited and far[to] == far[at] + self.cost[e]:
                    break
                tried[at] += 1
            if tried[at] < len(self.edges[at]):
                path.append(e)
                visited.add(to)
                at = to
            elif at == source:
                return total
            else:
                visited.discard(at)
                at = self.to[path.pop() ^ 1]
                tried[at] += 1


@dataclass(frozen=True)
class Target:
    source: str
    share: float
    repeats: int


def route(patterns: list[tuple[tuple[int, ...], int]], targets: list[Target], total: int | None = None) -> tuple[int, list[tuple[int, int, int]]]:
    """Tokens that each pattern gives to each of its sources: (total, [(pattern, source, tokens)]).

    patterns: (numbers of the sources that hold its records, tokens). The k-th use of a pattern's tokens costs k - 1, so
    the cheapest flow repeats as little as it can; a source takes a record at most its `repeats` times. Without `total`
    it is the largest for which every source with records reaches its share; sources without any drop out and the
    others' shares are scaled to sum 1.
    """
    live = sorted({s for sources, tokens in patterns if tokens for s in sources if targets[s].share > 0 and targets[s].repeats > 0})
    whole = sum(targets[s].share for s in live)
    if not live:
        return 0, []

    def network(quota: dict[int, int], priced: bool) -> tuple[Flow, list[tuple[int, int, int]], int]:
        """The flow, its edges from patterns to sources, and its amount; unpriced, each edge costs one step."""
        flow, step = Flow(2 + len(patterns) + len(targets)), 1 - priced
        marks = []
        for p, (sources, tokens) in enumerate(patterns):
            sources = [s for s in sources if s in quota]
            uses = max((targets[s].repeats for s in sources), default=0)
            for k in range(uses if priced else min(uses, 1)):
                flow.add(0, 2 + p, tokens if priced else tokens * uses, k if priced else step)
            marks += [(p, s, flow.add(2 + p, 2 + len(patterns) + s, tokens * targets[s].repeats, step)) for s in sources]
        for s, tokens in quota.items():
            flow.add(2 + len(patterns) + s, 1, tokens, step)
        return flow, marks, flow.run(0, 1)

    def quotas(size: int) -> dict[int, int]:
        return {s: int(size * targets[s].share / whole) for s in live}

    if total is None:
        low, high = 0, int(min(sum(t for sources, t in patterns if s in sources) * targets[s].repeats * whole / targets[s].share for s in live)) + len(live)
        while low < high:  # more is never easier
            middle = (low + high + 1) // 2
            wanted = quotas(middle)
            low, high = (middle, high) if network(wanted, False)[2] == sum(wanted.values()) else (low, middle - 1)
        total = low
    flow, marks, _ = network(quotas(total), True)
    return total, [(p, s, flow.left[e ^ 1]) for p, s, e in marks if flow.left[e ^ 1]]


def mix(records: DataFrame, targets: list[Target], seed: int = 0, total: int | None = None) -> DataFrame:
    """Records (doc_id, source, record, tokens) chosen to the targets: (source, doc_id, tokens, uses).

    Rows of equal `record` are one record that all their sources hold; its smallest doc_id of a source stands for it
    there. Records are summed by the set of sources that hold them, and a cheapest flow routes the sums to the sources.
    Within a pattern the records lie on a circle in seeded hash order, each as long as its tokens; what the flow gives
    to the sources is laid end to end around it, and a record is used as often as its start is covered. So every source
    gets its tokens but for a part of one record, none takes a record more often than it may, and no pattern is ever
    ordered by one task: positions are sums over hash buckets and within them.

    Rows with a null doc_id, source or record, without tokens, or of a source without target are not used. Repeated rows
    are one. Only the targets and the sums by pattern reach the driver: at most 2 ** n - 1 rows for n targets.
    """
    number = records.sparkSession.createDataFrame([(t.source, i) for i, t in enumerate(targets)], "source string, s int")
    held = (
        records.where("doc_id is not null and source is not null and record is not null and tokens > 0")
        .join(F.broadcast(number), "source")  # the targets given
        .groupBy("record", "s")
        .agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens"))
        .groupBy("record")
        .agg(F.array_sort(F.collect_list(F.struct("s", "doc_id"))).alias("held"), F.max("tokens").alias("tokens"))  # at most one per source
        .withColumn("pattern", F.concat_ws(",", F.transform("held", lambda h: h["s"].cast("string"))))
    )
    held = cut(held)
    sums = held.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("records")).collect()
    sums.sort(key=lambda r: r["pattern"])
    _, routes = route([(tuple(map(int, r["pattern"].split(","))), r["tokens"]) for r in sums], targets, total)
    arcs: dict[int, list[tuple[int, int, int]]] = {}
    for p, s, tokens in routes:
        laid = arcs.setdefault(p, [])
        start = laid[-1][2] if laid else 0
        laid.append((s, start, start + tokens))
    plan = records.sparkSession.createDataFrame(
        [(sums[p]["pattern"], sums[p]["tokens"], spans) for p, spans in arcs.items()], "pattern string, whole bigint, spans array<struct<s: int, a: bigint, b: bigint>>"
    )
    size = sum(ROW_OVERHEAD + len(sums[p]["pattern"]) + 40 * len(spans) for p, spans in arcs.items())
    buckets = max(1, sum(r["records"] for r in sums) // BUCKET_RECORDS)
    placed = held.join(F.broadcast(plan) if size <= BROADCAST_BYTES else plan, "pattern").withColumn("h", F.xxhash64(F.lit(seed), "record"))
    placed = placed.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("sum")).select("pattern", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("pattern", "bucket").orderBy("h", "record").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(offsets, ["pattern", "bucket"]).withColumn("at", F.col("offset") + F.coalesce(F.sum("tokens").over(within), F.lit(0)))

    def turns(end: str) -> Column:
        """Times that the record's start lies before `end` on the unrolled circle, in whole numbers."""
        return F.expr(f"({end} - at + whole - 1) div whole")

    uses = turns("span.b") - turns("span.a")
    mine = F.filter("held", lambda h: h["s"] == F.col("span.s"))[0]["doc_id"]
    names = F.lit([t.source for t in targets])
    return (
        placed.select("held", "tokens", "at", "whole", F.explode("spans").alias("span"))
        .select(F.element_at(names, F.col("span.s") + 1).alias("source"), mine.alias("doc_id"), "tokens", uses.alias("uses"))
        .where("uses > 0")
    )


def mix_report(chosen: DataFrame, targets: list[Target]) -> DataFrame:
    """Tokens, uses and records of each target source, with its actual share beside the target."""
    asked = chosen.sparkSession.createDataFrame([(t.source, t.share, t.repeats) for t in targets], "source string, target_share double, max_repeats bigint")
    sums = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("records"), F.max("uses").alias("most_uses"))
    joined = asked.join(sums, "source", "left").na.fill(0)
    whole = Window.partitionBy()  # one row per target
    return joined.select("*", (F.col("tokens") / F.greatest(F.lit(1), F.sum("tokens").over(whole))).alias("actual_share"))
