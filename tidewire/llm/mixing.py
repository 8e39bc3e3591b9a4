"""Mixing sources to target weights (problem 9): min-cost flow over membership patterns.

Equal texts are one document that may belong to several sources. Documents are aggregated by membership pattern (the set of
mixed sources that hold them), of which there are few however many documents; the flow network routes each pattern's tokens to
source quotas, with a cost that grows with every repetition. The total is the largest for which all quotas can be met under
the caps, unless it is given. Documents then take their uses from the pattern's flows in an order seeded by a hash; positions on
the line of cumulated tokens come from sums by hash bucket, so no pattern is ordered as a whole.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

BUCKETS = 1024
#: Membership patterns go to the driver, where the flow is routed; more than this, which takes 17 sources mixed in every way, is refused.
MOST_PATTERNS = 100_000


class Network:
    """Successive shortest paths on a small graph with integer capacities and costs."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def edge(self, a: int, b: int, room: int, cost: int = 0) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            dist, via, queued = {s: 0}, {}, {s}
            queue = deque([s])
            while queue:
                x = queue.popleft()
                queued.discard(x)
                for e in self.out[x]:
                    y = self.to[e]
                    if self.room[e] > 0 and dist[x] + self.cost[e] < dist.get(y, 1 << 60):
                        dist[y], via[y] = dist[x] + self.cost[e], e
                        if y not in queued:
                            queued.add(y)
                            queue.append(y)
            if t not in dist:
                return total
            path, y = [], t
            while y != s:
                path.append(via[y])
                y = self.to[via[y] ^ 1]
            k = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= k
                self.room[e ^ 1] += k
            total += k


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> tuple[int, dict[tuple[tuple[str, ...], str], int]]:
    """(total, tokens by pattern and source). targets: share and most repetitions by source. Without a total, the largest feasible one."""
    sources = sorted(targets)

    def flow(size: int) -> tuple[bool, dict]:
        quotas = {s: int(targets[s][0] * size) for s in sources}
        names = sorted(patterns)
        net = Network(2 + len(names) + len(sources))
        pairs = {}
        for i, p in enumerate(names):
            for level in range(max(targets[s][1] for s in p)):
                # convex: each further use of a document costs more than the one before
                net.edge(0, 2 + i, patterns[p], level * level)
            for s in p:
                pairs[p, s] = net.edge(2 + i, 2 + len(names) + sources.index(s), patterns[p] * targets[s][1])
        for j, s in enumerate(sources):
            net.edge(2 + len(names) + j, 1, quotas[s])
        met = net.run(0, 1)
        return met == sum(quotas.values()), {k: net.room[e ^ 1] for k, e in pairs.items() if net.room[e ^ 1]}

    if total is None:
        low, high = 0, sum(n * max(targets[s][1] for s in p) for p, n in patterns.items()) + 1
        while high - low > max(1, high // 1_000_000):
            middle = (low + high) // 2
            low, high = (middle, high) if flow(middle)[0] else (low, middle)
        total = low
    return total, flow(total)[1]


def mixture(sized: DataFrame, targets: dict[str, tuple[float, int]], total: int | None = None, seed: int = 0) -> DataFrame:
    """(doc_id, source, tokens, uses) of the selected documents; sized: (doc_id, source, text_hash, tokens).

    Of equal texts the smallest doc_id of a source stands for it there. Rows with null ids, sources outside the targets, or no tokens are
    never selected; a document is used at most its source's cap. The shares are of all tokens selected, repetitions counted.
    """
    if not targets:
        raise ValueError("no target is given")
    known = sized.where(F.col("doc_id").isNotNull() & F.col("source").isin(*targets) & (F.col("tokens") > 0))
    # kept, as both the patterns and the selection are made from it, and its tokens are costly
    members = cut_lineage(known.groupBy("text_hash", "source").agg(F.min("doc_id").alias("doc_id"), F.max("tokens").alias("tokens")))
    # a text has at most as many members as there are target sources
    texts = members.groupBy("text_hash").agg(F.array_join(F.array_sort(F.collect_set("source")), "\x1f").alias("pattern"), F.max("tokens").alias("tokens"))
    key = F.xxhash64(F.lit(seed), "text_hash")
    texts = cut_lineage(texts.withColumn("__order", key).withColumn("__bucket", F.shiftrightunsigned("__order", 64 - (BUCKETS.bit_length() - 1)).cast("int")))
    found = texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} sets of sources share texts; mix fewer sources at once")
    sums = {tuple(r["pattern"].split("\x1f")): r["n"] for r in found}
    _, flows = route(sums, targets, total)
    before = Window.partitionBy("pattern").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = texts.groupBy("pattern", "__bucket").agg(F.sum("tokens").alias("__t")).withColumn("__base", F.coalesce(F.sum("__t").over(before), F.lit(0))).drop("__t")
    inside = Window.partitionBy("pattern", "__bucket").orderBy("__order", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    line = texts.join(starts, ["pattern", "__bucket"]).withColumn("at", F.col("__base") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    # the sources of a pattern take consecutive stretches of its line of tokens, which is run through again for every repetition
    spans, reached = [], {}
    for (p, s), n in sorted(flows.items()):
        a = reached.get(p, 0)
        spans.append(("\x1f".join(p), s, a, a + n, sums[p]))
        reached[p] = a + n
    spark = sized.sparkSession
    plan = spark.createDataFrame(spans, "pattern string, source string, a bigint, b bigint, size bigint")  # one row per pattern and source
    chosen = line.join(F.broadcast(plan), "pattern")
    # a document is taken as often as its middle, mid + k * size, falls into [a, b); both ceilings are at least 0
    chosen = chosen.withColumn("mid", F.expr("at + tokens div 2"))
    uses = F.expr("cast(greatest(ceil((b - mid) / size), 0) - greatest(ceil((a - mid) / size), 0) as int)")
    chosen = chosen.withColumn("uses", uses).where("uses > 0").select("text_hash", "source", "uses")
    return members.join(chosen, ["text_hash", "source"]).select("doc_id", "source", "tokens", "uses")


def reached_shares(selection: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, tokens, documents, share of all selected tokens (rounded to six places), most uses of one document."""
    by = selection.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.max("uses").alias("most_uses"))
    rows = targets.select("source", "target_share", "max_repeats").join(by, "source", "left").na.fill(0, ["tokens", "documents", "most_uses"])
    total = selection.agg(F.sum(F.col("tokens") * F.col("uses")).alias("__all"))
    return rows.crossJoin(F.broadcast(total)).select(
        "source",
        "target_share",
        "max_repeats",
        "tokens",
        "documents",
        "most_uses",
        F.round(F.col("tokens") / F.col("__all"), 6).alias("share")
    )
