"""Filling fixed-capacity containers with items (problem 8): variable-capacity best fit.

Only the histogram of item sizes, as long as the largest capacity at most, goes to the driver. There best-fit decreasing runs on
counts: all items of one size move at once into the open containers with the least sufficient space. Where none has room, the
permitted capacity of least cost is opened: the one that the items still to be placed would leave the smallest share of unused. Every
container is finally downsized to the smallest capacity that holds its contents; plans that always open one size are tried too, and
the plan of least total capacity wins. The items then find their containers by their rank among items of the
same size, which is computed in shards, so a size that a third of all items share is no hot group.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 64


@dataclass
class Plan:
    """Moves: items of `size` ranked from `first` on go to containers from `container` on. Containers: ranges with their capacity."""

    sizes: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    container: list[int] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    capacities: list[int] = field(default_factory=list)
    total: int = 0
    used: int = 0


def least_cost(sizes: list[int], counts: dict[int, int], size: int, rest: int, capacities: list[int]) -> int:
    """The capacity of which the smallest share stays unused if it takes an item of `size` and then, largest first, items still to be placed; of equal ones the largest.

    sizes: all sizes ascending; of `size` itself `rest` are left, larger ones are placed already.
    """
    best = None
    for capacity in capacities:
        if capacity < size:
            continue
        space, top = capacity - size, bisect.bisect_right(sizes, size)
        while space:
            top = bisect.bisect_right(sizes, space, 0, top)
            if not top:
                break
            top -= 1
            other = sizes[top]
            left = rest - 1 if other == size else counts[other]
            space -= other * min(left, space // other)
        cost = (space / capacity, -capacity)
        if best is None or cost < best:
            best = cost
    return -best[1]


def plan_counts(counts: dict[int, int], capacities: list[int], least: int | None = None) -> Plan:
    """Best fit decreasing on counts by size; new containers open with the capacity of least cost, or with the smallest that fits and is at least `least`."""
    plan, spaces = Plan(), []
    sizes = sorted(counts)
    groups: dict[int, list[tuple[int, int, int]]] = {}  # space left -> (first container, how many, capacity)
    following = 0

    def put(space: int, group: tuple[int, int, int]) -> None:
        if space not in groups:
            groups[space] = []
            bisect.insort(spaces, space)
        groups[space].append(group)

    for size in sorted(counts, reverse=True):
        rest, rank = counts[size], 0
        while rest:
            at = bisect.bisect_left(spaces, size)
            if at == len(spaces):
                if least is None:
                    capacity = least_cost(sizes, counts, size, rest, capacities)
                else:
                    capacity = next((c for c in capacities if c >= max(size, least)), capacities[-1])
                # so many new containers as take all the rest when each takes as many as fit
                n = -(-rest // max(1, capacity // size))
                put(capacity, (following, n, capacity))
                following += n
                at = bisect.bisect_left(spaces, capacity)
            space = spaces[at]
            first, n, capacity = groups[space].pop()
            if not groups[space]:
                del groups[space]
                spaces.pop(at)
            k = min(n, rest)
            plan.sizes.append(size)
            plan.first.append(rank)
            plan.container.append(first)
            if k < n:
                put(space, (first + k, n - k, capacity))
            put(space - size, (first, k, capacity))
            rank += k
            rest -= k
    final = sorted((first, n, capacity - space) for space, own in groups.items() for first, n, capacity in own if capacity > space)
    for first, n, used in final:
        smallest = next(c for c in capacities if c >= used)
        plan.starts.append(first)
        plan.capacities.append(smallest)
        plan.total += n * smallest
        plan.used += n * used
    return plan


def best_plan(counts: dict[int, int], capacities: list[int]) -> Plan:
    plans = [plan_counts(counts, capacities, least) for least in (None, 0, *capacities)]
    return min(plans, key=lambda p: p.total)


def ranked(items: DataFrame, group: list[str], order: list[str], out: str, shards: int = SHARDS) -> DataFrame:
    """Adds a rank from 0 among the rows of each group, in order of shard and `order`; no window holds a whole group."""
    shard = items.withColumn("__shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    sums = shard.groupBy(*group, "__shard").agg(F.count("*").alias("__n"))
    # one row per group and shard: the offsets need only these
    before = Window.partitionBy(*group).orderBy("__shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*group, "__shard").orderBy(*order)) - 1
    return shard.join(offsets, [*group, "__shard"]).withColumn(out, (F.col("__before") + inside).cast("bigint")).drop("__before", "__shard")


def pack(items: DataFrame, capacities: list[int], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """(id, piece_no, tokens, container_id, capacity_tokens): a container for each item, or for each piece of one longer than the largest capacity.

    Pieces of too long items are full but the last. Items without size (0 or null) need no room: container and capacity are null.
    Rows with a null id are left out. Ties of size are broken by a hash of the id, so results don't depend on partitioning.
    """
    capacities = sorted({int(c) for c in capacities if c and c > 0})
    if not capacities:
        raise ValueError("no capacity is given")
    top = capacities[-1]
    rows = items.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("__size"))
    none = rows.where(F.col("__size") <= 0).select(
        F.col(id_col),
        F.lit(0).alias("piece_no"),
        F.lit(0).cast("bigint").alias("tokens"),
        F.lit(None).cast("bigint").alias("container_id"),
        F.lit(None).cast("int").alias("capacity_tokens")
    )
    pieces = rows.where(F.col("__size") > 0).select(
        F.col(id_col),
        F.posexplode(F.expr(f"transform(sequence(0, cast((__size - 1) div {top} as int)), k -> least({top}, __size - k * {top}))")).alias("piece_no", "tokens")
    )
    # at most one row per size up to the largest capacity
    counts = {r["tokens"]: r["n"] for r in pieces.groupBy("tokens").agg(F.count("*").alias("n")).collect()}
    plan = best_plan(counts, capacities)
    width = 40
    keys = np.array(plan.sizes, np.int64) * (1 << width) + np.array(plan.first, np.int64)
    order = np.argsort(keys, kind="stable")
    table = (keys[order], np.array(plan.container, np.int64)[order], np.array(plan.starts, np.int64), np.array(plan.capacities, np.int32))
    shared = items.sparkSession.sparkContext.broadcast(table)  # moves of the plan: bounded by sizes and capacities, not by items
    kind = items.schema[id_col].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, containers, starts, capacity = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            size, rank = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            move = np.searchsorted(keys, size * (1 << width) + rank, side="right") - 1
            container = containers[move] + rank - (keys[move] & ((1 << width) - 1))
            own = capacity[np.searchsorted(starts, container, side="right") - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(container), pa.array(own)], names=[id_col, "piece_no", "tokens", "container_id", "capacity_tokens"])

    placed = ranked(pieces, ["tokens"], [id_col, "piece_no"], "__rank").select(id_col, "piece_no", "tokens", "__rank")
    return placed.mapInArrow(place, f"`{id_col}` {kind}, piece_no int, tokens bigint, container_id bigint, capacity_tokens int").unionByName(none)


def pack_each(items: DataFrame, capacities: list[int], id_col: str = "doc_id", size_col: str = "tokens") -> DataFrame:
    """The same with each capacity alone: every item once under each `capacity_tokens`; containers are numbered within it.

    Rows without size appear once, with null container and capacity.
    """
    out = None
    for capacity in sorted({int(c) for c in capacities}):
        part = pack(items, [capacity], id_col, size_col)
        out = part if out is None else out.unionByName(part.where("container_id is not null"))
    return out
