"""Resharding by minimum-cost flow: the fewest bytes move from the old shards to new ones of given capacity.

The flow is solved over shards alone; their number is a parameter. Which rows make up each transfer follows from
running sums over blocks of rows, so no shard is ever gathered in one task.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.llm.common import column_of, free, written

BLOCK_BYTES = 32_000_000


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """The cheapest flow[i][j] that empties every supply within the capacities: successive shortest paths with potentials."""
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards can't hold all that the old ones have")
    source, sink, size = n + m, n + m + 1, n + m + 2
    edges: list[list[int]] = []  # to, capacity left, cost; the reverse edge has the number next to it
    out: list[list[int]] = [[] for _ in range(size)]

    def edge(a: int, b: int, most: int, price: int) -> None:
        out[a].append(len(edges))
        edges.append([b, most, price])
        out[b].append(len(edges))
        edges.append([a, 0, -price])

    for i in range(n):
        for j in range(m):
            edge(i, n + j, supply[i], cost[i][j])
    for i in range(n):
        edge(source, i, supply[i], 0)
    for j in range(m):
        edge(n + j, sink, capacity[j], 0)
    height, left = [0] * size, sum(supply)
    while left:
        far, via, heap = [float("inf")] * size, [-1] * size, [(0, source)]
        far[source] = 0
        while heap:
            d, v = heapq.heappop(heap)
            if d > far[v]:
                continue
            for e in out[v]:
                to, most, price = edges[e]
                if most and (at := d + price + height[v] - height[to]) < far[to]:
                    far[to], via[to] = at, e
                    heapq.heappush(heap, (at, to))
        height = [h + (d if d < float("inf") else 0) for h, d in zip(height, far, strict=True)]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = edges[via[v] ^ 1][0]
        push = min([left, *(edges[e][1] for e in path)])
        for e in path:
            edges[e][1] -= push
            edges[e ^ 1][1] += push
        left -= push
    flow = [[0] * m for _ in range(n)]
    for i in range(n):
        for e in out[i]:
            if e % 2 == 0:
                flow[i][edges[e][0] - n] = edges[e ^ 1][1]
    return flow


def capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def transfers(sums: dict[int, int], goal: list[int]) -> list[tuple[int, int, int, int]]:
    """(old shard, new shard, from byte, to byte) of each old shard's bytes in their order, moving as few bytes as can be.

    sums: bytes of each old shard, goal: capacity of each new one. Staying in the shard of the same number is free, any move costs its bytes.
    """
    olds, shards = sorted(sums), len(goal)
    flow = min_cost_flow([sums[i] for i in olds], goal, [[int(i != j) for j in range(shards)] for i in olds])
    out = []
    for i, row in zip(olds, flow, strict=True):
        at = 0
        for j in sorted(range(shards), key=lambda j: (j != i, j)):
            if row[j]:
                out.append((i, j, at, at + row[j]))
                at += row[j]
    return out


@dataclass
class Layout:
    """Where the rows of a table go: apply() adds shard and slot, touched are the shards that gain or lose rows."""

    assign: Callable[[DataFrame], DataFrame]
    starts: DataFrame  # for each block of rows the slot of its first row in each shard
    keys: list[str]
    order: list[str]
    touched: list[int]
    helpers: list[str]

    def apply(self, rows: DataFrame) -> DataFrame:
        """rows (those that the layout was made of, or the same with further columns) with shard (int) and slot (long)."""
        first, nth = self.helpers
        at = self.assign(rows).join(self.starts, self.keys)
        inside = Window.partitionBy(*self.keys, "shard").orderBy(*self.order)
        out = at.withColumn(nth, F.row_number().over(inside)).withColumn("slot", (F.element_at(first, F.col("shard")) + F.col(nth) - 1).cast("long"))
        return out.drop(first, nth, *self.keys[1:], self.order[0])


def layout(
    rows: DataFrame, shards: int, order: list[str], old: str = "old_shard", size: str = "size", group: list[str] | None = None, capacity: list[int] | None = None,
) -> Layout:
    """The layout of placed(), made from the columns old, size, order and group alone; further columns aren't read.

    The rows of an old shard stand in the order of the hash of their group, so equal ones are neighbours. They are dealt
    to blocks of about BLOCK_BYTES, whose sums, added up in order, say where each block starts. A group of more than
    a quarter of a block and a hundred-thousandth of all bytes (there are at most 100,000 of them) is spread over blocks of its own that follow each other.
    """
    spark = rows.sparkSession
    old, size = column_of(rows, old), column_of(rows, size)
    told, bucket, hot, part, base, parts, before, start, whole, middle, ranges, first, nth = free(
        rows, "__group", "__bucket", "__hot", "__part", "__base", "__parts", "__before", "__start", "__whole", "__middle", "__ranges", "__first", "__nth"
    )
    keys, told_by = [old, bucket, hot, part], [told, *order]

    def plain(x: DataFrame) -> DataFrame:
        x = x.drop("shard", "slot").withColumn(old, F.coalesce(F.col(old), F.lit(0)).cast("int")).withColumn(size, F.coalesce(F.col(size), F.lit(0)).cast("long"))
        return x.withColumn(told, F.xxhash64(*(group or order)))

    narrow = written(plain(rows).select(old, size, told, *[c for c in dict.fromkeys(order) if c not in (old, size)]), "layout")
    sums = {int(r[0]): int(r[1]) for r in narrow.groupBy(old).agg(F.sum(size)).collect()}
    total = sum(sums.values())
    goal = capacity or capacities(total, shards)
    most = max(1, min(goal) // 100)
    large = narrow.groupBy(old, told).agg(F.sum(size).alias(parts)).filter(F.col(parts) > max(BLOCK_BYTES // 4, total // 100_000))
    large = written(large.withColumn(parts, F.ceil(F.col(parts) / BLOCK_BYTES)), "large")
    # a few numbers for each old shard: how many of them there are depends on the shard counts only
    by_old: dict[int, list[tuple[int, int]]] = {}
    for i, j, _, end in transfers(sums, goal):
        by_old.setdefault(i, []).append((end, j))
    table = [(i, n // BLOCK_BYTES + 4, [{"end": e, "shard": j} for e, j in by_old.get(i, [])]) for i, n in sums.items()]
    of_old = spark.createDataFrame(table, f"`{old}` int, `{bucket}` long, `{ranges}` array<struct<end:long,shard:int>>")

    def dealt(x: DataFrame) -> DataFrame:
        x = x.join(F.broadcast(large), [old, told], "left").join(F.broadcast(of_old), old).withColumn(bucket, F.pmod(told, F.col(bucket)))
        x = x.withColumn(hot, F.when(F.col(parts).isNull(), 0).otherwise(F.col(told)))
        return x.withColumn(part, F.coalesce(F.pmod(F.xxhash64(F.lit(1), *order), F.col(parts)), F.lit(-1))).drop(parts)

    running = Window.partitionBy(old).orderBy(bucket, hot, part).rowsBetween(Window.unboundedPreceding, -1)
    blocks = dealt(narrow).groupBy(*keys).agg(F.sum(size).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(running), F.lit(0)))
    blocks = written(blocks, "blocks")

    def assign(x: DataFrame) -> DataFrame:
        x = dealt(x if told in x.columns else plain(x)).join(blocks, keys)
        inside, equal = Window.partitionBy(*keys).orderBy(*told_by), Window.partitionBy(*keys, told)
        x = x.withColumn(before, F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        x = x.withColumn(start, F.min(before).over(equal)).withColumn(whole, F.sum(size).over(equal))
        one = F.col(before) + F.floor(F.col(size) / 2)
        x = x.withColumn(middle, F.col(base) + F.when((F.col(whole) <= most) & (F.col(part) < 0), F.col(start) + F.floor(F.col(whole) / 2)).otherwise(one))
        goes = F.coalesce(F.get(F.filter(ranges, lambda r: F.col(middle) < r["end"]), F.lit(0))["shard"], F.get(ranges, F.size(ranges) - 1)["shard"], F.col(old) % shards)
        return x.withColumn("shard", goes.cast("int")).drop(ranges, base, before, start, whole, middle)

    counts = written(assign(narrow).groupBy("shard", *keys).count(), "counts")
    up = Window.partitionBy("shard").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("count", F.coalesce(F.sum("count").over(up), F.lit(0))).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("shard", "count"))).alias(first))
    moved = counts.filter(F.col("shard") != F.col(old)).select("shard", old).distinct().collect()
    return Layout(assign, written(starts, "starts"), keys, told_by, sorted({int(x) for r in moved for x in r}), [first, nth])


def placed(
    rows: DataFrame, shards: int, order: list[str], old: str = "old_shard", size: str = "size", group: list[str] | None = None, capacity: list[int] | None = None,
) -> DataFrame:
    """rows with shard (int) and slot (long, gapless from 0 in each shard), moving as few bytes as can be to shards near equal in bytes.

    rows: `old` is the shard a row is in (int, null counts as 0), size its bytes (long, null counts as 0), order the
    columns that tell rows apart; of equal rows any may go first. A group is the rows of one old shard that are equal in
    the columns of group (those of order by default). A group of up to 1 % of the smallest shard goes where the middle of
    its bytes falls and so stays together; of a larger one each row goes where its own middle falls, so it is split only
    where it lies across a border. A shard's bytes differ from its capacity by less than what goes together at its two
    borders. Columns shard and slot of rows are replaced. rows is read twice and must be the same both times.
    """
    return layout(rows, shards, order, old, size, group, capacity).apply(rows)


def rewrite_affected(placed_rows: DataFrame, path: str, old: str = "old_shard", touched: list[int] | None = None) -> list[int]:
    """Write the shards that gain or lose rows to path/shard=N and leave the other folders alone; returns their numbers.

    touched: those shards if they are known, as from layout(). The new folders are written to the side first, each task
    its own files. Then each touched folder goes and its new one takes its place; a shard that is left without rows keeps no folder.
    """
    spark = placed_rows.sparkSession
    if touched is None:
        touched = sorted({int(x) for r in placed_rows.filter(F.col("shard") != F.col(old)).select("shard", old).distinct().collect() for x in r})
    if not touched:
        return []
    aside = f"{path.rstrip('/')}-{uuid.uuid4().hex}"
    placed_rows.filter(F.col("shard").isin(touched)).write.partitionBy("shard").parquet(aside)
    folder = spark._jvm.org.apache.hadoop.fs.Path
    fs = folder(aside).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(folder(path))
    for n in touched:
        at, new = folder(f"{path}/shard={n}"), folder(f"{aside}/shard={n}")
        if fs.exists(at) and not fs.delete(at, True):
            raise OSError(f"{at} can't be replaced")
        if fs.exists(new) and not fs.rename(new, at):
            raise OSError(f"{new} can't be moved to {at}")
    fs.delete(folder(aside), True)
    return touched
