"""Exact top-k search by inner product: a KD-tree in each shard.

Rows are dealt to shards by a coarse KD-tree over a bounded sample; every row is then searched for real. A query first
looks in the shard that would hold it, which gives a k-th best score. That score travels to the other shards: one whose
bounding box can't reach it is never visited. A query goes once to each group of shards; there blocks of queries walk the
trees together: at a node those stay whose k-th best its box can reach, and a leaf is one product for all that get there.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from math import ceil, isqrt, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.llm.common import written
from creatorlake.llm.vectors import int_matrix, quantised

LEAF_ROWS, SHARD_ROWS, SAMPLE_ROWS = 32, 1024, 60_000
#: About so many groups of shards at least, so many components in one at most (a shard at least), so many queries in a block.
GROUPS, GROUP_SIZE, BLOCK = 32, 2**20, 1024


def _split(points: np.ndarray, rows: np.ndarray) -> tuple[int, int] | None:
    """The widest dimension and its median, such that both sides get rows; None if all rows are equal."""
    span = points[rows].max(axis=0) - points[rows].min(axis=0)
    dim = int(span.argmax())
    if not span[dim]:
        return None
    values = np.sort(points[rows, dim])
    cut = values[(len(values) - 1) // 2]
    if cut == values[-1]:
        cut = values[np.searchsorted(values, cut) - 1]
    return dim, int(cut)


class Router:
    """The coarse tree: a split for each inner node, a shard number for each leaf."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple[int, int, int, int] | int] = []
        depth, self.shards = ceil(log2(max(1, shards))), 0
        self._grow(sample, np.arange(len(sample)), depth)

    def _grow(self, points: np.ndarray, rows: np.ndarray, depth: int) -> int:
        at = len(self.nodes)
        self.nodes.append(-1)
        split = _split(points, rows) if depth and len(rows) > 1 else None
        if split is None:
            self.nodes[at], self.shards = self.shards, self.shards + 1
        else:
            left = points[rows, split[0]] <= split[1]
            self.nodes[at] = (*split, self._grow(points, rows[left], depth - 1), self._grow(points, rows[~left], depth - 1))
        return at

    def shard(self, points: np.ndarray) -> np.ndarray:
        out, stack = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                left = points[rows, node[0]] <= node[1]
                stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return out


class Tree:
    """Median splits down to LEAF_ROWS rows; each node keeps its tight bounding box. ids: those of each row."""

    def __init__(self, points: np.ndarray, ids: list[list[int]]):
        self.low, self.high, self.kids, self.leaves, self.ids = [], [], [], {}, ids
        stack = [(np.arange(len(points)), None, 0)]
        while stack:
            rows, parent, side = stack.pop()
            at = len(self.kids)
            if parent is not None:
                self.kids[parent][side] = at
            self.low.append(points[rows].min(axis=0))
            self.high.append(points[rows].max(axis=0))
            split = _split(points, rows) if len(rows) > LEAF_ROWS else None
            self.kids.append([-1, -1] if split else [])
            if split:
                left = points[rows, split[0]] <= split[1]
                stack += [(rows[left], at, 0), (rows[~left], at, 1)]
            else:
                self.leaves[at] = rows, points[rows].T
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, queries: np.ndarray, best: list[list[tuple[int, int]]], least: np.ndarray, k: int, each: int) -> None:
        """Betters for each query its best, (-score, id) of the k best so far, at most `each` of one id, ties to smaller ids.

        Scores below a query's least are left out; it rises to the k-th best.
        """
        bounds = np.ascontiguousarray(box_bounds(queries, self.low, self.high).T)

        def look(at: int, who: np.ndarray) -> None:
            rows, points = self.leaves[at]
            scores = queries[who] @ points
            i, j = np.nonzero(scores >= least[who, None])
            new = defaultdict(list)
            for query, row, score in zip(who[i].tolist(), rows[j].tolist(), scores[i, j].tolist(), strict=True):
                new[query] += [(-int(score), x) for x in self.ids[row]]
            for query, found in new.items():
                best[query][:] = first_of_each(sorted(best[query] + found), k, each)
                if len(best[query]) == k:
                    least[query] = max(least[query], -best[query][-1][0])

        # what has no limit yet gets one in the leaf that promises most
        leaves, seen = np.array(list(self.leaves)), np.full(len(queries), -1)
        open_ = np.flatnonzero(least == lowest(queries.dtype))
        if len(open_):
            seen[open_] = leaves[bounds[leaves][:, open_].argmax(axis=0)]
            for at in np.unique(seen[open_]).tolist():
                look(at, open_[seen[open_] == at])
        stack = [(0, np.arange(len(queries)))]
        while stack:
            at, who = stack.pop()
            who = who[(bounds[at, who] >= least[who]) & (seen[who] != at)]
            if len(who) and self.kids[at]:
                stack += [(kid, who) for kid in sorted(self.kids[at], key=lambda kid: bounds[kid, who].mean())]
            elif len(who):
                look(at, who)


def first_of_each(found: list[tuple[int, int]], k: int, each: int) -> list[tuple[int, int]]:
    """The first k of a sorted list, at most `each` of one id."""
    seen, out = Counter(), []
    for score, ident in found:
        if seen[ident] < each:
            seen[ident] += 1
            out.append((score, ident))
            if len(out) == k:
                break
    return out


def box_bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The highest inner product that any point of each box can have with each query."""
    return np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T


def exact_kind(dim: int, most: int) -> type:
    """What inner products of components of at most this size are exact in: floats up to 2**24, doubles up to 2**53, int64 up to 2**63, else Python integers."""
    bound = dim * most * most
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**63 else object


def lowest(kind: type) -> float:
    """What lies below all scores of a kind."""
    return -(2**63) if kind == np.int64 else float("-inf")


def _limits(column: pa.Array, kind: type) -> np.ndarray:
    return np.array([lowest(kind) if x is None else x for x in column.to_pylist()], kind)


def _matrix(column: pa.Array, dim: int, kind: type) -> np.ndarray:
    return int_matrix(column, dim).astype(kind)


def _longs(values: list[int]) -> pa.Array:
    if values and (max(values) >= 2**63 or min(values) < -(2**63)):
        raise OverflowError("an inner product doesn't fit a long")
    return pa.array(values, pa.int64())


def _visits(shards: DataFrame, queries: DataFrame, dim: int, kind_of: type, k: int, each: int, home: bool) -> DataFrame:
    """(node, score, vec_id): up to k best of each query in each group it visits, at most `each` of one id.

    shards: group, shard, v, ids; queries: group, shard (its own), node, v, least. With home a query looks in its own
    shard, else in all others of the group. A task holds the trees of one group; blocks of queries stream past them.
    """
    a = shards.select("group", F.lit(0).alias("kind"), "shard", "v", "ids", F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("least"))
    b = queries.select("group", F.lit(1).alias("kind"), "shard", "v", F.lit(None).cast("array<long>").alias("ids"), "node", "least")
    rows = a.union(b).repartition("group").sortWithinPartitions("group", "kind", "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, trees = None, [], {}
        for batch in batches:
            group, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(group)]
            for s, e in zip(edges, edges[1:], strict=False):
                if s == e:
                    continue
                if group[s] != now:
                    now, parts, trees = group[s], [], {}
                part = batch.slice(s, e - s)
                shard, points = part.column(2).to_numpy(), _matrix(part.column(3), dim, kind_of)
                if kind[s] == 0:
                    parts.append((shard, points, part.column(4).to_pylist()))
                    continue
                if parts:
                    of, held, ids = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [x for p in parts for x in p[2]]
                    trees = {n: Tree(held[of == n], [ids[i] for i in np.flatnonzero(of == n)]) for n in np.unique(of).tolist()}
                    parts = []
                nodes, least = part.column(5).to_pylist(), _limits(part.column(6), kind_of)
                for i in range(0, len(points), BLOCK):
                    block, best = slice(i, i + BLOCK), [[] for _ in points[i : i + BLOCK]]
                    for n, tree in trees.items():
                        who = np.flatnonzero((shard[block] == n) == home)
                        if len(who):
                            limits = least[i + who]
                            tree.search(points[i + who], [best[x] for x in who], limits, k, each)
                            least[i + who] = limits
                    out = [(node, -s, x) for node, found in zip(nodes[block], best, strict=True) for s, x in found]
                    yield pa.RecordBatch.from_arrays([_longs([r[c] for r in out]) for c in range(3)], names=["node", "score", "vec_id"])

    return rows.mapInArrow(run, "node long, score long, vec_id long")


def top_k(df: DataFrame, is_query: Column, k: int = 5, ident: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, the k other rows of highest inner product.

    Components are floor(scale * x). Ties go to the smaller ident. Rows with a null ident, a null vector or a null or
    non-finite component take no part; a shorter vector counts as padded with zeros. Every row is a candidate, rows that
    share an ident too; a query's candidates are the rows of other idents, and an ident asked with several vectors has
    the k best of all of them. Equal vectors are searched once. Where an ident comes m times at most, the first
    k + min(m, k) rows, at most k of one ident, hold the k best of other idents whichever ident is left out.
    """
    spark = df.sparkSession
    all_rows = df.select(F.col(ident).cast("long").alias("vec_id"), is_query.alias("q"), quantised(F.col(vector), scale).alias("v")).filter("vec_id is not null and v is not null")
    rows = written(all_rows, "vectors")
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max("v")).alias("high"), F.min(F.array_min("v")).alias("low")).first()
    dim = int(size["dim"] or 0)
    kind = exact_kind(dim, max(int(size["high"] or 0), -int(size["low"] or 0)))
    copies = int(rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)
    room = k + min(copies, k)
    # at most k rows of one ident, then at most `room` rows of each vector leave a task
    some = rows if copies <= k else rows.withColumn("__n", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))).filter(F.col("__n") <= k)
    first = some.withColumn("__n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("__n") <= room)
    wanted = rows.filter("q").select("v").distinct()
    nodes = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).join(wanted.withColumn("asked", F.lit(True)), "v", "left")
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    n = nodes.count()
    shard_rows = max(SHARD_ROWS, isqrt(n))
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    sample = nodes.filter(F.pmod(F.xxhash64("v"), F.lit(10**6)) < int(share * 10**6)).select("v").limit(SAMPLE_ROWS).toArrow()
    points = _matrix(sample.column(0).combine_chunks(), dim, kind) if sample.num_rows else np.zeros((0, dim))
    router = Router(points, min(ceil(n / shard_rows), max(1, SAMPLE_ROWS // 8)))
    sent = spark.sparkContext.broadcast(router)
    together = max(1, min(GROUP_SIZE // (shard_rows * max(1, dim)), router.shards // GROUPS))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = sent.value.shard(_matrix(b.column(0), dim, kind))
            yield pa.RecordBatch.from_arrays([pa.array(shard // together), pa.array(shard), *b.columns], names=["group", "shard", "v", "ids", "node", "asked"])

    shards = written(nodes.select("v", "ids", "node", "asked").mapInArrow(dealt, "group int, shard int, v array<long>, ids array<long>, node long, asked boolean"), "shards")
    queries = shards.filter("asked").select("group", "shard", "node", "v")
    home = written(_visits(shards, queries.withColumn("least", F.lit(None).cast("long")), dim, kind, room, k, True), "home")
    worst = home.groupBy("node").agg(F.when(F.count(F.lit(1)) == room, F.min("score")).alias("least"))
    boxes = _boxes(shards, dim, kind)
    sent_boxes = spark.sparkContext.broadcast(boxes)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, low, high = sent_boxes.value
        groups, first = np.unique(numbers // together, return_index=True)
        for b in batches:
            own, q, least = b.column(0).to_numpy(), _matrix(b.column(2), dim, kind), _limits(b.column(3), kind)
            for i in range(0, len(q), BLOCK):
                hit = (box_bounds(q[i : i + BLOCK], low, high) >= least[i : i + BLOCK, None]) & (numbers[None, :] != own[i : i + BLOCK, None])
                at, group = np.nonzero(np.logical_or.reduceat(hit, first, axis=1))
                for j in range(0, len(at), 8 * BLOCK):
                    picked = b.take(pa.array(at[j : j + 8 * BLOCK] + i))
                    yield pa.RecordBatch.from_arrays([pa.array(groups[group[j : j + 8 * BLOCK]].astype(np.int32)), *picked.columns], names=["group", "shard", "node", "v", "least"])

    away = queries.join(worst, "node", "left").select("shard", "node", "v", "least").mapInArrow(reach, "group int, shard int, node long, v array<long>, least long")
    found = home.union(_visits(shards, away, dim, kind, room, k, False))
    if copies > k:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("node", "vec_id").orderBy(F.desc("score")))).filter(F.col("n") <= k)
    by_node = Window.partitionBy("node").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("n", F.row_number().over(by_node)).filter(F.col("n") <= room)
    lists = best.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    answers = lists.join(nodes.select("node", "v"), "node").select("v", "best")
    asked = rows.filter("q").select(F.col("vec_id").alias("query_id"), "v")
    others = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    found = asked.join(answers, "v").select("query_id", F.explode(others).alias("x")).select("query_id", "x.vec_id", "x.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _boxes(shards: DataFrame, dim: int, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard numbers, lowest, highest) for the tight box of each shard; their number is bounded by SAMPLE_ROWS / 8."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for b in batches:
            numbers, points = b.column(0).to_numpy(), int_matrix(b.column(1), dim)
            for s in np.unique(numbers):
                least, most = points[numbers == s].min(axis=0), points[numbers == s].max(axis=0)
                low[s] = np.minimum(low[s], least) if s in low else least
                high[s] = np.maximum(high[s], most) if s in high else most
        keys = list(low)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int32), dim)), pa.array(np.tile(np.arange(dim, dtype=np.int32), len(keys))), pa.array(np.concatenate([low[s] for s in keys]) if keys else np.zeros(0, np.int64)), pa.array(np.concatenate([high[s] for s in keys]) if keys else np.zeros(0, np.int64))], names=["shard", "dim", "low", "high"])

    table = shards.select("shard", "v").mapInArrow(part, "shard int, dim int, low long, high long").groupBy("shard", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas().sort_values(["shard", "dim"])
    numbers = table["shard"].unique() if dim else np.zeros(0, np.int32)
    return numbers, table["low"].to_numpy().astype(kind).reshape(len(numbers), dim), table["high"].to_numpy().astype(kind).reshape(len(numbers), dim)
