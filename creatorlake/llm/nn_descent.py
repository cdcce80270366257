"""Approximate nearest neighbours: a neighbour graph by NN-descent, searched greedily.

Random-projection trees give each vector some first neighbours. Each round then brings the neighbours and reverse
neighbours of every vector together by Spark joins and compares them with each other: neighbours of neighbours are
likely neighbours. Only pairs with a neighbour that is new since the last round are compared. A query starts at its own
place in the graph and goes on to the unvisited neighbours of its nearest finds until none of those is left unvisited.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.llm.common import written

NEIGHBOURS, TREES, LEAF_ROWS, ROUNDS, PART_ROWS, SAMPLE_ROWS = 24, 3, 1024, 4, 48, 20_000
POOL, WIDTH, FRESH = 256, 64, 0.01


class ProjectionTree:
    """Splits at the medians of random projections of a sample; a last projection orders the rows of a leaf."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rng = np.random.default_rng(seed)
        self.nodes: list[tuple[np.ndarray, float, int, int] | int] = []
        self.last, self.leaves = rng.standard_normal(sample.shape[1]), 0
        self._grow(sample, depth, rng)

    def _grow(self, rows: np.ndarray, depth: int, rng: np.random.Generator) -> int:
        at, direction = len(self.nodes), rng.standard_normal(rows.shape[1])
        self.nodes.append(-1)
        at_rows = rows @ direction
        cut = float(np.median(at_rows)) if len(rows) else 0.0
        left = at_rows <= cut
        if not depth or left.all() or not left.any():
            self.nodes[at], self.leaves = self.leaves, self.leaves + 1
        else:
            self.nodes[at] = (direction, cut, self._grow(rows[left], depth - 1, rng), self._grow(rows[~left], depth - 1, rng))
        return at

    def place(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, place in it) of each row."""
        out, stack = np.zeros(len(points), np.int32), [(0, np.arange(len(points)))]
        while stack:
            at, rows = stack.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                out[rows] = node
            elif len(rows):
                left = points[rows] @ node[0] <= node[1]
                stack += [(node[2], rows[left]), (node[3], rows[~left])]
        return out, points @ self.last


def _points(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(len(column), dim).astype(np.float64)


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances between all rows; infinite from a row to itself."""
    s = (x * x).sum(axis=1)
    d = np.maximum(s[:, None] + s[None, :] - 2 * (x @ x.T), 0)
    np.fill_diagonal(d, np.inf)
    return d


def _edges(u: list[np.ndarray], w: list[np.ndarray], d: list[np.ndarray]) -> pa.RecordBatch:
    join = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
    return pa.RecordBatch.from_arrays([join(u, pa.int64()), join(w, pa.int64()), join(d, pa.float64())], names=["node", "w", "d"])


EDGE = "node long, w long, d double"


def _runs(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[pa.Table]:
    """The rows of each run of equal key columns (the first `keys`), in pieces of at most `most` rows."""
    held: list[pa.RecordBatch] = []
    last, rows = None, 0
    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), b.num_rows] if b.num_rows else []
        for s, e in zip(edges, edges[1:], strict=False):
            key = tuple(c[s] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            last = key
            while s < e:
                take = min(e - s, most - rows)
                held.append(b.slice(s, take))
                s, rows = s + take, rows + take
                if rows == most:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _first_lists(batches: Iterator[pa.RecordBatch], dim: int, k: int, leaf_rows: int) -> Iterator[pa.RecordBatch]:
    """The k nearest of each row among the rows of its piece of a leaf."""
    for t in _runs(batches, 1, leaf_rows):
        node = t["node"].to_numpy()
        if len(node) > 1:
            d = _squares(_points(t["x"].combine_chunks(), dim))
            n = min(k, len(node) - 1)
            near = np.argpartition(d, n - 1, axis=1)[:, :n]
            yield _edges([np.repeat(node, n)], [node[near].ravel()], [np.take_along_axis(d, near, 1).ravel()])


def _local_joins(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """(node, w, d) for members of one centre that are nearer to each other than the farthest that `node` has so far."""
    u, w, d, n = [], [], [], 0
    for t in _runs(batches, 2, 2**31):
        fresh = t["fresh"].to_numpy()
        if not fresh.any():
            continue
        member, limit = t["member"].to_numpy(), t["limit"].to_numpy()
        near = _squares(_points(t["x"].combine_chunks(), dim))
        i, j = np.nonzero((fresh[:, None] | fresh[None, :]) & (near < limit[:, None]))
        u.append(member[i])
        w.append(member[j])
        d.append(near[i, j])
        n += len(i)
        if n > 50_000:
            yield _edges(u, w, d)
            u, w, d, n = [], [], [], 0
    yield _edges(u, w, d)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """(node, w, d, fresh): the k nearest of each node; edges may name a pair several times, it is fresh if all its rows are."""
    once = edges.groupBy("node", "w").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    return once.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("d", "w"))).filter(F.col("n") <= k).drop("n")


def neighbour_graph(points: DataFrame, dim: int, k: int = NEIGHBOURS, trees: int = TREES, rounds: int = ROUNDS, leaf_rows: int = LEAF_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(node, w, d): about the k nearest of each node by squared distance.

    points: node, x (dim floats as bytes). A node that very many have as a neighbour meets them in parts of part_rows, its
    own neighbours in each of them, so no task holds all of them and none is left out. Rounds end early when less than
    FRESH of all neighbours are new.
    """
    spark, total = points.sparkSession, points.count()
    share = int(min(1.0, SAMPLE_ROWS / max(1, total)) * 10**6)
    picked = points.filter(F.pmod(F.xxhash64("node"), F.lit(10**6)) < share).select("x").limit(SAMPLE_ROWS).toArrow()
    sample = _points(picked.column(0).combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim))
    depth = min(ceil(log2(max(1, total / leaf_rows))), int(log2(max(8, len(sample)) / 8)))
    sent = spark.sparkContext.broadcast([ProjectionTree(sample, depth, seed) for seed in range(trees)])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _points(b["x"], dim)
            for n, tree in enumerate(sent.value):
                leaf, place = tree.place(x)
                yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64) * trees + n), pa.array(place), b["node"], b["x"]], names=["leaf", "place", "node", "x"])

    by = ["leaf", "place", "node"]
    leaves = points.select("node", "x").mapInArrow(placed, "leaf long, place double, node long, x binary").repartitionByRange(*by).sortWithinPartitions(*by)
    first = leaves.mapInArrow(lambda b: _first_lists(b, dim, k, leaf_rows), EDGE)
    graph = written(_nearest(first.withColumn("fresh", F.lit(True)), k), "graph", tidy=True)
    for _ in range(rounds):
        limits = graph.groupBy("node").agg(F.when(F.count(F.lit(1)) >= k, F.max("d")).otherwise(float("inf")).alias("limit"))
        own = graph.select(F.col("node").alias("centre"), F.col("w").alias("member"), "fresh", F.lit(True).alias("own"))
        back = graph.select(F.col("w").alias("centre"), F.col("node").alias("member"), "fresh", F.lit(False).alias("own"))
        both = own.unionByName(back).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"), F.max("own").alias("own"))
        hubs = back.groupBy("centre").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > 2 * part_rows).select("centre", F.ceil(F.col("k") / part_rows).alias("parts"))
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        where = F.when(F.col("own"), F.sequence(F.lit(0).cast("long"), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("member"), parts)))
        dealt = both.join(hubs, "centre", "left").select("centre", F.explode(where).alias("part"), "member", "fresh")
        known = points.select("node", "x").join(limits, "node").withColumnRenamed("node", "member")
        met = dealt.join(known, "member").select("centre", "part", "member", "fresh", "limit", "x").repartition("centre", "part").sortWithinPartitions("centre", "part")
        better = met.mapInArrow(lambda b: _local_joins(b, dim), EDGE).withColumn("fresh", F.lit(True))
        graph = written(_nearest(graph.withColumn("fresh", F.lit(False)).unionByName(better), k), "graph", tidy=True)
        if graph.filter("fresh").count() < FRESH * k * total:
            break
    return graph.select("node", "w", "d")


def _far(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Squared distances of pairs whose vectors are columns x and y."""
    for b in batches:
        diff = _points(b["x"], dim) - _points(b["y"], dim)
        yield pa.RecordBatch.from_arrays([b["q"], b["w"], pa.array((diff * diff).sum(axis=1))], names=["q", "w", "d"])


def graph_search(points: DataFrame, graph: DataFrame, queries: DataFrame, dim: int, pool: int = POOL, width: int = WIDTH, k: int = NEIGHBOURS) -> DataFrame:
    """(q, w, d): for each query node the `pool` nearest nodes that a greedy search from it has met.

    In each round every query goes to the `width` nearest of its pool that it hasn't visited and measures their
    neighbours; it ends when all of the pool are visited. A node's neighbours are its own list and the 2 * k nearest of
    those that have it in theirs.
    """
    back = graph.select(F.col("w").alias("node"), F.col("node").alias("w"), "d")
    back = back.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("d", "w"))).filter(F.col("n") <= 2 * k)
    linked = graph.select("node", "w").unionByName(back.select("node", "w")).groupBy("node").agg(F.collect_set("w").alias("ws"))
    linked = written(linked, "links", tidy=True)
    asked = written(queries.join(points, queries["q"] == points["node"]).select("q", F.col("x").alias("y")), "asked", tidy=True)

    def measured(pairs: DataFrame) -> DataFrame:
        ends = points.select(F.col("node").alias("w"), "x")
        return pairs.join(ends, "w").join(asked, "q").select("q", "w", "x", "y").mapInArrow(lambda b: _far(b, dim), "q long, w long, d double").withColumn("open", F.lit(True))

    met = measured(asked.select("q", F.col("q").alias("w")))
    by_query = Window.partitionBy("q").orderBy("d", "w")
    while True:
        ranked = met.withColumn("n", F.row_number().over(by_query)).withColumn("m", F.row_number().over(Window.partitionBy("q", "open").orderBy("d", "w")))
        visit = F.col("open") & (F.col("n") <= pool) & (F.col("m") <= width)
        ranked = written(ranked.select("q", "w", "d", "open", visit.alias("visit"), "n"), "visits", tidy=True)
        going = ranked.filter("visit")
        if going.isEmpty():
            return ranked.filter(F.col("n") <= pool).select("q", "w", "d")
        near = going.select("q", F.col("w").alias("node")).join(linked, "node").select("q", F.explode("ws").alias("w")).distinct()
        new = measured(near.join(ranked.select("q", "w"), ["q", "w"], "left_anti"))
        met = ranked.select("q", "w", "d", (F.col("open") & ~F.col("visit")).alias("open")).unionByName(new)


def nearest_neighbours(df: DataFrame, is_query: Column, k: int = 10, ident: str = "vec_id", vector: str = "embedding", **graph) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query holds, the k nearest other rows found, by Euclidean distance.

    Approximate: recall is measured, not certain; scores are exact, on the vectors as doubles. Ties go to the smaller
    ident. Rows with a null ident or vector, a null or non-finite component or only zeros (an empty vector too) take no
    part; a shorter vector counts as padded with zeros. Equal vectors are one node of the graph and have the first
    k + min(m, k) of their rows, where an ident comes m times at most; an ident asked with several vectors has the k
    nearest of all of them. The graph is built on vectors as floats, scaled by the largest component.
    """
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("q"), F.when(fine, F.transform(x, lambda v: v + 0.0)).alias("v"))
    rows = written(rows.filter("vec_id is not null and v is not null"), "vectors", tidy=True)
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.max(F.array_max(F.transform("v", lambda c: F.abs(c)))).alias("most")).first()
    dim, most = int(size["dim"] or 0), float(size["most"] or 1.0)
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v"))))
    copies = int(rows.groupBy("vec_id").count().agg(F.max("count")).first()[0] or 0)
    room = k + min(copies, k)
    some = rows if copies <= k else rows.withColumn("n", F.row_number().over(Window.partitionBy("v", "vec_id").orderBy("vec_id"))).filter(F.col("n") <= k)
    first = some.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= room)
    wanted = rows.filter("q").select("v").distinct().withColumn("asked", F.lit(True))
    nodes = first.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).join(wanted, "v", "left")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = (b["v"].flatten().to_numpy().reshape(b.num_rows, dim) / most).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([r.tobytes() for r in x], pa.binary())], names=[*b.schema.names, "x"])

    nodes = nodes.withColumn("node", F.monotonically_increasing_id()).select("node", "v", "ids", "asked")
    nodes = written(nodes.mapInArrow(packed, "node long, v array<double>, ids array<long>, asked boolean, x binary"), "nodes", tidy=True)
    points = nodes.select("node", "x")
    found = graph_search(points, neighbour_graph(points, dim, **graph), nodes.filter("asked").select(F.col("node").alias("q")), dim)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            diff = b["v"].flatten().to_numpy().reshape(b.num_rows, dim) - b["y"].flatten().to_numpy().reshape(b.num_rows, dim)
            with np.errstate(over="ignore"):
                yield pa.RecordBatch.from_arrays([b["q"], b["ids"], pa.array(np.sqrt((diff * diff).sum(axis=1)))], names=["q", "ids", "score"])

    far = found.select("q", F.col("w").alias("node")).join(nodes.select("node", "v", "ids"), "node").join(nodes.filter("asked").select(F.col("node").alias("q"), F.col("v").alias("y")), "q")
    scored = far.select("q", "v", "ids", "y").mapInArrow(exact, "q long, ids array<long>, score double").select("q", "score", F.explode("ids").alias("vec_id"))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("n") <= room)
    lists = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("best"))
    answers = lists.join(nodes.select(F.col("node").alias("q"), "v"), "q").select("v", "best")
    mine = rows.filter("q").select(F.col("vec_id").alias("query_id"), "v").join(answers, "v")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    each = mine.select("query_id", F.explode(others).alias("b")).select("query_id", "b.vec_id", "b.score")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int")
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
