"""Nearest rows by cosine: products of blocks of unit vectors, with a bounded list for each row."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from math import ceil
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.operators.partitions import norm

BLOCK_ROWS = 1024
#: Queries of a group, by the numbers of their vectors and lists; a task holds one group, and all rows go by in blocks of SEEN_ROWS.
GROUP_SIZE, SEEN_ROWS = 2**24, 2048
#: Small tables are dealt to this many groups for the sake of the cores.
LEAST_GROUPS = 8
#: Cosines are held to nine digits, so that equal ones tie.
DIGITS = 9


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """(ids, x, block): rows packed to blocks, vectors as bytes."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, block_rows):
                part = b.slice(i, block_rows)
                yield pa.RecordBatch.from_arrays([pa.array([x.to_numpy().tobytes()], pa.binary()) for x in (part["id"], part["v"].flatten())], names=["ids", "x"])

    return rows.mapInArrow(packed, "ids binary, x binary").withColumn("block", F.monotonically_increasing_id())


class _Lists:
    """The k best rows of each of some queries, so far; pairs wait until a merge pays."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k = ids, x, k
        self.score, self.other = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        self.waiting: list[tuple[np.ndarray, ...]] = []

    def merge(self) -> None:
        old = np.nonzero(self.score > -np.inf)
        q, s, other = (np.concatenate(c) for c in zip((old[0], self.score[old], self.other[old]), *self.waiting, strict=True))
        self.waiting = []
        order = np.lexsort((other, -s, q))
        q, s, other = q[order], s[order], other[order]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.ids)))[q]
        kept = place < self.k
        at = q[kept], place[kept]
        self.score[at], self.other[at] = s[kept], other[kept]

    def see(self, ids: np.ndarray, v: np.ndarray) -> None:
        """Products in single precision leave out what can't enter a list; the others are made in double precision."""
        least, last = self.score[:, -1], self.other[:, -1]
        n = len(ids)
        at = None
        if (least > -np.inf).all():
            slack = (v.shape[1] + 4) * 1.2e-7 + 10.0**-DIGITS
            at = np.flatnonzero(self.x.astype(np.float32) @ v.astype(np.float32).T >= (least - slack).astype(np.float32)[:, None])
        if at is not None and len(at) <= len(self.ids) * n // 16:
            score = np.concatenate([np.einsum("ij,ij->i", self.x[p // n], v[p % n]) for p in np.array_split(at, len(at) // 65536 + 1)])
            score = np.round(score, DIGITS)
        else:
            # lists that aren't full, or many rows about as near as the last of a list
            all_scores = np.round(self.x @ v.T, DIGITS)
            all_scores[np.isnan(all_scores) | (self.ids[:, None] == ids[None, :])] = -np.inf
            low = least if n <= self.k else np.maximum(least, np.partition(all_scores, n - self.k, axis=1)[:, n - self.k])
            at = np.flatnonzero((all_scores >= low[:, None]) & (all_scores > -np.inf))
            score = all_scores.ravel()[at]
        q, other = at // n, ids[at % n]
        fine = (self.ids[q] != other) & ((score > least[q]) | ((score == least[q]) & (other < last[q])))
        self.waiting.append((q[fine], score[fine], other[fine]))
        if sum(len(w[0]) for w in self.waiting) * 2 > self.score.size or least.min() == -np.inf:
            self.merge()

    def rows(self) -> pa.RecordBatch:
        self.merge()
        at = np.nonzero(self.score > -np.inf)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[at[0]]), pa.array(self.other[at]), pa.array(self.score[at]), pa.array(at[1] + 1, pa.int32())], names=["id", "other", "score", "rank"])


def cosine_neighbours(df: DataFrame, k: int, ident: str = "vec_id", vector: str = "embedding", queries: Column | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, other, score, rank): the k rows of highest cosine for each row where `queries` holds (all, if None), itself left out.

    Ties, to nine digits, go to the smaller ident. Rows with a null ident, a null, zero or non-finite vector or one of
    another length than the longest take no part. Idents are whole numbers. A task holds one group of queries with their
    lists, and all rows go by: what is shuffled is each query once and each row once for a group.
    """
    element = np.float32 if df.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    x = F.col(vector).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = df.select(F.col(ident).cast("long").alias("id"), F.when(fine, F.col(vector) if element is np.float32 else x).alias("v"), (F.lit(True) if queries is None else queries).alias("q")).filter("id is not null and v is not null")
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.count_if("q").alias("asked"), (F.count_distinct("id") < F.count("id")).alias("repeated")).first()
    dim = int(size["dim"] or 0)
    rows = rows.filter((F.size("v") == dim) & (norm(F.col("v").cast("array<double>")) > 0))
    groups = max(1, ceil(size["asked"] * (dim + 2 * k) / GROUP_SIZE), min(LEAST_GROUPS, ceil(size["asked"] / BLOCK_ROWS)))
    # blocks in turn, from another group on in each partition
    turn = F.shiftright("block", 33) * 7919 + F.col("block").bitwiseAND(F.lit(2**33 - 1))
    asked = _blocks(rows.filter("q").select("id", "v"), block_rows).select(F.pmod(turn, F.lit(groups)).cast("int").alias("cell"), F.lit(0).alias("turn"), "ids", "x")
    seen = _blocks(rows.select("id", "v"), block_rows).select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell"), F.lit(1).alias("turn"), "ids", "x")
    met = asked.union(seen).repartitionById(groups, "cell").sortWithinPartitions("cell", "turn")

    def unit(blocks: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
        v = np.frombuffer(b"".join(x for _, x in blocks), element).reshape(-1, dim).astype(np.float64)
        return np.frombuffer(b"".join(i for i, _ in blocks), np.int64), v / np.sqrt((v * v).sum(axis=1))[:, None]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = (r for b in batches for r in zip(b["cell"].to_pylist(), b["turn"].to_pylist(), b["ids"].to_pylist(), b["x"].to_pylist(), strict=True))
        for _, of_cell in groupby(blocks, itemgetter(0)):
            lists: list[_Lists] = []
            waiting: list[tuple[bytes, bytes]] = []
            full = {0: 8 * BLOCK_ROWS, 1: 8 * SEEN_ROWS}

            def meet(turn: int, lists: list[_Lists] = lists, waiting: list[tuple[bytes, bytes]] = waiting) -> None:
                if waiting:
                    ids, v = unit(waiting)
                    waiting.clear()
                    if turn:
                        for one in lists:
                            one.see(ids, v)
                    else:
                        lists.extend(_Lists(ids[i : i + BLOCK_ROWS], v[i : i + BLOCK_ROWS], k) for i in range(0, len(ids), BLOCK_ROWS))

            for turn, of_turn in groupby(of_cell, itemgetter(1)):
                for _, _, ids, x in of_turn:
                    if turn == 0 or lists:
                        waiting.append((ids, x))
                    if sum(len(i) for i, _ in waiting) >= full[turn]:
                        meet(turn)
                meet(turn)
            yield from (one.rows() for one in lists)

    found = met.mapInArrow(best, "id long, other long, score double, rank int")
    if not size["repeated"]:
        return found
    # rows that share an ident share a list
    by_score = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)


def cosine_weighted_mean(neighbours: DataFrame, values: DataFrame, value: str, power: int = 8) -> DataFrame:
    """(id, mean, weight): mean of the neighbours' values, weighted by a power of the cosine; negative cosines weigh nothing.

    values: other and the value; neighbours without a value don't count, rows without any neighbour that weighs are left out.
    """
    known = neighbours.join(values.filter(F.col(value).isNotNull()), "other").withColumn("__w", F.pow(F.greatest("score", F.lit(0.0)), F.lit(float(power))))
    sums = known.groupBy("id").agg(F.sum(F.col("__w") * F.col(value)).alias("__s"), F.sum("__w").alias("weight"))
    return sums.filter("weight > 0").select("id", (F.col("__s") / F.col("weight")).alias("mean"), "weight")
