"""Spherical k-means: centroids go to the tasks, sums come back by cluster and dimension."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.operators.partitions import norm
from creatorlake.sources.steps import step

DIGITS = 9


@dataclass
class Clustering:
    """assigned: id, cluster, score (cosine with the own centroid), second (with the next best); scores: mean cosine before each round's move."""

    assigned: DataFrame
    centroids: np.ndarray
    scores: list[float]


def _units(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy().reshape(len(column), dim)
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _own(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, cosine, next best cosine); ties, to nine digits, go to the smaller cluster."""
    scores = np.round(x @ centroids.T, DIGITS)
    own, rows = scores.argmax(axis=1), np.arange(len(x))
    best = scores[rows, own]
    scores[rows, own] = -np.inf
    return own, best, scores.max(axis=1)


def spherical_kmeans(df: DataFrame, k: int, rounds: int, ident: str = "vec_id", vector: str = "embedding", share: float = 1.0) -> Clustering:
    """k clusters of unit vectors by cosine.

    The first centroids are the k rows of lowest sha256 of the ident, ties by ident. Each round moves a centroid to the
    direction of its rows' sum; one without rows, or whose rows cancel out, stays. share < 1: a round learns from the rows
    whose hash with the round's number lies below it (mini-batches of the same size in expectation); all rows are
    assigned at the end. k and the dimensions bound what the driver holds. Rows with a null ident, a null, zero or
    non-finite vector or one of another length than the longest take no part; fewer rows than k give fewer clusters.
    """
    spark = df.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(ident).alias("id"), F.when(fine, v).alias("v")).filter("id is not null and v is not null")
    dim = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    rows = step(rows.filter((F.size("v") == dim) & (norm(F.col("v")) > 0)), "points")
    seeds = rows.orderBy(F.sha2(F.col("id").cast("string"), 256), "id").limit(k).toArrow()
    centroids = _units(seeds["v"].combine_chunks(), dim) if seeds.num_rows else np.zeros((0, dim))
    scores: list[float] = []
    for turn in range(rounds if len(centroids) else 0):
        sent = spark.sparkContext.broadcast(centroids)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, n, score = np.zeros_like(sent.value), np.zeros(len(sent.value), np.int64), np.zeros(len(sent.value))
            for b in batches:
                if b.num_rows:
                    x = _units(b["v"], dim)
                    own, best, _ = _own(x, sent.value)
                    np.add.at(total, own, x)
                    n += np.bincount(own, minlength=len(n))
                    score += np.bincount(own, best, minlength=len(n))
            at = np.arange(len(n))
            columns = [np.repeat(at, dim), np.tile(np.arange(dim), len(n)), total.ravel(), np.repeat(n, dim), np.repeat(score, dim)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cluster", "dim", "sum", "n", "score"])

        some = rows if share >= 1 else rows.filter(F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(10**6)) < int(share * 10**6))
        parts = some.select("v").mapInArrow(sums, "cluster long, dim long, sum double, n long, score double")
        table = parts.groupBy("cluster", "dim").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.sum("score").alias("score")).orderBy("cluster", "dim").toArrow()
        if not table.num_rows:
            break
        moved = table["sum"].to_numpy().reshape(centroids.shape)
        length = np.sqrt((moved * moved).sum(axis=1))
        n, score = (table[c].to_numpy().reshape(centroids.shape)[:, 0] for c in ("n", "score"))
        scores.append(float(score.sum() / max(1, n.sum())))
        keep = length > 1e-12
        centroids = np.where(keep[:, None], moved / np.where(keep, length, 1)[:, None], centroids)
    last = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, best, second = _own(_units(b["v"], dim), last.value) if b.num_rows else (np.zeros(0, np.int64),) * 3
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(own.astype(np.int32)), pa.array(best.astype(float)), pa.array(np.where(np.isfinite(second), second, np.nan).astype(float))], names=["id", "cluster", "score", "second"])

    kind = rows.schema["id"].dataType.simpleString()
    return Clustering(rows.mapInArrow(assign, f"id {kind}, cluster int, score double, second double"), centroids, scores)


def gated_clusters(assigned: DataFrame, groups: DataFrame, group: str, least: int, least_groups: int, most_share: float) -> DataFrame:
    """(cluster, n, n_groups, cohesion, margin, kept): a cluster is kept if it has enough rows, from enough groups, and isn't most of all rows.

    groups: id and the group column. cohesion is the mean cosine with the own centroid, margin what it has over the next best.
    """
    total = assigned.agg(F.count(F.lit(1)).alias("total"))
    by = assigned.join(groups, "id", "left").groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct(group).alias("n_groups"), F.avg("score").alias("cohesion"), F.avg(F.col("score") - F.col("second")).alias("margin")
    )
    kept = (F.col("n") >= least) & (F.col("n_groups") >= least_groups) & (F.col("n") <= most_share * F.col("total"))
    return by.join(F.broadcast(total)).select("cluster", "n", "n_groups", "cohesion", "margin", kept.alias("kept"))


def centroid_distances(df: DataFrame, group: str, ident: str = "vec_id", vector: str = "embedding", most: int = 50_000_000) -> DataFrame:
    """(id, own_group, nearest, distance, own, other): for each row the nearest group mean, and its distances to its own group's mean and the nearest other one.

    Ties, to nine digits, go to the smaller group; other is null with one group. The means go to every task: more than
    `most` numbers in them are refused. Rows with a null group, ident or vector, a null or non-finite component or
    another length than the longest take no part.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(ident).alias("id"), F.col(group).alias("own_group"), F.when(fine, v).alias("v")).dropna()
    size = rows.agg(F.max(F.size("v")).alias("dim"), F.approx_count_distinct("own_group").alias("k")).first()
    dim = int(size["dim"] or 0)
    if 0.9 * size["k"] * dim > most:
        raise ValueError(f"about {size['k']} groups of {dim} dimensions are too many for every task")
    rows = rows.filter((F.size("v") == dim) & (F.size("v") > 0))
    means = rows.select("own_group", F.posexplode("v").alias("dim", "x")).groupBy("own_group", "dim").agg(F.avg("x").alias("x")).orderBy("own_group", "dim").toArrow()
    names = means["own_group"].combine_chunks().take(pa.array(range(0, means.num_rows, dim or 1), pa.int64())) if means.num_rows else means["own_group"].combine_chunks()
    sent = df.sparkSession.sparkContext.broadcast((names, means["x"].to_numpy().reshape(len(names), dim)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centres = sent.value
        place = {name: i for i, name in enumerate(names.to_pylist())}
        for b in batches:
            x = b["v"].flatten().to_numpy().reshape(b.num_rows, dim)
            d = np.round(np.sqrt(np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1) - 2 * x @ centres.T, 0)), DIGITS)
            own, at = np.array([place[g] for g in b["own_group"].to_pylist()], np.int64), np.arange(len(x))
            near = d.argmin(axis=1)
            distance, mine = d[at, near], d[at, own].copy()
            d[at, own] = np.inf
            other = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([b["id"], b["own_group"], names.take(pa.array(near)), pa.array(distance), pa.array(mine), pa.array(other, mask=~np.isfinite(other))], names=["id", "own_group", "nearest", "distance", "own", "other"])

    i, g = (rows.schema[c].dataType.simpleString() for c in ("id", "own_group"))
    return rows.mapInArrow(measured, f"id {i}, own_group {g}, nearest {g}, distance double, own double, other double")
