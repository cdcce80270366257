"""Cuts of a sequence: the best partition for every number of segments, and change points against a frozen null."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.operators.statistics import benjamini_hochberg
from creatorlake.operators.windows import value_places


def best_cuts(values: np.ndarray, most: int) -> list[tuple[float, list[int]]]:
    """(squared error around segment means, starts of the segments) of the best partition into 1, 2, ... segments; the earliest start of equal ones.

    One table over prefix sums serves every number of segments: the best for k up to an end is that for k - 1 up to a
    start, and the error of what lies between.
    """
    n = len(values)
    x = values - values.mean() if n else values
    s, ss = np.append(0, np.cumsum(x)), np.append(0, np.cumsum(x * x))
    start, end = np.arange(n + 1)[:, None], np.arange(n + 1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        cost = np.where(end > start, np.maximum(ss[None, :] - ss[:, None] - (s[None, :] - s[:, None]) ** 2 / (end - start), 0), np.inf)
    best, came, out = np.append(0.0, np.full(n, np.inf)), [], []
    for _ in range(min(most, n)):
        through = best[:, None] + cost
        came.append(through.argmin(axis=0))
        best = through.min(axis=0)
        at, starts = n, []
        for back in reversed(came):
            at = int(back[at])
            starts.append(at)
        out.append((float(best[n]), starts[::-1]))
    return out


def optimal_partitions(df: DataFrame, ident: str, values: str, most: int) -> DataFrame:
    """(ident, segments, cost, starts): the best partition of each row's list into 1 to `most` segments, as many as it has values.

    Null and non-finite values are left out of a list first; a null or empty one gives no row. A row's work and memory grow
    with the square of its list.
    """
    kind = df.schema[ident].dataType
    kept = F.filter(F.col(values).cast("array<double>"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, x in enumerate(b.column(1).to_pylist()):
                found = best_cuts(np.array(x or [], float), most)
                at += [i] * len(found)
                rows += [(k, *f) for k, f in enumerate(found, 1)]
            columns = [pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.float64(), pa.list_(pa.int32())))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *columns], names=[ident, "segments", "cost", "starts"])

    return df.select(ident, kept.alias("v")).mapInArrow(cut, f"`{ident}` {kind.simpleString()}, segments int, cost double, starts array<int>")


def tail_p(df: DataFrame, value: str, null: DataFrame | None = None) -> DataFrame:
    """df with p: (1 + rows of the null that are as large or larger) / (rows of the null + 1).

    null: a table with the same column; df itself if None. Counts come from value_places, so no task orders the whole null.
    """
    known = df if null is None else null
    weighed = known.filter(F.col(value).isNotNull()).select(value, F.lit(1).alias("__w"))
    places = value_places(weighed.unionByName(df.filter(F.col(value).isNotNull()).select(value, F.lit(0).alias("__w"))), value, weight=F.col("__w"))
    p = (1 + F.col("__n") - F.col("__below")) / (F.col("__n") + 1)
    return df.join(places.select(value, p.cast("double").alias("p")), value)


def change_points(steps: DataFrame, ident: str, at: str, distance: str, alpha: float, null: DataFrame | None = None) -> DataFrame:
    """steps with p, q and cut: a step is a cut where its q (Benjamini-Hochberg within its ident) is alpha or less. Null distances are left out."""
    found = benjamini_hochberg(tail_p(steps.filter(F.col(distance).isNotNull()), distance, null), "p", ident)
    return found.withColumn("cut", F.col("q") <= alpha)


def segments(rows: DataFrame, cuts: DataFrame, ident: str, at: str) -> DataFrame:
    """(ident, segment, first, last, n): rows in order, a new segment at each cut. rows and cuts: ident and at."""
    over = Window.partitionBy(ident).orderBy(at)
    marked = rows.join(cuts.select(ident, at, F.lit(1).alias("__cut")), [ident, at], "left")
    numbered = marked.withColumn("segment", F.coalesce(F.sum("__cut").over(over), F.lit(0)))
    return numbered.groupBy(ident, "segment").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
