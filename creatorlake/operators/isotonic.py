"""Monotone fits: adjacent violators pooled by pieces, whose blocks are merged again by pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.operators.windows import value_places
from creatorlake.sources.steps import step

PIECE = 65_536


def pooled(sums: np.ndarray, counts: np.ndarray) -> list[int]:
    """Where the blocks of a rising fit start: neighbours whose means fall are pooled until none do."""
    start: list[int] = []
    s: list[float] = []
    c: list[float] = []
    for i, (x, n) in enumerate(zip(sums.tolist(), counts.tolist(), strict=True)):
        at = i
        while s and s[-1] * n >= x * c[-1]:
            at, x, n = start.pop(), x + s.pop(), n + c.pop()
        start.append(at)
        s.append(x)
        c.append(n)
    return start


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group and piece: each piece's pooled blocks, numbered from 0."""
    held: list[pa.RecordBatch] = []

    def blocks() -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        sums, counts = t["sum"].to_numpy(), t["n"].to_numpy()
        start = np.array(pooled(sums, counts), np.int64)
        end = np.append(start[1:], len(sums)) - 1
        add = lambda x: pa.array(np.add.reduceat(x, start))
        first, last = pa.array(start), pa.array(end)
        return pa.RecordBatch.from_arrays(
            [*(t[c].combine_chunks().take(first) for c in ("g", "piece", "low")), t["high"].combine_chunks().take(last), t["first"].combine_chunks().take(first), t["last"].combine_chunks().take(last), add(sums), add(counts), pa.array(np.arange(len(start)))],
            names=["g", "piece", "low", "high", "first", "last", "sum", "n", "at"],
        )

    now = None
    for b in batches:
        keys = list(zip(b["g"].to_pylist(), b["piece"].to_pylist(), strict=True))
        edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for s, e in zip(edges, edges[1:], strict=False):
            if s < e:
                if held and keys[s] != now:
                    yield blocks()
                    held.clear()
                now = keys[s]
                held.append(b.slice(s, e - s))
    if held:
        yield blocks()


def isotonic_levels(df: DataFrame, x: str, y: str, *by: str, rising: bool = True, piece: int = PIECE) -> DataFrame:
    """(by, low, high, level, n, first, last): the level steps of the least-squares monotone fit of y on x, one row for each.

    Rows of equal x count together; rows with a null or NaN in x, y or `by` are left out. Pooling within pieces of the order
    of x leaves blocks of a sum and a count that can be pooled again, in whatever pieces: rounds over pieces of `piece`
    blocks, their borders moved by half a piece each second round, go on until two rounds pool nothing. No task holds more
    than a piece. first and last are places of x in its group.
    """
    fine = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(F.col(x).cast("double")) & ~F.isnan(F.col(y).cast("double")))
    for c in by:
        fine = fine.filter(F.col(c).isNotNull())
    sign = 1.0 if rising else -1.0
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    sums = fine.groupBy(*by, x).agg(F.sum(F.col(y).cast("double") * sign).alias("sum"), F.count(F.lit(1)).cast("double").alias("n"))
    placed = sums.join(value_places(fine, x, *by).select(*by, x, F.col("__below").cast("long").alias("first"), "__c"), [*by, x])
    last = (F.col("first") + F.col("__c") - 1).cast("long")
    now = step(placed.select(group.alias("g"), F.col("first").alias("at"), F.col(x).cast("double").alias("low"), F.col(x).cast("double").alias("high"), "first", last.alias("last"), "sum", "n"), "levels")
    schema = "g string, piece long, low double, high double, first long, last long, sum double, n double, at long"
    count, quiet, turn = now.count(), 0, 0
    while quiet < 2 and count:
        cut = now.withColumn("piece", F.expr(f"(at + {piece // 2 if turn % 2 else 0}) div {piece}"))
        found = cut.select("g", "piece", "at", "low", "high", "first", "last", "sum", "n").repartition("g", "piece").sortWithinPartitions("g", "piece", "at").mapInArrow(_pieces, schema)
        found = step(found, "levels")
        sizes = found.groupBy("g", "piece").agg(F.count(F.lit(1)).alias("k"))
        before = sizes.select("g", "piece", F.coalesce(F.sum("k").over(Window.partitionBy("g").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
        now = found.join(before, ["g", "piece"]).select("g", (F.col("before") + F.col("at")).alias("at"), "low", "high", "first", "last", "sum", "n")
        left = found.count()
        quiet, count, turn = (0 if left < count else quiet + 1), left, turn + 1
        if turn == 1 and before.filter("before > 0").isEmpty():
            break  # one piece in each group
    back = F.from_json("g", df.select(*by).schema) if by else None
    names = [back[c].alias(c) for c in by]
    return now.select(*names, "low", "high", (sign * F.col("sum") / F.col("n")).alias("level"), F.col("n").cast("long").alias("n"), "first", "last")


def isotonic_fit(df: DataFrame, x: str, y: str, *by: str, rising: bool = True, piece: int = PIECE) -> DataFrame:
    """(by, x, fit): the monotone fit at each x that occurs with a y."""
    levels = isotonic_levels(df, x, y, *by, rising=rising, piece=piece)
    covers = levels.withColumn("__p", F.explode(F.sequence(F.expr(f"first div {piece}"), F.expr(f"last div {piece}"))))
    placed = value_places(df.filter(F.col(y).isNotNull() & ~F.isnan(F.col(y).cast("double"))), x, *by).withColumn("__p", F.expr(f"cast(__below as long) div {piece}"))
    met = placed.join(covers, [*by, "__p"]).filter((F.col("__below") >= F.col("first")) & (F.col("__below") <= F.col("last")))
    return met.select(*by, x, F.col("level").alias("fit"))


def survival_and_replay(curves: DataFrame, ident: str, at: str, value: str, least: float = 1e-4) -> DataFrame:
    """(ident, at, survival, replay): the falling fit of each curve over its first point, and what the curve has above it.

    Fits below `least` count as that; a curve's own first value scales what is above; without one other than zero replay is null.
    """
    fit = isotonic_fit(curves, at, value, ident, rising=False).withColumn("fit", F.greatest("fit", F.lit(least)))
    start = F.first("fit").over(Window.partitionBy(ident).orderBy(at))
    whole = curves.join(fit, [ident, at]).select(ident, at, (F.col("fit") / start).alias("survival"), value, F.first(value).over(Window.partitionBy(ident).orderBy(at)).alias("__first"))
    over = F.when(F.col("__first") != 0, F.greatest(F.col(value) / F.col("__first") - F.col("survival"), F.lit(0.0)))
    return whole.select(ident, at, "survival", over.alias("replay"))
