"""Models whose sums come from Spark and whose small systems are solved on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creatorlake.operators.windows import quantiles
from creatorlake.sources.steps import step


@dataclass
class Logistic:
    """Weights of standardised features after the intercept, and the means and deviations they are standardised by."""

    features: list[str]
    weights: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    gradient: float
    rounds: int

    def probability(self) -> Column:
        x = [(F.col(f).cast("double") - float(m)) / float(s) for f, m, s in zip(self.features, self.mean, self.deviation, strict=True)]
        score = sum((float(w) * c for w, c in zip(self.weights[1:], x, strict=True)), F.lit(float(self.weights[0])))
        return 1 / (1 + F.exp(-score))


def logistic_model(df: DataFrame, features: list[str], label: str, ridge: float = 1.0, rounds: int = 50, close: float = 1e-9) -> Logistic:
    """L2-penalised logistic regression by Newton steps; the intercept isn't penalised.

    Each step is one aggregation of gradient and curvature over all rows; a step that doesn't lower the loss is halved. Rows
    with a null or NaN in a feature or label are left out, constant features get no weight; without rows all weights are 0.
    """
    y = F.col(label).cast("double")
    fine = y.isNotNull() & ~F.isnan(y)
    for f in features:
        fine &= F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    rows = step(df.filter(fine).select(*[F.col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], y.alias("y")), "model")
    k = len(features)
    moments = rows.agg(F.count(F.lit(1)), *[m(f"x{i}") for i in range(k) for m in (F.avg, F.stddev_pop)]).first()
    n, mean = moments[0], np.array([moments[1 + 2 * i] or 0.0 for i in range(k)])
    deviation = np.array([moments[2 + 2 * i] or 0.0 for i in range(k)])
    kept, scale = deviation > 1e-12, np.where(deviation > 1e-12, deviation, 1.0)
    x = [F.lit(1.0), *[(F.col(f"x{i}") - float(mean[i])) / float(scale[i]) for i in range(k)]]
    penalty = np.array([0.0, *[ridge] * k])

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        z = sum((float(a) * c for a, c in zip(w, x, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - F.col("y") * z
        prepared = rows.select(*[c.alias(f"c{i}") for i, c in enumerate(x)], (F.col("y") - p).alias("e"), (p * (1 - p)).alias("v"), loss.alias("l"))
        pairs = [(i, j) for i in range(k + 1) for j in range(i + 1)]
        got = prepared.agg(F.sum("l"), *[F.sum(F.col("e") * F.col(f"c{i}")) for i in range(k + 1)], *[F.sum(F.col("v") * F.col(f"c{i}") * F.col(f"c{j}")) for i, j in pairs]).first()
        curve = np.zeros((k + 1, k + 1))
        for (i, j), v in zip(pairs, got[k + 2 :], strict=True):
            curve[i, j] = curve[j, i] = v
        return got[0] + 0.5 * float((penalty * w * w).sum()), np.array(got[1 : k + 2]) - penalty * w, curve + np.diag(penalty)

    w, turn, gradient = np.zeros(k + 1), 0, np.zeros(k + 1)
    if n:
        loss, gradient, curve = sums(w)
        while turn < rounds and np.abs(gradient).max() > close * max(1, n):
            turn += 1
            move = np.linalg.lstsq(curve, gradient, rcond=None)[0] * np.array([1.0, *kept])
            for _ in range(30):
                new = sums(w + move)
                if new[0] <= loss + 1e-12 * abs(loss):
                    break
                move = move / 2
            w, (loss, gradient, curve) = w + move, new
    return Logistic(features, w, mean, scale, float(np.abs(gradient).max()) if n else 0.0, turn)


@dataclass
class Axes:
    """Mean and principal axes of a table of vectors, strongest first, with their variances."""

    mean: np.ndarray
    axes: np.ndarray
    variances: np.ndarray
    rows: int


def _vectors(df: DataFrame, ident: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows with a finite vector as long as the longest, and its length."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(ident).alias("id"), F.when(fine, v).alias("v")).filter("id is not null and v is not null")
    dim = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
    return rows.filter((F.size("v") == dim) & (F.size("v") > 0)), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), dim)


def principal_axes(df: DataFrame, ident: str = "vec_id", vector: str = "embedding") -> Axes:
    """Eigenvectors of the covariance, whose sums are made by task and added up by row of the matrix; the driver holds dim x dim numbers.

    Of an axis and its opposite the one whose largest component is positive. Moments are taken about the first moments, so
    a large common offset costs no digits. Rows with a null or non-finite vector or one of another length than the longest take no part.
    """
    rows, dim = _vectors(df, ident, vector)
    if not dim:
        return Axes(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0)
    spark = df.sparkSession

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = np.zeros(dim), 0
        for b in batches:
            s, n = s + _matrix(b["v"], dim).sum(axis=0), n + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(s), pa.array(np.full(dim, n))], names=["i", "s", "n"])

    first = rows.select("v").mapInArrow(totals, "i long, s double, n long").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).orderBy("i").toArrow()
    n = int(first["n"][0].as_py())
    mean = first["s"].to_numpy() / max(1, n)
    sent = spark.sparkContext.broadcast(mean)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b["v"], dim) - sent.value
            m += x.T @ x
        i, j = np.indices((dim, dim)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(m.ravel())], names=["i", "j", "s"])

    second = rows.select("v").mapInArrow(squares, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).orderBy("i", "j").toArrow()
    values, vectors = np.linalg.eigh(second["s"].to_numpy().reshape(dim, dim) / max(1, n - 1))
    axes = vectors.T[::-1]
    axes = axes * np.where(axes[np.arange(dim), np.abs(axes).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    return Axes(mean, axes, np.maximum(values[::-1], 0), n)


def coordinates(df: DataFrame, found: Axes, k: int, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, axis, value): each row's place on the first k axes."""
    rows, dim = _vectors(df, ident, vector)
    sent = df.sparkSession.sparkContext.broadcast((found.mean, found.axes[:k]))
    kind = rows.schema["id"].dataType.simpleString()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes = sent.value
        for b in batches:
            at = (_matrix(b["v"], dim) - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(list(at), pa.list_(pa.float64()))], names=["id", "at"])

    return rows.mapInArrow(placed, f"id {kind}, at array<double>").select("id", F.posexplode("at").alias("axis", "value"))


def grid_coordinates(df: DataFrame, k: int = 2, size: int = 1000, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, axis, cell): coordinates on the first k axes as whole numbers from 0 to size, the 1st and 99th percentile at the ends, what lies beyond clipped.

    An axis without spread has all rows in the middle.
    """
    at = step(coordinates(df, principal_axes(df, ident, vector), k, ident, vector), "coordinates")
    ends = quantiles(at, "value", {"low": 0.01, "high": 0.99}, "axis")
    share = F.when(F.col("high") > F.col("low"), (F.col("value") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.5)
    return at.join(F.broadcast(ends), "axis").select("id", "axis", F.round(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * size).cast("int").alias("cell"))


def axis_novelty(df: DataFrame, residuals: tuple[int, ...] = (10, 50), least: float = 1e-9, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, from_mean, mahalanobis, residual_k ...): how far each row lies from what is usual.

    from_mean is one less the cosine with the mean; mahalanobis weighs each axis by its variance, axes with less than `least`
    of the largest left out; residual_k is what the first k axes leave of the centred vector, as a share of its length.
    A zero vector or mean gives null for from_mean, a row at the mean a residual of 0.
    """
    found = principal_axes(df, ident, vector)
    rows, dim = _vectors(df, ident, vector)
    sent = df.sparkSession.sparkContext.broadcast(found)
    kind = rows.schema["id"].dataType.simpleString()
    names = [f"residual_{k}" for k in residuals]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = sent.value
        use = a.variances > least * a.variances.max(initial=0)
        for b in batches:
            x = _matrix(b["v"], dim)
            at = (x - a.mean) @ a.axes.T
            length = np.sqrt((at * at).sum(axis=1))
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = x @ a.mean / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((a.mean * a.mean).sum()))
                left = [np.where(length > 0, np.sqrt((at[:, k:] ** 2).sum(axis=1)) / length, 0.0) for k in residuals]
            far = np.sqrt((at[:, use] ** 2 / a.variances[use]).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(1 - cosine, mask=~np.isfinite(cosine)), pa.array(far), *map(pa.array, left)], names=["id", "from_mean", "mahalanobis", *names])

    return rows.mapInArrow(measured, f"id {kind}, from_mean double, mahalanobis double, " + ", ".join(f"{n} double" for n in names))
