"""Whole-number vectors: their matrices from Arrow columns, and inner products that are exact at any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component as long; null for a null vector or one with a null or non-finite component.

    A component that doesn't fit a long ends the query with an error that says so.
    """
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    wide = F.exists(x, lambda v: F.abs(v) * scale >= float(2**63))
    return F.when(~fine, None).when(wide, F.raise_error(F.lit("a vector's component doesn't fit a long")).cast("array<long>")).otherwise(F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def int_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as int64 rows, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact products of the int64 rows of a with those of b, as int64.

    Doubles where no sum can pass 2**53, int64 where none can pass 2**63, else Python integers; a product that doesn't
    fit a long raises an OverflowError.
    """
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = max(abs(int(a.max())), abs(int(a.min()))) * max(abs(int(b.max())), abs(int(b.min()))) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    if exact.max() >= 2**63 or exact.min() < -(2**63):
        raise OverflowError("an inner product doesn't fit a long")
    return exact.astype(np.int64)
