"""Arithmetic on array<double> columns with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int) -> Column:
    """x to so many digits as DuckDB rounds it: x times a power of ten, halves away from zero; the sign of a zero stays.

    Spark's own round takes the decimal digits that a double prints, and has no negative zero.
    """
    y = x * float(10**digits)
    return F.when(F.abs(y) < float("inf"), F.signum(y) * F.round(F.abs(y)) / float(10**digits)).otherwise(x)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def mean(a: Column) -> Column:
    """Null for an empty array."""
    return F.when(F.size(a) > 0, total(a) / F.size(a))


def part(a: Column, start: int, end: int | None = None) -> Column:
    """Elements start to end - 1, from 0; end None: to the last."""
    return F.slice(a, start + 1, F.greatest(F.lit(0), (F.size(a) if end is None else F.least(F.size(a), F.lit(end))) - start))


def at(a: Column, i: int) -> Column:
    return F.get(a, F.lit(i))


def steps(a: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(a, 2, F.greatest(F.lit(0), F.size(a) - 1)), F.slice(a, 1, F.greatest(F.lit(0), F.size(a) - 1)), lambda y, x: y - x)


def variance(a: Column) -> Column:
    m = mean(a)
    return mean(F.transform(a, lambda x: (x - m) * (x - m)))


def skew(a: Column) -> Column:
    m, v = mean(a), variance(a)
    return F.when(v > 0, mean(F.transform(a, lambda x: F.pow(x - m, 3))) / F.pow(v, 1.5)).otherwise(0.0)


def entropy(a: Column) -> Column:
    """Bits of the shares of absolute values."""
    s = total(F.transform(a, F.abs))
    return -total(F.transform(F.filter(a, lambda x: x != 0), lambda x: F.abs(x) / s * F.log2(F.abs(x) / s)))


def slope(a: Column) -> Column:
    """Least-squares slope over the index."""
    n, m = F.size(a), mean(a)
    mid = (n - 1) / 2
    return total(F.transform(a, lambda x, i: (i - mid) * (x - m))) / F.when(n > 1, (n * (n * n - 1)) / 12)


def count(a: Column, test) -> Column:
    return F.size(F.filter(a, test))


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true in an array<boolean>."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    step = lambda s, f: F.struct(F.when(f, s["now"] + 1).otherwise(0).alias("now"), F.greatest(s["best"], F.when(f, s["now"] + 1).otherwise(0)).alias("best"))
    return F.aggregate(flags, start, step, lambda s: s["best"])


def gini(a: Column) -> Column:
    s = F.sort_array(a)
    n = F.size(a)
    return F.when(total(a) > 0, total(F.transform(s, lambda x, i: (2 * (i + 1) - n - 1) * x)) / (n * total(a))).otherwise(0.0)
