"""Ranks, percentiles and running values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def average_rank(value: str, *by: str) -> Column:
    """Rank from 1 with ties sharing their mean rank."""
    over = Window.partitionBy(*by)
    return F.rank().over(over.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2


def value_class(value: Column) -> Column:
    """A long that never falls as the number grows: equal for numbers that differ by less than about a billionth; NaN counts as the largest."""
    x = value.cast("double")
    size = F.floor((F.least(F.log2(F.abs(x)), F.lit(1025.0)) + 1100) * 2**30).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(x < 0, -size).otherwise(size)


def _sum_before(count: str, by: list[str], order: str) -> Column:
    return F.coalesce(F.sum(count).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def value_places(df: DataFrame, value: str, *by: str, weight: Column | None = None) -> DataFrame:
    """(by, value, __c, __below, __n): for each number of a group its rows, the rows with smaller ones, and all rows of the group; with a weight, its sums instead.

    Running counts are made in three steps, over coarse classes of the numbers of a group, over fine classes of a coarse one and over the
    numbers of a fine class. By the width of a double each of these windows holds at most some millions of counts, whatever the
    group's size or spread. Null numbers and rows with a null in `by` are left out.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("__c"))
    counts = counts.withColumn("__fine", value_class(F.col(value))).withColumn("__coarse", F.shiftright("__fine", 22))
    fine = counts.groupBy(*by, "__coarse", "__fine").agg(F.sum("__c").alias("__cf"))
    coarse = fine.groupBy(*by, "__coarse").agg(F.sum("__cf").alias("__cc"))
    coarse = coarse.select(*by, "__coarse", _sum_before("__cc", [*by], "__coarse").alias("__bc"), F.sum("__cc").over(Window.partitionBy(*by)).alias("__n"))
    fine = fine.select(*by, "__coarse", "__fine", _sum_before("__cf", [*by, "__coarse"], "__fine").alias("__bf")).join(coarse, [*by, "__coarse"])
    fine = fine.select(*by, "__coarse", "__fine", (F.col("__bc") + F.col("__bf")).alias("__before"), "__n")
    placed = counts.withColumn("__b", _sum_before("__c", [*by, "__coarse", "__fine"], value)).join(fine, [*by, "__coarse", "__fine"])
    return placed.select(*by, value, "__c", (F.col("__before") + F.col("__b")).alias("__below"), "__n")


def with_average_rank(df: DataFrame, value: str, *by: str, name: str = "rank") -> DataFrame:
    """average_rank for many rows to a group: no task holds a group's rows or its distinct values (value_places). Rows with a null value are left out."""
    ranked = value_places(df, value, *by).select(*by, value, (F.col("__below") + (F.col("__c") + 1) / 2).alias(name))
    return df.join(ranked, [*by, value])


def quantiles(df: DataFrame, value: str, at: dict[str, float], *by: str) -> DataFrame:
    """(by, one column for each name in `at`): exact quantiles with linear interpolation, from counts of the values instead of one buffer for a group."""
    placed = value_places(df, value, *by)
    place = {name: (F.col("__n") - 1) * F.lit(q) for name, q in at.items()}
    holds = lambda k: F.max(F.when((F.col("__below") <= k) & (k < F.col("__below") + F.col("__c")), F.col(value)))
    ends = placed.groupBy(*by).agg(F.max("__n").alias("__n"), *[x for name, p in place.items() for x in (holds(F.floor(p)).alias(f"{name}__lo"), holds(F.ceil(p)).alias(f"{name}__hi"))])

    def between(name: str) -> Column:
        low, high, share = F.col(f"{name}__lo"), F.col(f"{name}__hi"), place[name] - F.floor(place[name])
        return F.when(low == high, low.cast("double")).otherwise((1 - share) * low + share * high)

    return ends.select(*by, *[between(name).alias(name) for name in at])


def empirical_percentile(value: str, *by: str) -> Column:
    """0 to 100: the share of rows below, ties counting half."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    return F.when(n > 1, 100 * (average_rank(value, *by) - 1) / (n - 1)).otherwise(50.0)


def previous(by: str, order: list[str], rows: int | None = None) -> Window:
    """The rows before this one in its group: all, or the last `rows`."""
    return Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding if rows is None else -rows, -1)


def upper_median(values: Column) -> Column:
    """Middle of an array; of an even number of values the upper of the two."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def runs(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """Lengths of runs of equal states in each group: one row for each run."""
    whole, same = Window.partitionBy(*by).orderBy(*order), Window.partitionBy(*by, state).orderBy(*order)
    island = F.row_number().over(whole) - F.row_number().over(same)
    return df.withColumn("__island", island).groupBy(*by, state, "__island").agg(F.count(F.lit(1)).alias("length")).drop("__island")


def latest(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each group in the given order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("__n") <= n).drop("__n")
