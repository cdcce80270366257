"""Bootstrap and permutation by hash: each replicate is a column of weights or signs that follows from the key alone.

Rows are aggregated to one partial sum for each replicate inside the tasks; nothing is gathered or shuffled but those sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POISSON = (0.367879, 0.735759, 0.919699, 0.981012, 0.99634, 0.999406)  # cumulative, mean 1


def uniform(key: list[str], replicate: Column) -> Column:
    """A number in [0, 1) that depends on the key and the replicate only."""
    return F.pmod(F.xxhash64(*key, replicate), F.lit(1_000_003)) / 1_000_003


def poisson_weight(key: list[str], replicate: Column) -> Column:
    u = uniform(key, replicate)
    out = F.lit(0)
    for p in POISSON:
        out = out + (u >= p).cast("int")
    return out


def bootstrap_mean(df: DataFrame, by: list[str], value: str, unit: list[str], replicates: int = 200) -> DataFrame:
    """Mean and its 95 percent interval for each group; rows of one unit are drawn together, so a unit finer than a row gives a row bootstrap.

    Values are summed up by unit before they meet the replicates.
    """
    sums = df.filter(F.col(value).isNotNull()).groupBy(*dict.fromkeys([*by, *unit])).agg(F.sum(value).alias("__s"), F.count(value).alias("__c"))
    drawn = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("__b")).withColumn("__w", poisson_weight(unit, F.col("__b")))
    per = drawn.groupBy(*by, "__b").agg((F.sum(F.col("__w") * F.col("__s")) / F.nullif(F.sum(F.col("__w") * F.col("__c")), F.lit(0))).alias("__m"))
    edges = per.groupBy(*by).agg(F.percentile("__m", F.array(F.lit(0.025), F.lit(0.975))).alias("__q"))
    mean = sums.groupBy(*by).agg((F.sum("__s") / F.sum("__c")).alias("mean"))
    return mean.join(edges, by).select(*by, "mean", F.col("__q")[0].alias("low"), F.col("__q")[1].alias("high"))


def sign_flip(df: DataFrame, by: list[str], unit: str, value: str, replicates: int = 500) -> DataFrame:
    """Two-sided p of the mean of unit sums against random signs of the units."""
    sums = df.groupBy(*dict.fromkeys([*by, unit])).agg(F.sum(value).alias("__s"))
    flipped = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("__b"))
    per = flipped.groupBy(*by, "__b").agg(F.abs(F.sum(F.when(uniform([unit], F.col("__b")) < 0.5, F.col("__s")).otherwise(-F.col("__s")))).alias("__t"))
    real = sums.groupBy(*by).agg(F.abs(F.sum("__s")).alias("__r"))
    return per.join(real, by).groupBy(*by).agg(((F.count_if(F.col("__t") >= F.col("__r")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))
