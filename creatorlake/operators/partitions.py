"""Comparing groupings of the same rows, and vectors by group. Contingency tables are aggregated first; all else reads those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n, na, nb, total) for each pair of labels that occurs."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias(name))
    return cells.join(side("a", "na"), "a").join(side("b", "nb"), "b").join(F.broadcast(cells.agg(F.sum("n").alias("total"))))


def transport(df: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information and variation of information, in nats."""
    c = contingency(df, a, b)
    p, pa, pb = F.col("n") / F.col("total"), F.col("na") / F.col("total"), F.col("nb") / F.col("total")
    sums = c.agg(F.sum(p * F.ln(p / (pa * pb))).alias("mi"), (-F.sum(p * F.ln(pa))).alias("ha"), (-F.sum(p * F.ln(pb))).alias("hb"))
    return sums.select(F.when(F.col("ha") + F.col("hb") > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"), (F.col("ha") + F.col("hb") - 2 * F.col("mi")).alias("vi"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    two = lambda x: F.col(x).cast("double") * (F.col(x) - 1) / 2
    c = contingency(df, a, b)
    side = lambda k, n, out: c.groupBy(k).agg(F.first(n).alias(n)).agg(F.sum(two(n)).alias(out))
    t = c.agg(F.sum(two("n")).alias("cells"), F.first(two("total")).alias("all")).join(side("a", "na", "sa")).join(side("b", "nb", "sb"))
    chance = F.col("sa") * F.col("sb") / F.col("all")
    return t.select(((F.col("cells") - chance) / ((F.col("sa") + F.col("sb")) / 2 - chance)).alias("ari"))


def strongest_links(df: DataFrame, a: str, b: str, k: int = 3) -> DataFrame:
    """Each label of a and its k largest shares in b, with the Jaccard of the two groups."""
    from creatorlake.operators.windows import latest

    c = contingency(df, a, b).select("a", "b", "n", (F.col("n") / F.col("na")).alias("share"), (F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))
    return latest(c, ["a"], [F.desc("n"), F.col("b")], k)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean): means by position, added up in part before the shuffle."""
    return df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg("x").alias("mean"))


def norm(v):
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def unit(v):
    """v over its length; a zero vector stays."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)
