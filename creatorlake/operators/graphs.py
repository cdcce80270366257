"""Families, metric graphs and their paths, as joins and aggregates over edge tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_family(text: Column, title: Column, duration: Column) -> Column:
    """Hash of the text if it has 20 characters or more, else of the title, with the rounded duration."""
    t = F.trim(F.lower(F.coalesce(text, F.lit(""))))
    return F.sha2(F.concat_ws("|", F.when(F.length(t) >= 20, t).otherwise(F.coalesce(title, F.lit(""))), F.round(duration).cast("long").cast("string")), 256)


def neighbours(edges: DataFrame) -> DataFrame:
    """(node, other), both ways, each once."""
    return edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct()


def two_hop_paths(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, b, c, strength): the cube root of the product's size, halved where the signs differ."""
    paths = first.select("a", "b", F.col("r").alias("r1")).join(second.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("r").alias("r2")), "b")
    size = F.cbrt(F.abs(F.col("r1") * F.col("r2")))
    return paths.select("a", "b", "c", F.when(F.col("r1") * F.col("r2") < 0, size / 2).otherwise(size).alias("strength"))


def predictors(edges: DataFrame) -> DataFrame:
    """(a, score, n): mean strength of a node's edges, raised by the logarithm of how many there are."""
    s = edges.groupBy("a").agg(F.avg(F.abs("r")).alias("m"), F.count(F.lit(1)).alias("n"))
    return s.select("a", (F.col("m") * (1 + F.log2("n"))).alias("score"), "n")
