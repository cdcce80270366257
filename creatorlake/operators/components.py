"""Connected components, and the purge of families that reach over a split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.sources.steps import step


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of these. edges: a > b, once each."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): component is the smallest node that can be reached.

    edges: two columns, both ways meant; loops, repeated edges and edges with a null count for nothing. nodes: more nodes,
    one column; those without edges are components of their own. Large and small stars by turns, a table between rounds:
    the number of rounds grows with the logarithm of the nodes, for long paths too, and no neighbours are gathered.
    """
    x, y = (F.col(c) for c in edges.columns)
    now = step(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "edges")
    print_of = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    was, mark = None, print_of(now)
    while mark != was:
        larger = _large_star(now).filter("a != b").distinct()
        now = step(_small_star(larger).filter("a != b").distinct(), "edges")
        was, mark = mark, print_of(now)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
    if nodes is None:
        return found
    every = nodes.select(F.col(nodes.columns[0]).alias("node")).filter("node is not null").distinct()
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def mutual_edges(neighbours: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: rows that are in each other's list with a score of at least `least`. neighbours: id, other, score."""
    close = neighbours.filter(F.col("score") >= least)
    back = close.select(F.col("id").alias("other"), F.col("other").alias("id"))
    return close.filter("id < other").join(back, ["id", "other"]).select(F.col("id").alias("a"), F.col("other").alias("b")).distinct()


def exact_edges(df: DataFrame, ident: str, key: str) -> DataFrame:
    """(a, b): each row tied to the smallest of those with the same key, so a family of n rows gives n - 1 edges. Null keys tie nothing."""
    least = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(ident).alias("__least"))
    return df.join(least, key).filter(F.col(ident) != F.col("__least")).select(F.col(ident).alias("a"), F.col("__least").alias("b"))


def purged(train: DataFrame, test: DataFrame, families: DataFrame, ident: str) -> DataFrame:
    """The rows of train whose family has no row in test. families: node, component; a row without one is its own family."""
    named = lambda df: df.join(families, df[ident] == families["node"], "left").withColumn("__family", F.coalesce("component", F.col(ident)))
    held = named(test).select("__family").distinct()
    return named(train).join(held, "__family", "left_anti").select(*train.columns)
