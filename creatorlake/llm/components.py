"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.llm.common import looked_up, written


def components(links: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node reachable. links has columns a and b of one type; nodes without a link are left out.

    Large stars and small stars by turns: each node hangs its larger, then its smaller neighbours on the smallest of
    them, until nothing changes. Minima are aggregated in part before the shuffle, and those of the few nodes with very
    many links go to the links, so no task gets all links of a node. Each round is a written table.
    """
    pairs = links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs, before = written(pairs, "links"), None
    while True:
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v"), F.col("v")).distinct())
        before = state
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("times"))
        large = written(looked_up(both.filter(F.col("v") > F.col("u")), least, "u", "times", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("times"))
        small = looked_up(large, smallest, "u", "times", state[0]).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = written(small.union(smallest.select("u", "m")).distinct(), "links")
