"""The creator panel on the given tables: an order is a published video, its customer the creator, its price the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creatorlake.operators.experiments import unpivoted

METRICS = ["lines", "quantity", "price", "discount", "tax"]

VIDEOS_SQL = """
videos AS (
  SELECT o_orderkey AS video_id, o_custkey AS source, o_orderdate AS published, o_totalprice AS views, o_orderstatus AS status, o_orderpriority AS kind,
         l.lines, l.quantity, l.price, l.discount, l.tax
  FROM orders JOIN (
    SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS discount, round(avg(l_tax), 6) AS tax
    FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o_orderkey
)"""

LONG_SQL = (
    VIDEOS_SQL
    + """, long AS (
  """
    + " UNION ALL ".join(f"SELECT video_id, '{m}' AS metric, {m}::DOUBLE AS value, log10(views + 1) AS target FROM videos" for m in METRICS)
    + ")"
)

#: place (from 0) and n of each metric's rows, and equal buckets whose last takes the rest
PLACED_SQL = LONG_SQL + """, placed AS (
  SELECT *, row_number() OVER (PARTITION BY metric ORDER BY value, video_id) - 1 AS place, count(*) OVER (PARTITION BY metric) AS n FROM long
)"""


def bucket_sql(k: int) -> str:
    return f"least(place // (n // {k}), {k - 1})"


def videos(table) -> DataFrame:
    items = table("lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"),
        F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.avg("l_tax"), 6).alias("tax"),
    )
    o = table("orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("source"), F.col("o_orderdate").alias("published"), F.col("o_totalprice").alias("views"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"))
    return o.join(items, o["video_id"] == items["l_orderkey"]).drop("l_orderkey")


def metric_values(table) -> DataFrame:
    return unpivoted(videos(table), "video_id", METRICS, F.log10(F.col("views") + 1))
