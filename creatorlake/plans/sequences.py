"""Cuts of sequences (O) and the causal decomposition of a growing one (S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creatorlake.operators import sequences as Q
from creatorlake.plans.curves import CURVES_SQL, curves
from creatorlake.plans.registry import query
from creatorlake.streaming.decomposition import decomposed

MOST = 5
PARTITION_SQL = f"""{CURVES_SQL}, m AS (SELECT user_id, i, v - avg(v) OVER (PARTITION BY user_id) AS x FROM pts),
s AS (SELECT user_id, i + 1 AS i, sum(x) OVER w AS s, sum(x * x) OVER w AS ss FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i) UNION ALL SELECT user_id, 0, 0, 0 FROM span),
cost AS (SELECT a.user_id, a.i AS a, b.i AS b, greatest(b.ss - a.ss - (b.s - a.s) ** 2 / (b.i - a.i), 0) AS c FROM s a JOIN s b ON a.user_id = b.user_id AND a.i < b.i),
p1 AS (SELECT user_id, b, c FROM cost WHERE a = 0)""" + "".join(
    f", p{k} AS (SELECT user_id, cost.b, min(p.c + cost.c) AS c FROM p{k - 1} p JOIN cost USING (user_id) WHERE cost.a = p.b GROUP BY 1, 2)" for k in range(2, MOST + 1)
)


@query(f"WITH {PARTITION_SQL} " + " UNION ALL ".join(f"SELECT user_id, {k}::INT AS segments, round(c, 6) AS cost FROM p{k} WHERE b = 100" for k in range(1, MOST + 1)))
def o3_optimal_partitions(table):
    """The least squared error of each curve in one to five segments."""
    return Q.optimal_partitions(curves(table), "user_id", "c", MOST).select("user_id", "segments", F.round("cost", 6).alias("cost"))


def value_steps(table):
    """(user_id, pos, distance): how far each event's value lies from the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table("events").select("user_id", (F.row_number().over(w) - 1).cast("long").alias("pos"), F.round(F.abs(F.col("value") - F.lag("value").over(w)), 6).alias("distance"))


@query("""WITH d AS (SELECT user_id, row_number() OVER w - 1 AS pos, round(abs(value - lag(value) OVER w), 6) AS distance FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
p AS (SELECT user_id, pos, (2 + count(*) OVER () - rank() OVER (ORDER BY distance))::DOUBLE / (count(*) OVER () + 1) AS p FROM d WHERE distance IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p) AS k, count(*) OVER (PARTITION BY user_id) AS m FROM p),
q AS (SELECT *, least(1, min(p * m / k) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r),
s AS (SELECT d.user_id, d.pos, coalesce(sum((q.q <= 0.25)::INT) OVER (PARTITION BY d.user_id ORDER BY d.pos), 0) AS segment FROM d LEFT JOIN q USING (user_id, pos))
SELECT user_id, segment::BIGINT AS segment, min(pos)::BIGINT AS first, max(pos)::BIGINT AS last, count(*) AS n FROM s GROUP BY user_id, segment""")
def o5_change_point_segments(table):
    """A user's events between the steps that stand out among all steps of the corpus."""
    steps = value_steps(table)
    cuts = Q.change_points(steps, "user_id", "pos", "distance", 0.25).filter("cut")
    return Q.segments(steps.select("user_id", "pos"), cuts, "user_id", "pos")


@query()
def s6_causal_components(table):
    """Events as tokens of a user's sequence: a boundary is the likelier the longer nothing came before, clicks are words."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    seconds = F.coalesce(gap / 1e6, F.lit(0.0))
    e = table("events").select("user_id", (F.row_number().over(w) - 1).alias("pos"), (seconds / (seconds + 3600)).alias("boundary"), (F.col("event_type") == "click").alias("word"))
    return decomposed(e, "user_id", 24, 6, 8)
