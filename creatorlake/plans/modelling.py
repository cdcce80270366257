"""Exact p-values (J), groups over two keys (G), axes and novelty (L), and models fitted by rounds (N)."""

from __future__ import annotations

from pyspark.sql import functions as F

from creatorlake.operators import clusters as K
from creatorlake.operators import components as C
from creatorlake.operators import models as M
from creatorlake.operators import neighbours as N
from creatorlake.operators import special as Z
from creatorlake.operators import statistics as S
from creatorlake.plans.panel import LONG_SQL, METRICS, metric_values, videos
from creatorlake.plans.registry import query
from creatorlake.sources.steps import step

SOLID = "CASE WHEN abs({0}) < 1e-300 THEN 1e-300 ELSE {0} END"


@query(f"""WITH RECURSIVE {LONG_SQL}, r AS (SELECT kind, metric, count(*) AS n, corr(value, target) AS r FROM long JOIN (SELECT video_id, kind FROM videos) USING (video_id) GROUP BY kind, metric),
g AS (SELECT *, (n - 2) / 2.0 AS a0, 0.5 AS b0, (n - 2) / (n - 2 + r * r * (n - 2) / (1 - r * r)) AS x0 FROM r),
s AS (SELECT *, x0 < (a0 + 1) / (a0 + b0 + 2) AS low, CASE WHEN x0 < (a0 + 1) / (a0 + b0 + 2) THEN a0 ELSE b0 END AS a, CASE WHEN x0 < (a0 + 1) / (a0 + b0 + 2) THEN b0 ELSE a0 END AS b, CASE WHEN x0 < (a0 + 1) / (a0 + b0 + 2) THEN x0 ELSE 1 - x0 END AS x FROM g),
f AS (SELECT kind, metric, 0 AS m, a, b, x, 1.0::DOUBLE AS c, 1 / (1 - (a + b) * x / (a + 1)) AS d, 1 / (1 - (a + b) * x / (a + 1)) AS h FROM s
  UNION ALL SELECT kind, metric, m, a, b, x, {SOLID.format('(1 + o / c)')}, 1 / {SOLID.format('(1 + o * d)')}, h * (1 / {SOLID.format('(1 + o * d)')}) * {SOLID.format('(1 + o / c)')} FROM (
    SELECT kind, metric, m, a, b, x, {SOLID.format('(1 + e / c)')} AS c, 1 / {SOLID.format('(1 + e * d)')} AS d, h * (1 / {SOLID.format('(1 + e * d)')}) * {SOLID.format('(1 + e / c)')} AS h, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)) AS o FROM (
      SELECT kind, metric, m + 1 AS m, a, b, x, c, d, h, (m + 1) * (b - m - 1) * x / ((a + 2 * m + 1) * (a + 2 * m + 2)) AS e FROM f WHERE m < 300)))
SELECT s.kind, s.metric, s.n, round(r, 6) AS r, round(CASE WHEN low THEN v ELSE 1 - v END, 9) AS p FROM (
  SELECT s.*, exp(lgamma(a0 + b0) - lgamma(a0) - lgamma(b0) + a0 * ln(x0) + b0 * ln(1 - x0)) * h / s.a AS v FROM s JOIN f ON f.kind = s.kind AND f.metric = s.metric AND f.m = 300) s""")
def j3_t_p_values(table):
    """Two-tailed p of each metric's correlation with the outcome within each kind, by the incomplete beta function."""
    rows = metric_values(table).join(videos(table).select("video_id", "kind"), "video_id")
    r = step(S.pearson(rows, ["kind", "metric"]).select("kind", "metric", "n", "r"), "correlations")
    # a rounded r in the same select would be what the lambdas read
    p = r.withColumn("p", Z.correlation_p_value(F.col("r"), F.col("n")))
    return p.select("kind", "metric", "n", F.round("r", 6).alias("r"), F.round("p", 9).alias("p"))


@query("""WITH t AS (SELECT p_brand, count(*) FILTER (WHERE l_returnflag = 'R') AS a, count(*) FILTER (WHERE l_returnflag <> 'R') AS b FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand),
f AS (SELECT p_brand, a, b, sum(a) OVER () - a AS c, sum(b) OVER () - b AS d FROM t), g AS (SELECT *, a + b AS r, a + c AS k, a + b + c + d AS n FROM f),
w AS (SELECT p_brand, r, k, n, a, unnest(range(greatest(0, r + k - n)::BIGINT, least(r, k)::BIGINT + 1)) AS x FROM g),
l AS (SELECT *, -(lgamma(x + 1) + lgamma(r - x + 1) + lgamma(k - x + 1) + lgamma(n - r - k + x + 1)) AS w, -(lgamma(a + 1) + lgamma(r - a + 1) + lgamma(k - a + 1) + lgamma(n - r - k + a + 1)) AS own,
  lgamma(r + 1) + lgamma(n - r + 1) + lgamma(k + 1) + lgamma(n - k + 1) - lgamma(n + 1) AS m FROM w)
SELECT p_brand, round(least(1, sum(exp(w + m)) FILTER (WHERE w <= own + 1e-7)), 7) AS p FROM l GROUP BY p_brand""")
def j24_fisher_exact(table):
    """Whether a brand's lines come back more or less often than the others': the exact p of each fourfold table."""
    lines = table("lineitem").join(table("part"), F.col("p_partkey") == F.col("l_partkey"))
    back = F.count_if(F.col("l_returnflag") == "R").alias("a"), F.count_if(F.col("l_returnflag") != "R").alias("b")
    t = step(lines.groupBy("p_brand").agg(*back), "tables")
    whole = t.agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"))
    return t.join(F.broadcast(whole)).select("p_brand", F.round(Z.fisher_p_value(F.col("a"), F.col("b"), F.col("sa") - F.col("a"), F.col("sb") - F.col("b")), 7).alias("p"))


@query("""WITH RECURSIVE k AS (SELECT DISTINCT conv_id, trim(lower(text)) AS key FROM conversations), e AS (SELECT DISTINCT a.conv_id AS a, b.conv_id AS b FROM k a JOIN k b USING (key) WHERE a.conv_id <> b.conv_id),
reach AS (SELECT DISTINCT conv_id AS node, conv_id AS seen FROM k UNION SELECT node, e.b FROM reach JOIN e ON e.a = seen) SELECT node AS conv_id, min(seen) AS source_group FROM reach GROUP BY node""")
def g23_source_groups(table):
    """Conversations that share a canonical text, or share one with others that do, are one group."""
    c = table("conversations").select("conv_id", F.sha2(F.trim(F.lower("text")), 256).alias("key")).distinct()
    found = C.connected_components(C.exact_edges(c, "conv_id", "key"), c.select("conv_id"))
    return found.select(F.col("node").alias("conv_id"), F.col("component").alias("source_group"))


@query()
def l18_projection_grid(table):
    """The vectors on their two strongest axes, as cells of a grid of 1,000 by 1,000."""
    return M.grid_coordinates(table("embeddings")).select(F.col("id").alias("vec_id"), "axis", "cell")


@query()
def l4_novelty_family(table):
    """How new each vector is: to the mean, the axes, its nearest 5, 15 and 50 rows, and the middle of its niche among 8 and 25."""
    e = table("embeddings")
    near = N.cosine_neighbours(e, 50).groupBy("id").agg(*[(1 - F.avg(F.when(F.col("rank") <= k, F.col("score")))).alias(f"nearest_{k}") for k in (5, 15, 50)])
    niche = [K.spherical_kmeans(e, k, 5).assigned.select("id", (1 - F.col("score")).alias(f"niche_{k}")) for k in (8, 25)]
    out = M.axis_novelty(e).join(near, "id").join(niche[0], "id").join(niche[1], "id")
    return out.select(F.col("id").alias("vec_id"), *[F.round(c, 6).alias(c) for c in out.columns if c != "id"])


@query()
def n15_logistic_model(table):
    """The probability that a video is above the mean of all, from its metrics, and what it was."""
    v = step(videos(table).select("video_id", "views", *METRICS), "videos")
    mean = v.agg(F.avg("views").alias("mean"))
    rows = v.join(F.broadcast(mean)).withColumn("high", (F.col("views") > F.col("mean")).cast("int"))
    fitted = M.logistic_model(rows, METRICS, "high")
    return rows.select("video_id", F.round(fitted.probability(), 6).alias("probability"), "high")
