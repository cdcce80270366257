"""Graphs and families (G), groupings and vectors (L), folds (N), sequences (O), event-time windows (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from creatorlake.operators import graphs as G
from creatorlake.operators import partitions as P
from creatorlake.operators.experiments import order_in_metric
from creatorlake.plans.registry import query


@query("WITH c AS (SELECT o_custkey AS k, 1 AS prio FROM orders UNION ALL SELECT c_custkey, 2 FROM customer) SELECT k, min(prio) AS prio FROM c GROUP BY k")
def g1_ordered_merge(table):
    a = table("orders").select(F.col("o_custkey").alias("k"), F.lit(1).alias("prio"))
    return a.union(table("customer").select("c_custkey", F.lit(2))).groupBy("k").agg(F.min("prio").alias("prio"))


@query("SELECT family, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha256(concat_ws('|', CASE WHEN length(trim(lower(text))) >= 20 THEN trim(lower(text)) ELSE source END, round(n_chars / 15.0)::BIGINT::VARCHAR)) AS family FROM documents) GROUP BY family")
def g2_content_family(table):
    d = table("documents").select("doc_id", G.content_family(F.col("text"), F.col("source"), F.col("n_chars") / 15.0).alias("family"))
    return d.groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT count(*) - count(DISTINCT text) AS repeated FROM documents")
def g6_duplicate_count(table):
    return table("documents").agg((F.count(F.lit(1)) - F.countDistinct("text")).alias("repeated"))


EDGES = "e AS (SELECT DISTINCT p_brand AS a, l_returnflag || l_linestatus AS b FROM lineitem JOIN part ON p_partkey = l_partkey)"


@query(f"WITH {EDGES}, nb AS (SELECT a AS node, b AS other FROM e UNION SELECT b, a FROM e) SELECT node, count(*) AS degree, list_sort(list(other)) AS others FROM nb GROUP BY node")
def g10_neighbour_sets(table):
    e = table("lineitem").join(table("part"), F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("a"), F.concat("l_returnflag", "l_linestatus").alias("b")).distinct()
    return G.neighbours(e).groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sort_array(F.collect_list("other")).alias("others"))


HOPS = "f AS (SELECT c_mktsegment AS a, o_orderpriority AS b, avg(o_totalprice) / 100000 - 1.5 AS r FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2), s AS (SELECT o_orderpriority AS a, o_orderstatus AS b, avg(o_totalprice) / 100000 - 2.5 AS r FROM orders GROUP BY 1, 2)"


def hops(table):
    o = table("orders")
    mean = lambda off: (F.avg("o_totalprice") / 100000 - off).alias("r")
    first = o.join(table("customer"), F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("a"), F.col("o_orderpriority").alias("b")).agg(mean(1.5))
    return first, o.groupBy(F.col("o_orderpriority").alias("a"), F.col("o_orderstatus").alias("b")).agg(mean(2.5))


@query(f"WITH {HOPS} SELECT f.a, f.b, s.b AS c, round(CASE WHEN f.r * s.r < 0 THEN cbrt(abs(f.r * s.r)) / 2 ELSE cbrt(abs(f.r * s.r)) END, 6) AS strength FROM f JOIN s ON f.b = s.a")
def g14_two_hop_paths(table):
    return G.two_hop_paths(*hops(table)).select("a", "b", "c", F.round("strength", 6).alias("strength"))


@query(f"WITH {HOPS} SELECT a, round(avg(abs(r)) * (1 + log2(count(*))), 6) AS score, count(*) AS n FROM f GROUP BY a")
def g13_target_predictors(table):
    return G.predictors(hops(table)[0]).select("a", F.round("score", 6).alias("score"), "n")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def g21_principle_gaps(table):
    """Documents that no label speaks for."""
    return table("documents").select("doc_id").join(table("labels").select("doc_id"), "doc_id", "left_anti")


@query("WITH n AS (SELECT vec_id, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS s, embedding FROM embeddings) SELECT vec_id, round(s, 6) AS length, round(embedding[1]::DOUBLE / s, 6) AS first_unit FROM n")
def l1_unit_vectors(table):
    v = F.col("embedding").cast("array<double>")
    return table("embeddings").select("vec_id", F.round(P.norm(v), 6).alias("length"), F.round(P.unit(v)[0], 6).alias("first_unit"))


CONT = "c AS (SELECT lang AS a, source AS b, count(*) AS n FROM documents GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS total FROM c)"


@query(f"WITH {CONT}, t AS (SELECT sum(n/total * ln((n/total) / ((na/total) * (nb/total)))) AS mi, -sum(n/total * ln(na/total)) AS ha, -sum(n/total * ln(nb/total)) AS hb FROM m) SELECT round(2 * mi / (ha + hb), 6) AS nmi, round(ha + hb - 2 * mi, 6) AS vi FROM t")
def l8_partition_transport(table):
    return P.transport(table("documents"), "lang", "source").select(F.round("nmi", 6).alias("nmi"), F.round("vi", 6).alias("vi"))


@query(f"WITH {CONT}, t AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM c) AS cells, (SELECT sum(na * (na - 1) / 2.0) FROM (SELECT DISTINCT a, na FROM m)) AS sa, (SELECT sum(nb * (nb - 1) / 2.0) FROM (SELECT DISTINCT b, nb FROM m)) AS sb, (SELECT max(total) * (max(total) - 1) / 2.0 FROM m) AS everything) SELECT round((cells - sa * sb / everything) / ((sa + sb) / 2 - sa * sb / everything), 6) AS ari FROM t")
def l9_adjusted_rand(table):
    return P.adjusted_rand(table("documents"), "lang", "source").select(F.round("ari", 6).alias("ari"))


@query(f"WITH {CONT} SELECT a, b, n, round(n / na, 6) AS share, round(n / (na + nb - n), 6) AS jaccard FROM m QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) <= 3")
def j47_strongest_links(table):
    return P.strongest_links(table("documents"), "lang", "source").select("a", "b", "n", F.round("share", 6).alias("share"), F.round("jaccard", 6).alias("jaccard"))


@query("WITH x AS (SELECT label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, dim, round(avg(x), 6) AS mean FROM x GROUP BY 1, 2")
def l13_centroids(table):
    v = table("embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))
    return P.centroids(v, "label", "embedding").select("label", "dim", F.round("mean", 6).alias("mean"))


@query("SELECT source, (row_number() OVER (ORDER BY sha256(source), source) - 1) % 5 AS fold FROM (SELECT DISTINCT source FROM documents)")
def n6_group_folds(table):
    """The distinct groups are numbered by their digest, read as two numbers of 52 bits."""
    digits = lambda i: F.conv(F.substring(F.sha2("source", 256), i, 13), 16, 10).cast("long")
    g = table("documents").filter("source is not null").select("source").distinct().select("source", F.lit(0).alias("metric"), digits(1).alias("value"), digits(14).alias("video_id"))
    return order_in_metric(g).select("source", (F.col("place") % 5).cast("long").alias("fold"))


@query("WITH e AS (SELECT o_orderpriority AS g, avg(o_totalprice - 150000) AS res FROM orders GROUP BY 1) SELECT o_orderkey, round(o_totalprice - 150000 - res, 4) AS adjusted FROM orders JOIN e ON g = o_orderpriority")
def n26_group_residual_adjustment(table):
    o = table("orders").withColumn("e", F.col("o_totalprice") - 150000)
    return o.join(F.broadcast(o.groupBy("o_orderpriority").agg(F.avg("e").alias("res"))), "o_orderpriority").select("o_orderkey", F.round(F.col("e") - F.col("res"), 4).alias("adjusted"))


@query("WITH b AS (SELECT user_id, floor(epoch(ts) / 86400)::BIGINT AS day, event_type FROM events GROUP BY 1, 2, 3) SELECT x.event_type AS a, y.event_type AS b, count(*) AS n FROM b x JOIN b y ON x.user_id = y.user_id AND x.day = y.day AND x.event_type < y.event_type GROUP BY 1, 2")
def o12_bucket_cooccurrence(table):
    b = table("events").select("user_id", F.to_date("ts").alias("day"), "event_type").distinct()
    other = b.withColumnRenamed("event_type", "b")
    return b.join(other, ["user_id", "day"]).filter(F.col("event_type") < F.col("b")).groupBy(F.col("event_type").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


@query("WITH w AS (SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS w, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, max(n) AS busiest, round(var_pop(n), 6) AS variance FROM w GROUP BY user_id")
def s10_tumbling_rates(table):
    w = table("events").groupBy("user_id", F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("user_id").agg(F.max("n").alias("busiest"), F.round(F.var_pop("n"), 6).alias("variance"))


@query("WITH s AS (SELECT user_id, to_timestamp(floor(epoch(ts) / 1800) * 1800 - k * 1800) AS w FROM events, (SELECT unnest([0, 1]) AS k)), c AS (SELECT user_id, w, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, max(n) AS busiest FROM c GROUP BY user_id")
def s9_sliding_maximum(table):
    return table("events").groupBy("user_id", F.window("ts", "1 hour", "30 minutes")).agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(F.max("n").alias("busiest"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 3600000000 THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM g), c AS (SELECT user_id, session, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id")
def s11_gap_sessions(table):
    s = table("events").groupBy("user_id", F.session_window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))
