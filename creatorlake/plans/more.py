"""Further operators of the families above, each over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creatorlake.functions import arrays as A
from creatorlake.operators import experiments as X
from creatorlake.operators import partitions as P
from creatorlake.operators import statistics as S
from creatorlake.plans.curves import CURVES_SQL, curves
from creatorlake.plans.panel import LONG_SQL, PLACED_SQL, VIDEOS_SQL, bucket_sql, metric_values, videos
from creatorlake.plans.registry import query


@query(f"WITH {VIDEOS_SQL} SELECT count(*) AS n, round(sum(quantity * discount), 6) AS dot FROM videos WHERE isfinite(quantity) AND isfinite(discount)")
def c1_metric_vector_join(table):
    """Two metric vectors joined on the video, rows that aren't finite left out."""
    m = metric_values(table).filter(S.finite("value"))
    a = m.filter("metric = 'quantity'").select("video_id", F.col("value").alias("a"))
    b = m.filter("metric = 'discount'").select("video_id", F.col("value").alias("b"))
    return a.join(b, "video_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("a") * F.col("b")), 6).alias("dot"))


@query("SELECT o_orderkey, n_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1")
def c4_reference_join(table):
    return table("orders").join(table("customer"), F.col("c_custkey") == F.col("o_custkey")).join(table("nation").filter("n_regionkey = 1"), F.col("n_nationkey") == F.col("c_nationkey")).select("o_orderkey", "n_name")


@query("SELECT n_name, r_name, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1, 2 HAVING count(*) >= 5")
def c13_catalog_link_join(table):
    both = table("customer").join(table("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    return both.groupBy("n_name", "r_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("balance")).filter("n >= 5")


@query("WITH e AS (SELECT event_id, ((props::JSON)->>'k')::INT AS k FROM events) SELECT k, count(*) AS n, max(event_id) AS newest FROM e WHERE k IS NOT NULL GROUP BY k")
def c18_ledger_entries(table):
    k = F.get_json_object("props", "$.k").cast("int")
    return table("events").select("event_id", k.alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("newest"))


@query(f"WITH {VIDEOS_SQL}, p AS (SELECT source, views, avg(views) OVER (PARTITION BY kind) AS guess FROM videos) SELECT source, count(*) AS n, round(avg(abs(guess - views)), 4) AS mae, round(avg(guess - views), 4) AS bias FROM p GROUP BY source")
def d15_source_prediction_summary(table):
    v = videos(table)
    p = v.join(F.broadcast(v.groupBy("kind").agg(F.avg("views").alias("guess"))), "kind")
    e = F.col("guess") - F.col("views")
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.avg(e), 4).alias("bias"))


@query(f"WITH {VIDEOS_SQL} SELECT floor(date_diff('day', published, TIMESTAMP '2000-01-01') / 365.0)::INT AS cohort, count(*) AS n, round(avg(views), 4) AS mean, CASE WHEN count(*) > 1 THEN round(corr(quantity, views), 6) END AS r FROM videos GROUP BY 1")
def d16_age_cohorts(table):
    cohort = F.floor(F.datediff(F.to_date(F.lit("2000-01-01")), "published") / 365).cast("int")
    return videos(table).groupBy(cohort.alias("cohort")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("views"), 4).alias("mean"), F.round(F.corr("quantity", "views"), 6).alias("r"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2")
def d17_status_tally(table):
    return table("orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, l_orderkey, l_linenumber, i FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_quantity DESC, l_orderkey, l_linenumber) AS i FROM lineitem) WHERE i <= 3")
def d22_personal_records(table):
    order = [F.desc("l_extendedprice"), F.desc("l_quantity"), F.col("l_orderkey"), F.col("l_linenumber")]
    i = F.row_number().over(Window.partitionBy("l_partkey").orderBy(*order))
    return table("lineitem").withColumn("i", i.cast("long")).filter("i <= 3").select("l_partkey", "l_orderkey", "l_linenumber", "i")


@query("SELECT user_id, ts::DATE AS day, max(value) AS best, count(*) AS n FROM events GROUP BY 1, 2")
def d24_progress_series(table):
    return table("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias("best"), F.count(F.lit(1)).alias("n"))


@query("WITH b AS (SELECT DISTINCT l_orderkey AS d, l_returnflag || l_linestatus AS c FROM lineitem), p AS (SELECT x.d, x.c AS a, y.c AS b FROM b x JOIN b y ON x.d = y.d AND x.c < y.c), n AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2) SELECT d, round(avg(1.0 / (n + 1)), 8) AS rarity FROM p JOIN n USING (a, b) GROUP BY d")
def d26_cooccurrence_rarity(table):
    b = table("lineitem").select(F.col("l_orderkey").alias("d"), F.concat("l_returnflag", "l_linestatus").alias("a")).distinct()
    p = b.join(b.withColumnRenamed("a", "b"), "d").filter("a < b")
    return p.join(p.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), ["a", "b"]).groupBy("d").agg(F.round(F.avg(1.0 / (F.col("n") + 1)), 8).alias("rarity"))


@query("WITH n AS (SELECT *, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS block FROM orders) SELECT o_orderkey, block FROM n WHERE NOT EXISTS (SELECT 1 FROM n m WHERE m.o_custkey = n.o_custkey AND m.o_orderpriority = n.o_orderpriority AND m.block > n.block)")
def e17_chronological_splits(table):
    """Four blocks of each creator in time, without rows whose family comes again in a later block."""
    n = table("orders").withColumn("block", F.ntile(4).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
    last = F.max("block").over(Window.partitionBy("o_custkey", "o_orderpriority"))
    return n.withColumn("last", last).filter("block = last").select("o_orderkey", "block")


@query(f"WITH {LONG_SQL}, r AS (SELECT metric, corr(value, target) AS r FROM long GROUP BY metric) SELECT a.metric AS pre, b.metric AS post, round(abs(a.r * b.r), 8) AS strength FROM r a, r b WHERE a.metric IN ('lines', 'quantity') AND b.metric IN ('discount', 'price', 'tax') ORDER BY abs(a.r * b.r) DESC LIMIT 4")
def f3_cross_layer_pairs(table):
    """A top-k report over the metrics, not over rows."""
    r = metric_values(table).groupBy("metric").agg(F.corr("value", "target").alias("r"))
    pre, post = r.filter(F.col("metric").isin("lines", "quantity")).select(F.col("metric").alias("pre"), F.col("r").alias("p")), r.filter(F.col("metric").isin("discount", "price", "tax")).select(F.col("metric").alias("post"), F.col("r").alias("q"))
    both = pre.join(F.broadcast(post.agg(F.collect_list(F.struct("post", "q")).alias("x")))).select("pre", "p", F.inline("x"))
    return both.orderBy(F.desc(F.abs(F.col("p") * F.col("q")))).limit(4).select("pre", "post", F.round(F.abs(F.col("p") * F.col("q")), 8).alias("strength"))


@query("WITH f AS (SELECT regexp_replace(p_name || '_' || p_size, '[_0-9#]+$', '') AS family, p_name || '_' || p_size AS key, p_retailprice AS r FROM part) SELECT family, arg_max(key, (r, key)) AS best, count(*) AS n, min(r) AS low, max(r) AS high FROM f GROUP BY family")
def g11_family_collapse(table):
    key = F.concat("p_name", F.lit("_"), F.col("p_size").cast("string"))
    f = table("part").select(F.regexp_replace(key, "[_0-9#]+$", "").alias("family"), key.alias("key"), F.col("p_retailprice").alias("r"))
    return f.groupBy("family").agg(F.max_by("key", F.struct("r", "key")).alias("best"), F.count(F.lit(1)).alias("n"), F.min("r").alias("low"), F.max("r").alias("high"))


@query(f"WITH {LONG_SQL}, r AS (SELECT kind, metric, corr(value, target) AS r FROM long JOIN (SELECT video_id, kind FROM videos) USING (video_id) GROUP BY 1, 2) SELECT metric, arg_max(kind, abs(r)) AS best_kind, round(max(abs(r)), 6) AS strength, count(*) AS edges FROM r GROUP BY metric")
def g15_best_edge(table):
    r = metric_values(table).join(videos(table).select("video_id", "kind"), "video_id").groupBy("kind", "metric").agg(F.corr("value", "target").alias("r"))
    return r.groupBy("metric").agg(F.max_by("kind", F.abs("r")).alias("best_kind"), F.round(F.max(F.abs("r")), 6).alias("strength"), F.count(F.lit(1)).alias("edges"))


@query("SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT AS seed FROM documents")
def h16_stable_hash(table):
    return table("documents").select("doc_id", F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long").alias("seed"))


@query("SELECT o_orderkey, o_orderdate::DATE AS compact, o_orderdate::DATE AS iso FROM orders")
def h18_date_parsing(table):
    o = table("orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("a"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("b"))
    parse = lambda c: F.to_date(F.coalesce(F.try_to_timestamp(F.col(c), F.lit("yyyyMMdd")), F.try_to_timestamp(F.col(c), F.lit("yyyy-MM-dd"))))
    return o.select("o_orderkey", parse("a").alias("compact"), parse("b").alias("iso"))


@query(f"WITH {CURVES_SQL} SELECT user_id, round(c[13] + (c[14] - c[13]) * 0.5, 9) AS at_12_5 FROM curve")
def i3_retention_at_second(table):
    """Between two points of the curve, on the line that joins them."""
    return curves(table).select("user_id", F.round(A.at(F.col("c"), 12) + (A.at(F.col("c"), 13) - A.at(F.col("c"), 12)) * 0.5, 9).alias("at_12_5"))


@query(f"WITH {CURVES_SQL} SELECT user_id, round(list_avg(c[1:5]), 9) AS mean5, round(list_max(c[1:5]), 9) AS peak, (list_position(c[1:5], list_max(c[1:5])) - 1)::BIGINT AS peak_at, round(c[5] - c[1], 9) AS delta, round(list_max(c[1:5]) - list_min(c[1:5]), 9) AS spread, round((2 * (c[5] - c[1]) + c[4] - c[2]) / 10, 9) AS slope FROM curve")
def i16_first_seconds(table):
    head = F.slice("c", 1, 5)
    # least squares over five equal steps
    slope = F.aggregate(F.transform(head, lambda x, i: x * (i - 2)), F.lit(0.0), lambda s, x: s + x) / 10
    return curves(table).select("user_id", F.round(A.mean(head), 9).alias("mean5"), F.round(F.array_max(head), 9).alias("peak"), (F.array_position(head, F.array_max(head)) - 1).alias("peak_at"), F.round(F.col("c")[4] - F.col("c")[0], 9).alias("delta"), F.round(F.array_max(head) - F.array_min(head), 9).alias("spread"), F.round(slope, 9).alias("slope"))


@query(f"WITH {CURVES_SQL} SELECT user_id, round(list_avg(c[1:33]), 9) AS front, round(list_avg(c[68:100]), 9) AS back FROM curve")
def i17_third_means(table):
    return curves(table).select("user_id", F.round(A.mean(A.part(F.col("c"), 0, 33)), 9).alias("front"), F.round(A.mean(A.part(F.col("c"), 67)), 9).alias("back"))


@query(f"WITH {VIDEOS_SQL}, p AS (SELECT a.source, sign(a.quantity - b.quantity) = sign(a.views - b.views) AS hit FROM videos a JOIN videos b ON a.source = b.source AND a.video_id < b.video_id WHERE a.views <> b.views AND a.quantity <> b.quantity) SELECT source, count(*) AS pairs, round(avg(hit::INT), 6) AS accuracy FROM p GROUP BY source")
def j36_pairwise_accuracy(table):
    v = videos(table).select("source", "video_id", "quantity", "views")
    w = v.select("source", *[F.col(c).alias(f"{c}_b") for c in ("video_id", "quantity", "views")])
    p = v.join(w, "source").filter("video_id < video_id_b and views <> views_b and quantity <> quantity_b")
    hit = F.signum(F.col("quantity") - F.col("quantity_b")) == F.signum(F.col("views") - F.col("views_b"))
    return p.groupBy("source").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg(hit.cast("int")), 6).alias("accuracy"))


@query(f"WITH {PLACED_SQL}, g AS (SELECT metric, target, value, {bucket_sql(4)} AS b FROM placed), s AS (SELECT metric, avg(target) FILTER (b = 3) AS m1, avg(target) FILTER (b = 0) AS m0, var_samp(target) FILTER (b = 3) AS v1, var_samp(target) FILTER (b = 0) AS v0, count(*) FILTER (b = 3) AS n1, count(*) FILTER (b = 0) AS n0 FROM g GROUP BY metric) SELECT metric, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM s")
def k11_regime_gap(table):
    b = X.buckets(metric_values(table), 4).filter("bucket in (0, 3)").withColumn("top", (F.col("bucket") == 3).cast("int"))
    return S.cohens_d(b, ["metric"], "top", "target").select("metric", F.round("d", 6).alias("d"))


@query("SELECT e.vec_id, round(list_inner_product(e.embedding::DOUBLE[], f.embedding::DOUBLE[]) / sqrt(list_inner_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_inner_product(f.embedding::DOUBLE[], f.embedding::DOUBLE[])), 6) AS coherence FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1")
def l7_vector_coherence(table):
    v = table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    both = v.join(w, "vec_id")
    return both.select("vec_id", F.round(A.total(F.zip_with("a", "b", lambda x, y: x * y)) / (P.norm(F.col("a")) * P.norm(F.col("b"))), 6).alias("coherence"))


@query("WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT lang, n / sum(n) OVER (PARTITION BY lang) AS p FROM c) SELECT lang, round(-sum(p * ln(p)), 6) AS entropy, count(*) AS groups, round(count(*) / (SELECT count(DISTINCT source) FROM documents), 6) AS generality FROM s GROUP BY lang")
def l26_entropy_and_generality(table):
    c = P.contingency(table("documents"), "lang", "source")
    p = F.col("n") / F.col("na")
    kinds = F.broadcast(table("documents").agg(F.countDistinct("source").alias("all_sources")))
    return c.groupBy(F.col("a").alias("lang")).agg(F.round(-F.sum(p * F.ln(p)), 6).alias("entropy"), F.count(F.lit(1)).alias("groups")).join(kinds).select("lang", "entropy", "groups", F.round(F.col("groups") / F.col("all_sources"), 6).alias("generality"))


@query("""WITH o AS (SELECT o_orderkey, (o_orderstatus = 'F')::INT AS y, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place, rank() OVER (ORDER BY o_totalprice) - 1 AS mid, count(*) OVER () AS n FROM orders),
c AS (SELECT place, sum(y) OVER (ORDER BY place) AS s FROM o), b AS (SELECT o_orderkey, greatest(mid - greatest(1, n // 20), 0) AS low, least(mid + greatest(1, n // 20), n) AS high FROM o)
SELECT o_orderkey, round((h.s - coalesce(l.s, 0)) / (high - low), 6) AS rate FROM b JOIN c h ON h.place = high - 1 LEFT JOIN c l ON l.place = low - 1""")
def n13_local_rate(table):
    """The share of finished orders among those whose price ranks within 5 % of an order's own."""
    o = table("orders").select("o_orderkey", "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"))
    return X.local_rate(o, "o_orderkey", "o_totalprice", "y").select("o_orderkey", F.round("rate", 6).alias("rate"))


@query("WITH p AS (SELECT user_id, min(ts) AS at FROM events GROUP BY user_id), c AS (SELECT e.user_id, e.event_id, e.value, abs(epoch_us(e.ts) - epoch_us(p.at) - 259200000000) AS off FROM events e JOIN p USING (user_id) WHERE abs(epoch_us(e.ts) - epoch_us(p.at) - 259200000000) <= 129600000000) SELECT user_id, arg_min(value, (off, event_id)) AS outcome FROM c GROUP BY user_id")
def s2_fixed_horizon_outcome(table):
    """The observation nearest to three days after the first, within 36 hours."""
    e = table("events").select("user_id", "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    first = e.groupBy("user_id").agg(F.min("t").alias("at"))
    off = F.abs(F.col("t") - F.col("at") - 259_200_000_000)
    return e.join(first, "user_id").withColumn("off", off).filter("off <= 129600000000").groupBy("user_id").agg(F.min_by("value", F.struct("off", "event_id")).alias("outcome"))


@query("WITH w AS (SELECT user_id, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS w, count(*) AS n FROM events GROUP BY 1, 2) SELECT user_id, count(*) AS weeks, max(n) AS best, round(max(n) / (min(n) + 1), 6) AS ratio FROM w GROUP BY user_id")
def s12_week_windows(table):
    w = table("events").groupBy("user_id", F.window("ts", "7 days")).agg(F.count(F.lit(1)).alias("n"))
    return w.groupBy("user_id").agg(F.count(F.lit(1)).alias("weeks"), F.max("n").alias("best"), F.round(F.max("n") / (F.min("n") + 1), 6).alias("ratio"))
