"""Time, curves and vectors (C, D, E, F, I, J, L, N, S)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creatorlake.operators import windows as W
from creatorlake.plans.curves import CURVES_SQL, curves
from creatorlake.plans.panel import VIDEOS_SQL, videos
from creatorlake.plans.registry import query

ROTATION = ["F", "O", "P"]
DIMS_SQL = "x AS (SELECT vec_id, label, unnest(range(len(embedding)))::INT AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def dims(table):
    return table("embeddings").select("vec_id", "label", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"WITH {VIDEOS_SQL} SELECT video_id, (SELECT 1) * (count(*) OVER (PARTITION BY source ORDER BY epoch(published) RANGE BETWEEN UNBOUNDED PRECEDING AND 604800 PRECEDING) - count(*) OVER (PARTITION BY source, kind ORDER BY epoch(published) RANGE BETWEEN UNBOUNDED PRECEDING AND 604800 PRECEDING)) AS support FROM videos")
def c17_observable_support(table):
    """Earlier videos of the creator whose outcome was known a week after they came out, less those of the same family; no row meets another."""
    week, t = 7 * 86_400, F.unix_timestamp(F.col("published").cast("timestamp"))
    seen = lambda *by: F.count(F.lit(1)).over(Window.partitionBy(*by).orderBy("t").rangeBetween(Window.unboundedPreceding, -week))
    return videos(table).withColumn("t", t).select("video_id", (seen("source") - seen("source", "kind")).alias("support"))


@query("SELECT p_brand, count(DISTINCT l_orderkey) AS videos, round(count(DISTINCT l_orderkey) / (SELECT count(*) FROM orders), 6) AS prevalence FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def d11_prevalence(table):
    """Share of the videos that each mechanism is in."""
    pair = table("lineitem").join(table("part"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "l_orderkey").distinct()
    total = table("orders").agg(F.count(F.lit(1)).alias("total"))
    by = pair.groupBy("p_brand").agg(F.count(F.lit(1)).alias("videos"))
    return by.join(F.broadcast(total), F.lit(True)).select("p_brand", "videos", F.round(F.col("videos") / F.col("total"), 6).alias("prevalence"))


@query(f"WITH {VIDEOS_SQL}, m AS (SELECT kind, avg(views) AS guess FROM videos GROUP BY kind), a AS (SELECT c_mktsegment AS account, views, guess FROM videos JOIN m USING (kind) JOIN customer ON c_custkey = source) SELECT account, count(*) AS n, round(avg(abs(views - guess)), 4) AS mae, round(sqrt(avg(power(views - guess, 2))), 4) AS rmse, round(avg(guess - views), 4) AS bias FROM a GROUP BY 1")
def d19_evaluation_by_account(table):
    v = videos(table)
    p = v.join(F.broadcast(v.groupBy("kind").agg(F.avg("views").alias("guess"))), "kind").join(table("customer"), F.col("c_custkey") == F.col("source"))
    e = F.col("guess") - F.col("views")
    return p.groupBy(F.col("c_mktsegment").alias("account")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 4).alias("mae"), F.round(F.sqrt(F.avg(e * e)), 4).alias("rmse"), F.round(F.avg(e), 4).alias("bias"))


@query("SELECT user_id, count(*) AS sessions FROM events WHERE ts >= (SELECT date_trunc('week', max(ts)) FROM events) GROUP BY 1")
def d23_since_week_start(table):
    e = table("events")
    start = e.agg(F.date_trunc("week", F.max("ts")).alias("start"))
    return e.join(F.broadcast(start), F.col("ts") >= F.col("start")).groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"))


@query("WITH l AS (SELECT list(a ORDER BY a) AS ladder FROM (SELECT avg(c_acctbal) AS a FROM customer GROUP BY c_nationkey)) SELECT s_suppkey, round(100.0 * len(list_filter(ladder, lambda x: x <= s_acctbal)) / len(ladder), 6) AS pct FROM supplier CROSS JOIN l")
def e4_ladder_rank(table):
    """Percent rank on a frozen ladder of one step for each nation."""
    ladder = table("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("a")).agg(F.sort_array(F.collect_list("a")).alias("ladder"))
    below = F.size(F.filter("ladder", lambda x: x <= F.col("s_acctbal")))
    return table("supplier").join(F.broadcast(ladder), F.lit(True)).select("s_suppkey", F.round(100.0 * below / F.size("ladder"), 6).alias("pct"))


@query("WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders), l AS (SELECT o_custkey, max(r) AS sessions, bool_and(l_quantity >= 10) AS hit, max(l_extendedprice) AS best FROM s JOIN lineitem ON l_orderkey = o_orderkey WHERE r <= 2 GROUP BY 1) SELECT o_custkey, round(best + CASE WHEN hit AND sessions = 2 THEN 5 ELSE 0 END, 2) AS next FROM l")
def e11_progression(table):
    """Five more if every set of the last two sessions reached the repetitions, else the same again."""
    last = W.latest(table("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 2).select("o_custkey", "o_orderkey")
    sets = last.join(table("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    r = sets.groupBy("o_custkey").agg(F.bool_and(F.col("l_quantity") >= 10).alias("hit"), F.max("l_extendedprice").alias("best"), F.min("o_orderkey").alias("a"), F.max("o_orderkey").alias("b"))
    newest = W.latest(table("orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1).select("o_custkey", F.col("o_orderkey").alias("newest"))
    both = (F.col("a") != F.col("b")) | (F.col("a") != F.col("newest"))  # the older one took part
    return r.join(newest, "o_custkey").select("o_custkey", F.round(F.col("best") + F.when(F.col("hit") & both, 5).otherwise(0), 2).alias("next"))


@query("WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS s FROM orders GROUP BY 1) SELECT o_custkey, ['F', 'O', 'P'][list_position(['F', 'O', 'P'], s) % 3 + 1] AS next FROM l")
def e12_next_in_rotation(table):
    last = table("orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s"))
    plan = F.array(*map(F.lit, ROTATION))
    return last.select("o_custkey", F.get(plan, (F.array_position(plan, F.col("s")) % len(ROTATION)).cast("int")).alias("next"))


@query("SELECT year(o_orderdate) || 'Q' || quarter(o_orderdate) AS label, count(*) AS n FROM orders GROUP BY 1")
def e14_quarter_label(table):
    at = F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    return table("orders").groupBy(F.concat(F.year(at).cast("string"), F.lit("Q"), F.quarter(at).cast("string")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DIMS_SQL}, m AS (SELECT label AS month, dim, sum(x) AS s, count(*) AS n FROM x GROUP BY 1, 2) SELECT month, dim, round(sum(s) OVER w / sum(n) OVER w, 6) AS earlier FROM m WINDOW w AS (PARTITION BY dim ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def e15_prior_centroid(table):
    """Centroid of all strictly earlier months, from one sum for each month; the label stands for the month."""
    m = dims(table).groupBy(F.col("label").alias("month"), "dim").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("dim").orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return m.select("month", "dim", F.round(F.sum("s").over(w) / F.sum("n").over(w), 6).alias("earlier"))


@query("""WITH d AS (SELECT day, (row_number() OVER (ORDER BY day) - 1) / count(*) OVER () AS p FROM (SELECT DISTINCT o_orderdate AS day FROM orders)),
r AS (SELECT o_custkey AS family, CASE WHEN p < 0.5 THEN -1 ELSE least(floor((p - 0.5) * 8), 3) END::INT AS block FROM orders JOIN d ON day = o_orderdate),
f AS (SELECT unnest([0, 1, 2, 3])::INT AS fold)
SELECT fold, (SELECT count(*) FROM r WHERE block = fold) AS n_test, (SELECT count(*) FROM r WHERE block < fold AND family NOT IN (SELECT family FROM r t WHERE t.block = fold)) AS n_train FROM f""")
def e18_forward_folds(table):
    """Half of the distinct times to learn from, then four blocks; of what is earlier than a block, families in it are left out."""
    days = table("orders").select(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day")).distinct()
    p = W.value_places(days, "day").select("day", (F.col("__below") / F.col("__n")).alias("p"))
    block = F.when(F.col("p") < 0.5, -1).otherwise(F.least(F.floor((F.col("p") - 0.5) * 8), F.lit(3))).cast("int")
    rows = table("orders").join(p, F.col("day") == F.unix_micros(F.col("o_orderdate").cast("timestamp"))).select(F.col("o_custkey").alias("family"), block.alias("block"))
    by = rows.groupBy("family").agg(*[F.count_if(F.col("block") == b).alias(f"b{b + 1}") for b in range(-1, 4)])
    fold = lambda k: F.struct(F.lit(k).alias("fold"), F.col(f"b{k + 1}").alias("test"), F.when(F.col(f"b{k + 1}") == 0, sum((F.col(f"b{i}") for i in range(1, k + 1)), F.col("b0"))).otherwise(0).alias("train"))
    return by.select(F.explode(F.array(*map(fold, range(4)))).alias("f")).groupBy("f.fold").agg(F.sum("f.test").alias("n_test"), F.sum("f.train").alias("n_train"))


@query(f"WITH {DIMS_SQL}, c AS (SELECT label, dim, round(avg(x), 9) AS m FROM x GROUP BY 1, 2), d AS (SELECT x.label, vec_id, round(sum((x - m) * (x - m)), 9) AS d FROM x JOIN c USING (label, dim) GROUP BY 1, 2) SELECT label, vec_id, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS r FROM d) WHERE r <= 3")
def f6_central_examples(table):
    """The three rows nearest to their cluster's centroid."""
    x = dims(table)
    c = x.groupBy("label", "dim").agg(F.round(F.avg("x"), 9).alias("m"))
    gap = (F.col("x") - F.col("m")) * (F.col("x") - F.col("m"))
    d = x.join(F.broadcast(c), ["label", "dim"]).groupBy("label", "vec_id").agg(F.round(F.sum(gap), 9).alias("d"))
    rank = F.row_number().over(Window.partitionBy("label").orderBy("d", "vec_id"))
    return d.withColumn("rank", rank).filter("rank <= 3").select("label", "vec_id", "rank")


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) <= 10")
def f10_balanced_sample(table):
    return W.latest(table("embeddings").select("label", "vec_id"), ["label"], [F.md5(F.col("vec_id").cast("string")), F.col("vec_id")], 10)


@query("SELECT o_orderkey, c_mktsegment = 'BUILDING' AS owned FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P' ORDER BY owned DESC, o_orderdate, o_orderkey LIMIT 50")
def f11_pending_work(table):
    """Own work first, then the oldest, 50 at most."""
    o = table("orders").filter("o_orderstatus = 'P'").join(table("customer"), F.col("c_custkey") == F.col("o_custkey")).withColumn("owned", F.col("c_mktsegment") == "BUILDING")
    return o.orderBy(F.desc("owned"), "o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "owned")


@query(f"WITH {CURVES_SQL} SELECT user_id, c[4] AS at_3, c[51] AS at_half, c[100] AS at_end FROM curve")
def i1_curve_points(table):
    c = F.col("c")
    return curves(table).select("user_id", c[3].alias("at_3"), F.get("c", F.least(F.floor(F.lit(0.5) * F.size("c")), F.size("c") - 1).cast("int")).alias("at_half"), F.element_at("c", -1).alias("at_end"))


@query("""WITH s AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY 1 HAVING count(*) >= 20 AND max(epoch_us(ts)) > min(epoch_us(ts))),
p AS (SELECT user_id, (epoch_us(ts) - a) * 99.0::DOUBLE / (b - a) AS x, value AS y, event_id FROM events JOIN s USING (user_id)),
l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY x, event_id)),
g AS (SELECT user_id, x, y, x2, y2, unnest(CASE WHEN x2 IS NULL THEN [99] ELSE range(ceil(x)::BIGINT, ceil(x2)::BIGINT) END) AS i FROM l)
SELECT user_id, i::INT AS i, round(CASE WHEN x2 IS NULL THEN y ELSE y + (y2 - y) * (i - x) / (x2 - x) END, 6) AS v FROM g""")
def i2_resampled_curve(table):
    """An irregular curve of 20 points or more on a grid of 100, between neighbours on a straight line: each interval makes its own grid points."""
    e = table("events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    s = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b"), F.count(F.lit(1)).alias("k")).filter("k >= 20 and b > a")
    w = Window.partitionBy("user_id").orderBy("x", "event_id")
    p = e.join(s, "user_id").select("user_id", "event_id", ((F.col("t") - F.col("a")) * 99.0 / (F.col("b") - F.col("a"))).alias("x"), F.col("value").alias("y"))
    p = p.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w))
    first, last = F.ceil("x").cast("int"), F.ceil("x2").cast("int") - 1
    grid = F.when(F.col("x2").isNull(), F.array(F.lit(99))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    line = F.col("y") + (F.col("y2") - F.col("y")) * (F.col("i") - F.col("x")) / (F.col("x2") - F.col("x"))
    return p.withColumn("i", F.explode(grid)).select("user_id", "i", F.round(F.when(F.col("x2").isNull(), F.col("y")).otherwise(line), 6).alias("v"))


@query(f"WITH {CURVES_SQL} SELECT user_id, round(list_sum(c), 6) AS raw, round(list_sum(c) / nullif(c[1], 0), 6) AS by_entry, round(list_sum(c) - 100 * c[100], 6) AS over_terminal, round((list_sum(c) - 100 * c[100]) / nullif(c[1] - c[100], 0), 6) AS affine FROM curve")
def i6_normalised_families(table):
    """Area of a curve as it is, as a share of its entry, above its terminal value, and with both ends fixed."""
    c = curves(table).select("user_id", F.col("c")[0].alias("a"), F.element_at("c", -1).alias("z"), F.aggregate("c", F.lit(0.0), lambda s, x: s + x).alias("s"))
    a, z, s = F.col("a"), F.col("z"), F.col("s")
    none = lambda x: F.when(x != 0, x)
    return c.select("user_id", F.round(s, 6).alias("raw"), F.round(s / none(a), 6).alias("by_entry"), F.round(s - 100 * z, 6).alias("over_terminal"), F.round((s - 100 * z) / none(a - z), 6).alias("affine"))


@query(f"WITH {CURVES_SQL}, k AS (SELECT user_id, c, CASE WHEN c[1] > 1 AND c[1] <> c[100] THEN (c[1] - 1) / (c[1] - c[100]) ELSE 0 END AS f FROM curve) SELECT user_id, round(c[1] - f * (c[1] - c[100]), 6) AS entry, round(c[51] - f * (c[51] - c[100]), 6) AS middle, round(c[100], 6) AS terminal FROM k")
def i7_rewatch_correction(table):
    """What the entry has above 1 goes, in proportion to what is left above the terminal value."""
    c = curves(table)
    a, z = F.col("c")[0], F.element_at("c", -1)
    f = F.when((a > 1) & (a != z), (a - 1) / (a - z)).otherwise(0.0)
    right = lambda x: F.round(x - f * (x - z), 6)
    return c.select("user_id", right(a).alias("entry"), right(F.col("c")[50]).alias("middle"), F.round(z, 6).alias("terminal"))


@query(f"WITH {CURVES_SQL}, w AS (SELECT unnest([0, 10, 30, 60])::INT AS a, unnest([10, 30, 60, 99])::INT AS b) SELECT user_id, a, b, round((c[b + 1] - c[a + 1]) / (b - a), 9) AS slope FROM curve CROSS JOIN w")
def i14_slope_matrix(table):
    spec = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 10), (10, 30), (30, 60), (60, 99))])
    x = curves(table).select("user_id", "c", F.explode(spec).alias("w")).select("user_id", "c", "w.*")
    return x.select("user_id", "a", "b", F.round((F.get("c", F.col("b")) - F.get("c", F.col("a"))) / (F.col("b") - F.col("a")), 9).alias("slope"))


@query(f"""WITH {VIDEOS_SQL}, v AS (SELECT source, views, kind = '1-URGENT' AS m FROM videos), t AS (SELECT avg(views) FILTER (WHERE m) AS m1, avg(views) FILTER (WHERE NOT m) AS m0, count(*) FILTER (WHERE m) AS n1, count(*) FILTER (WHERE NOT m) AS n0 FROM v),
g AS (SELECT sum(CASE WHEN m THEN (views - m1) / n1 ELSE -(views - m0) / n0 END) AS s FROM v CROSS JOIN t GROUP BY source)
SELECT round((SELECT m1 - m0 FROM t), 4) AS difference, round(sqrt(sum(s * s)), 4) AS error, count(*) AS clusters FROM g""")
def j22_cluster_robust_difference(table):
    """Difference of two means with the sandwich error over clusters: sums of each cluster, then one row."""
    v = videos(table).select("source", "views", (F.col("kind") == "1-URGENT").alias("m"))
    one, zero = F.when(F.col("m"), F.col("views")), F.when(~F.col("m"), F.col("views"))
    t = v.agg(F.avg(one).alias("m1"), F.avg(zero).alias("m0"), F.count(one).alias("n1"), F.count(zero).alias("n0"))
    part = F.when(F.col("m"), (F.col("views") - F.col("m1")) / F.col("n1")).otherwise(-(F.col("views") - F.col("m0")) / F.col("n0"))
    g = v.join(F.broadcast(t), F.lit(True)).groupBy("source").agg(F.sum(part).alias("s"), F.first("m1").alias("m1"), F.first("m0").alias("m0"))
    return g.agg(F.round(F.first("m1") - F.first("m0"), 4).alias("difference"), F.round(F.sqrt(F.sum(F.col("s") * F.col("s"))), 4).alias("error"), F.count(F.lit(1)).alias("clusters"))


@query("WITH c AS (SELECT lang AS a, source AS b, sum(n_chars) AS w FROM documents GROUP BY 1, 2), t AS (SELECT *, sum(w) OVER (PARTITION BY a) AS wa, sum(w) OVER (PARTITION BY b) AS wb, sum(w) OVER () AS total FROM c) SELECT round(sum(w / total * ln(w * total / (wa * wb))), 6) AS information, round(-sum(w / total * ln(w / wa)), 6) AS b_given_a, round(-sum(w / total * ln(w / wb)), 6) AS a_given_b FROM t WHERE w > 0")
def l10_weighted_contingency(table):
    """Mutual information and both conditional entropies of two partitions whose rows have weights."""
    c = table("documents").groupBy(F.col("lang").alias("a"), F.col("source").alias("b")).agg(F.sum("n_chars").cast("double").alias("w")).filter("w > 0")
    over = lambda *by: F.sum("w").over(Window.partitionBy(*by))
    t = c.withColumn("wa", over("a")).withColumn("wb", over("b")).withColumn("total", over())
    p, log = F.col("w") / F.col("total"), F.log
    return t.agg(F.round(F.sum(p * log(F.col("w") * F.col("total") / (F.col("wa") * F.col("wb")))), 6).alias("information"), F.round(-F.sum(p * log(F.col("w") / F.col("wa"))), 6).alias("b_given_a"), F.round(-F.sum(p * log(F.col("w") / F.col("wb"))), 6).alias("a_given_b"))


@query("WITH c AS (SELECT lang, count(*) AS n, count(DISTINCT source) AS k FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT round(sum(n * k) / (sum(n) * (SELECT count(DISTINCT source) FROM documents)), 6) AS generality FROM c")
def l27_generality(table):
    """Share of the groups that a cluster holds, over clusters by their size."""
    pair = table("documents").filter("source is not null").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    c = pair.groupBy("lang").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    groups = pair.select("source").distinct().agg(F.count(F.lit(1)).alias("groups"))
    return c.join(F.broadcast(groups), F.lit(True)).agg(F.round(F.sum(F.col("n") * F.col("k")) / (F.sum("n") * F.first("groups")), 6).alias("generality"))


@query(f"WITH {DIMS_SQL}, p AS (SELECT vec_id, x - avg(x) OVER (PARTITION BY label, dim ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM x) SELECT vec_id, round(sqrt(sum(d * d)), 5) AS departure FROM p GROUP BY 1")
def n19_delta_from_earlier(table):
    """Length of a vector less the mean of its creator's earlier ones; null for the first."""
    w = Window.partitionBy("label", "dim").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)
    d = dims(table).select("vec_id", (F.col("x") - F.avg("x").over(w)).alias("d"))
    return d.groupBy("vec_id").agg(F.round(F.sqrt(F.sum(F.col("d") * F.col("d"))), 5).alias("departure"))


@query("SELECT o_orderkey, o_orderstatus, n IS NULL OR n < 2 AS removed FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1) ON l_orderkey = o_orderkey")
def s4_recheck(table):
    """Stored rows against what is found now: those that aren't there any more are marked, none is deleted."""
    now = table("lineitem").filter("l_linestatus = 'O'").groupBy("l_orderkey").count()
    return table("orders").join(now, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", "o_orderstatus", (F.col("count").isNull() | (F.col("count") < 2)).alias("removed"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def s5_missing_keys(table):
    """What a component store has still to process."""
    return table("documents").select("doc_id").join(table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def s8_last_progress_events(table):
    return W.latest(table("events").select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 20).select("user_id", "event_id")
