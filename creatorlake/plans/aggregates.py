"""Grouped aggregation, windows, order and sampling (D, E, F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creatorlake.functions import text as T
from creatorlake.operators import experiments as X
from creatorlake.operators import windows as W
from creatorlake.plans.panel import LONG_SQL, VIDEOS_SQL, metric_values, videos
from creatorlake.plans.registry import query
from creatorlake.sources.steps import step


@query("SELECT l_shipmode_like AS category, round(sum(v), 2) AS spend, round(sum(v) / sum(sum(v)) OVER (), 6) AS share, round(sum(v) FILTER (l_discount >= 0.05), 2) AS reduced FROM (SELECT l_returnflag || l_linestatus AS l_shipmode_like, l_extendedprice AS v, l_discount FROM lineitem) GROUP BY 1")
def d1_spend_by_category(table):
    rows = table("lineitem").withColumn("category", F.concat("l_returnflag", "l_linestatus"))
    sums = rows.groupBy("category").agg(F.sum("l_extendedprice").alias("s"), F.round(F.sum(F.when(F.col("l_discount") >= 0.05, F.col("l_extendedprice"))), 2).alias("reduced"))
    return sums.select("category", F.round("s", 2).alias("spend"), F.round(F.col("s") / F.sum("s").over(Window.partitionBy()), 6).alias("share"), "reduced")


@query("SELECT c_mktsegment, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) WHERE i <= 3")
def d2_top3_per_group(table):
    return W.latest(table("customer"), ["c_mktsegment"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_mktsegment", "c_custkey", "c_acctbal")


@query("SELECT least(greatest(floor(log10(o_totalprice)), 3), 5)::INTEGER AS decade, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1")
def d3_magnitude_histogram(table):
    return table("orders").filter("o_totalprice > 0").groupBy(F.least(F.greatest(F.floor(F.log10("o_totalprice")), F.lit(3)), F.lit(5)).cast("int").alias("decade")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n, count(text) AS stored, sum(octet_length(encode(coalesce(text, '')))) AS bytes, count(*) FILTER (n_chars >= 3 * (SELECT median(n_chars) FROM documents)) AS outliers FROM documents")
def d4_corpus_statistics(table):
    d = table("documents")
    mid = F.broadcast(W.quantiles(d.select("n_chars"), "n_chars", {"mid": 0.5}))
    return d.select("n_chars", F.octet_length("text").alias("b")).join(mid).agg(F.count(F.lit(1)).alias("n"), F.count("b").alias("stored"), F.sum(F.coalesce("b", F.lit(0))).cast("decimal(38,0)").alias("bytes"), F.count_if(F.col("n_chars") >= 3 * F.col("mid")).alias("outliers"))


@query(f"WITH {VIDEOS_SQL} SELECT CASE WHEN quantity < 20 THEN 0 WHEN quantity < 60 THEN 1 WHEN quantity < 120 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(quantile_cont(views, 0.25), 6) AS p25, round(median(views), 6) AS p50, round(quantile_cont(views, 0.75), 6) AS p75 FROM videos GROUP BY 1")
def d5_binned_quantiles(table):
    q = F.col("quantity")
    v = videos(table).select("views", F.when(q < 20, 0).when(q < 60, 1).when(q < 120, 2).otherwise(3).alias("bin"))
    p = W.quantiles(v, "views", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, "bin")
    return v.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(p, "bin", "left").select("bin", "n", *[F.round(c, 6).alias(c) for c in ("p25", "p50", "p75")])


@query(f"WITH {VIDEOS_SQL}, q AS (SELECT quantile_cont(quantity, 0.25) AS a, median(quantity) AS b, quantile_cont(quantity, 0.75) AS c FROM videos) SELECT (quantity > a)::INT + (quantity > b)::INT + (quantity > c)::INT AS bin, count(*) AS n, round(median(views), 3) AS mid FROM videos, q GROUP BY 1")
def d6_quantile_bins(table):
    v = videos(table).select("quantity", "views")
    edges = F.broadcast(W.quantiles(v, "quantity", {"a": 0.25, "b": 0.5, "c": 0.75}))
    binned = v.join(edges).select("views", sum((F.col("quantity") > F.col(e)).cast("int") for e in "abc").alias("bin"))
    mid = W.quantiles(binned, "views", {"mid": 0.5}, "bin")
    return binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).join(mid, "bin", "left").select("bin", "n", F.round("mid", 3).alias("mid"))


@query(f"WITH {VIDEOS_SQL}, q AS (SELECT median(quantity) AS a, median(discount) AS b FROM videos) SELECT (quantity > a)::INT AS qa, (discount > b)::INT AS qb, count(*) AS n, round(median(views), 3) AS mid FROM videos, q GROUP BY CUBE (1, 2)")
def d7_two_way_grid(table):
    v = step(videos(table).select("quantity", "discount", "views"), "videos")
    sides = v.select(F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).cast("double").alias("x")) for c in ("quantity", "discount")])).alias("s")).select("s.side", "s.x")
    of = lambda c: F.max(F.when(F.col("side") == c, F.col("mid")))
    mid = F.broadcast(step(W.quantiles(sides, "x", {"mid": 0.5}, "side").agg(of("quantity").alias("a"), of("discount").alias("b")), "medians"))
    g = v.join(mid).select((F.col("quantity") > F.col("a")).cast("int").alias("qa"), (F.col("discount") > F.col("b")).cast("int").alias("qb"), "views")
    # -1 stands for any: the four sets of the cube
    cells = [(a, b) for a in (F.col("qa"), F.lit(-1)) for b in (F.col("qb"), F.lit(-1))]
    each = g.select("views", F.explode(F.array(*[F.struct(a.alias("qa"), b.alias("qb")) for a, b in cells])).alias("c")).select("views", "c.qa", "c.qb")
    counted = each.groupBy("qa", "qb").agg(F.count(F.lit(1)).alias("n")).join(W.quantiles(each, "views", {"mid": 0.5}, "qa", "qb"), ["qa", "qb"], "left")
    return counted.select(F.nullif("qa", F.lit(-1)).alias("qa"), F.nullif("qb", F.lit(-1)).alias("qb"), "n", F.round("mid", 3).alias("mid"))


@query(f"WITH {LONG_SQL} SELECT CASE WHEN target < 5 THEN 'low' WHEN target < 5.3 THEN 'mid' ELSE 'high' END AS regime, metric, round(avg(value), 5) AS mean, min(value) AS lowest, max(value) AS highest FROM long GROUP BY 1, 2")
def d8_regime_statistics(table):
    t = F.col("target")
    return metric_values(table).groupBy(F.when(t < 5, "low").when(t < 5.3, "mid").otherwise("high").alias("regime"), "metric").agg(F.round(F.avg("value"), 5).alias("mean"), F.min("value").alias("lowest"), F.max("value").alias("highest"))


@query("SELECT p_brand AS mech, count(*) AS n, count(DISTINCT l_orderkey) AS videos, list_sort(list_distinct(list(l_returnflag))) AS kinds, list_sort(list_distinct(list(p_partkey)))[1:3] AS samples FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand")
def d9_mechanism_catalog(table):
    rows = table("lineitem").join(table("part"), F.col("p_partkey") == F.col("l_partkey")).withColumnRenamed("p_brand", "mech")
    smallest = W.latest(rows.select("mech", "p_partkey").distinct(), ["mech"], [F.col("p_partkey")], 3)
    samples = smallest.groupBy("mech").agg(F.sort_array(F.collect_list("p_partkey")).alias("samples"))
    counted = rows.groupBy("mech").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("videos"), F.sort_array(F.collect_set("l_returnflag")).alias("kinds"))
    return counted.join(samples, "mech")


@query("WITH w AS (SELECT DISTINCT doc_id, unnest(string_split_regex(trim(lower(text)), '\\s+')) AS term FROM documents), n AS (SELECT count(*) AS n FROM documents) SELECT term, count(*) AS df, round(ln((n + 1) / (count(*) + 1)), 6) AS idf, round(count(*) / n, 6) AS prevalence FROM w, n GROUP BY term, n")
def d10_inverse_document_frequency_all(table):
    return inverse_document_frequency(table)


def inverse_document_frequency(table):
    d = table("documents")
    words = d.select("doc_id", F.explode(F.array_distinct(F.split(F.trim(F.lower("text")), r"\s+"))).alias("term"))
    n = F.broadcast(d.agg(F.count(F.lit(1)).alias("n")))
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(n)
    return df.select("term", "df", F.round(F.ln((F.col("n") + 1) / (F.col("df") + 1)), 6).alias("idf"), F.round(F.col("df") / F.col("n"), 6).alias("prevalence"))


@query("SELECT kind, value, count(DISTINCT l_orderkey) AS used FROM (SELECT l_orderkey, unnest(['flag', 'status', 'brand']) AS kind, unnest([l_returnflag, l_linestatus, p_brand]) AS value FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1, 2 HAVING count(DISTINCT l_orderkey) >= 100")
def d12_component_emergence(table):
    rows = table("lineitem").join(table("part"), F.col("p_partkey") == F.col("l_partkey"))
    parts = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("flag", "l_returnflag"), ("status", "l_linestatus"), ("brand", "p_brand"))])
    return rows.select("l_orderkey", F.explode(parts).alias("x")).groupBy("x.kind", "x.value").agg(F.countDistinct("l_orderkey").alias("used")).filter("used >= 100")


@query(f"WITH {VIDEOS_SQL}, b AS (SELECT avg((views > 300000)::INT) AS base FROM videos) SELECT kind, count(*) AS n, round(avg((views > 300000)::INT), 6) AS hit_rate, round(avg((views > 300000)::INT) / any_value(base), 6) AS lift, round(avg(log10(views)), 6) AS mean_log FROM videos, b GROUP BY kind")
def d13_tail_profile(table):
    v = videos(table).select("kind", "views", (F.col("views") > 300000).cast("int").alias("hit"))
    base = F.broadcast(v.agg(F.avg("hit").alias("base")))
    return v.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.avg("hit").alias("h"), F.round(F.avg(F.log10("views")), 6).alias("mean_log")).join(base).select("kind", "n", F.round("h", 6).alias("hit_rate"), F.round(F.col("h") / F.col("base"), 6).alias("lift"), "mean_log")


@query(f"WITH {VIDEOS_SQL}, a AS (SELECT source, avg(views) AS m FROM videos GROUP BY source) SELECT round(avg(m), 3) AS balanced, round((SELECT avg(views) FROM videos), 3) AS plain FROM a")
def d18_account_balanced_mean(table):
    per = videos(table).groupBy("source").agg(F.avg("views").alias("m"), F.sum("views").alias("s"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.round(F.avg("m"), 3).alias("balanced"), F.round(F.sum("s") / F.sum("n"), 3).alias("plain"))


@query("SELECT user_id, date_trunc('week', ts)::DATE AS week, round(sum(value), 4) AS volume, count(*) AS sets FROM events GROUP BY 1, 2")
def d20_weekly_volume(table):
    return table("events").groupBy("user_id", F.to_date(F.date_trunc("week", "ts")).alias("week")).agg(F.round(F.sum("value"), 4).alias("volume"), F.count(F.lit(1)).alias("sets"))


@query("SELECT l_partkey, max(l_extendedprice * (1 + l_quantity / 30)) AS best FROM lineitem GROUP BY l_partkey")
def d21_estimated_maximum(table):
    return table("lineitem").groupBy("l_partkey").agg(F.max(F.col("l_extendedprice") * (1 + F.col("l_quantity") / 30)).alias("best"))


@query("SELECT coalesce(c_mktsegment, 'none') AS project, round(sum(abs(o_totalprice)), 2) AS total FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0 GROUP BY 1")
def d25_project_totals(table):
    good = table("customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table("orders").join(good, "o_custkey", "left").groupBy(F.coalesce("c_mktsegment", F.lit("none")).alias("project")).agg(F.round(F.sum(F.abs("o_totalprice")), 2).alias("total"))


@query(f"WITH {VIDEOS_SQL} SELECT video_id, round(1.0 / count(*) OVER (PARTITION BY source), 8) AS weight FROM videos")
def d27_source_equal_weights(table):
    v = videos(table)
    return v.join(v.groupBy("source").count(), "source").select("video_id", F.round(1.0 / F.col("count"), 8).alias("weight"))


@query("SELECT o_orderkey, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders")
def e1_average_rank(table):
    return W.with_average_rank(table("orders").select("o_orderkey", "o_totalprice").withColumn("all", F.lit(1)), "o_totalprice", "all", name="r").select("o_orderkey", "r")


@query("SELECT o_orderkey, CASE WHEN n > 1 THEN round(100 * (r - 1) / (n - 1), 6) ELSE 50 END AS pct FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_custkey, o_totalprice) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)")
def e2_empirical_percentile(table):
    return table("orders").select("o_orderkey", F.round(W.empirical_percentile("o_totalprice", "o_custkey"), 6).alias("pct"))


@query("SELECT o_orderkey, (SELECT count(*) FROM customer WHERE c_acctbal <= o_totalprice / 30) / (SELECT count(*) FROM customer) AS share FROM orders")
def e3_percentile_of_reference(table):
    """Values asked for stand among the reference's with no weight: one running count gives the rows at or below each."""
    ref = table("customer").select(F.col("c_acctbal").alias("x"), F.lit(1).alias("w"))
    asked = table("orders").select("o_orderkey", (F.col("o_totalprice") / 30).alias("x"))
    upto = W.value_places(ref.unionByName(asked.select("x", F.lit(0).alias("w"))), "x", weight=F.col("w")).select("x", (F.col("__below") + F.col("__c")).alias("k"))
    total = F.broadcast(ref.agg(F.count(F.lit(1)).alias("n")))
    return asked.join(upto, "x", "left").join(total).select("o_orderkey", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("share"))


@query("SELECT o_orderkey, round(o_totalprice / nullif(list_sort(prev)[len(prev) // 2 + 1], 0), 6) AS outlier FROM (SELECT o_orderkey, o_totalprice, list(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS prev FROM orders)")
def e5_channel_outlier(table):
    prev = F.collect_list("o_totalprice").over(W.previous("o_custkey", ["o_orderdate", "o_orderkey"], 10))
    return table("orders").withColumn("prev", prev).select("o_orderkey", F.round(F.col("o_totalprice") / F.nullif(W.upper_median(F.col("prev")), F.lit(0)), 6).alias("outlier"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN round(n / c_acctbal, 6) END AS outlier FROM customer JOIN (SELECT o_custkey, sum(o_totalprice) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def e6_subscriber_outlier(table):
    s = table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("n"))
    return table("customer").join(s, "c_custkey").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.round(F.col("n") / F.col("c_acctbal"), 6)).alias("outlier"))


@query("WITH r AS (SELECT *, o_totalprice - avg(o_totalprice) OVER () AS res FROM orders) SELECT o_orderkey, round(coalesce(sum(res) OVER w, 0) / (2.0 + count(*) OVER w), 3) AS effect FROM r WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def e7_posterior_creator_effect(table):
    o = table("orders")
    w = W.previous("o_custkey", ["o_orderdate", "o_orderkey"])
    r = o.join(F.broadcast(o.agg(F.avg("o_totalprice").alias("m")))).withColumn("res", F.col("o_totalprice") - F.col("m"))
    return r.select("o_orderkey", F.round(F.coalesce(F.sum("res").over(w), F.lit(0.0)) / (2.0 + F.count(F.lit(1)).over(w)), 3).alias("effect"))


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (PARTITION BY o_custkey), 3) AS centred FROM orders")
def e8_source_centering(table):
    o = table("orders")
    return o.join(o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("m")), "o_custkey").select("o_orderkey", F.round(F.col("o_totalprice") - F.col("m"), 3).alias("centred"))


@query("SELECT o_orderkey, date_diff('day', lag(o_orderdate) OVER w, o_orderdate) AS days_since, round(avg(o_totalprice) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 3) AS recent FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def e9_cadence_features(table):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table("orders").select("o_orderkey", F.datediff("o_orderdate", F.lag("o_orderdate").over(w)).cast("long").alias("days_since"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-3, -1)), 3).alias("recent"))


@query("SELECT o_orderkey, round(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01') / 365.0, 6) AS years, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS quarter FROM orders")
def e10_age_and_quarter(table):
    return table("orders").select("o_orderkey", F.round(F.datediff(F.to_date(F.lit("2000-01-01")), "o_orderdate") / 365.0, 6).alias("years"), F.concat(F.year("o_orderdate"), F.lit("Q"), F.quarter("o_orderdate")).alias("quarter"))


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS latest_type, max(event_id) AS newest FROM events GROUP BY user_id")
def e13_last_known_state(table):
    return table("events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_type"), F.max("event_id").alias("newest"))


@query("WITH t AS (SELECT DISTINCT o_orderdate AS t FROM orders), r AS (SELECT t, row_number() OVER (ORDER BY t) AS i, count(*) OVER () AS n FROM t) SELECT CASE WHEN i <= floor(n * 0.6) THEN 0 ELSE least(4, 1 + floor((i - 1 - floor(n * 0.6)) / ((n - floor(n * 0.6)) / 4.0)))::INT END AS fold, count(*) AS times, min(t) AS first_at, max(t) AS last_at FROM r GROUP BY 1")
def e16_expanding_splits(table):
    """Distinct times are numbered from counts over their classes."""
    t = table("orders").groupBy(F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us")).agg(F.first("o_orderdate").alias("t"))
    r = t.join(W.value_places(t, "us").select("us", (F.col("__below") + 1).alias("i"), F.col("__n").alias("n")), "us")
    head = F.floor(F.col("n") * 0.6)
    fold = F.when(F.col("i") <= head, 0).otherwise(F.least(F.lit(4), 1 + F.floor((F.col("i") - 1 - head) / ((F.col("n") - head) / 4.0))))
    return r.groupBy(fold.cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("times"), F.min("t").alias("first_at"), F.max("t").alias("last_at"))


@query("WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events), r AS (SELECT user_id, event_type, count(*) AS length FROM g GROUP BY user_id, event_type, island) SELECT event_type, count(*) AS runs, max(length) AS longest, round(avg(length), 6) AS mean, round(var_pop(length), 6) AS variance FROM r GROUP BY event_type")
def e19_runs(table):
    r = W.runs(table("events"), ["user_id"], ["ts", "event_id"], "event_type")
    return r.groupBy("event_type").agg(F.count(F.lit(1)).alias("runs"), F.max("length").alias("longest"), F.round(F.avg("length"), 6).alias("mean"), F.round(F.var_pop("length"), 6).alias("variance"))


@query("WITH g AS (SELECT user_id, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts)) / 1e6 AS gap FROM events) SELECT user_id, round(max(gap), 3) AS longest, count(*) FILTER (gap > 3600) AS long_gaps, round(sum(gap) FILTER (gap > 1800), 3) AS silent FROM g GROUP BY user_id")
def e20_gaps(table):
    gap = (F.unix_micros(F.lead(F.col("ts").cast("timestamp")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return table("events").select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.round(F.max("gap"), 3).alias("longest"), F.count_if(F.col("gap") > 3600).alias("long_gaps"), F.round(F.sum(F.when(F.col("gap") > 1800, F.col("gap"))), 3).alias("silent"))


@query(f"WITH {LONG_SQL}, r AS (SELECT metric, abs(corr(value, target)) AS s FROM long GROUP BY metric) SELECT metric, round(s, 6) AS s FROM r ORDER BY s DESC LIMIT 3")
def f1_top_indicators(table):
    return metric_values(table).groupBy("metric").agg(F.abs(F.corr("value", "target")).alias("s")).orderBy(F.desc("s")).limit(3).select("metric", F.round("s", 6).alias("s"))


@query("WITH r AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS turn, p_retailprice FROM part) SELECT p_brand, p_partkey FROM r ORDER BY turn, p_retailprice DESC, p_partkey LIMIT 40")
def f2_diverse_top(table):
    p = table("part").withColumn("metric", F.col("p_partkey"))
    return X.diverse_top(p, "p_brand", F.col("p_retailprice"), 40).select("p_brand", "p_partkey")


@query("SELECT doc_id FROM documents ORDER BY sha256(doc_id::VARCHAR || ':' || source) LIMIT 50")
def f8_hash_sample(table):
    """A sampling operator: the rows with the smallest hashes."""
    return table("documents").select("doc_id", F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "source"), 256).alias("h")).orderBy("h").limit(50).select("doc_id")


@query("""WITH s AS (SELECT source, sha256(source) AS h, CASE WHEN ('0x' || substr(sha256(source), 1, 2))::INT % 5 = 0 THEN 'evaluation' ELSE 'discovery' END AS part FROM (SELECT DISTINCT source FROM documents)),
k AS (SELECT source, part FROM s QUALIFY row_number() OVER (PARTITION BY part ORDER BY h, source) <= 12)
SELECT doc_id, source, part FROM documents JOIN k USING (source) QUALIFY row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR), doc_id) <= 20""")
def f9_source_balanced_rows(table):
    """A sampling operator: a fifth of the sources, by hash, to evaluate on; of each part so many sources, of each source so many rows, by hash."""
    d = table("documents").filter("source is not null").select("doc_id", "source", F.sha2(F.col("doc_id").cast("string"), 256).alias("h"))
    part = F.when(T.hash_fold(F.col("source"), 5) == 0, "evaluation").otherwise("discovery")
    s = d.select("source").distinct().select("source", F.sha2("source", 256).alias("k"), part.alias("part"))
    kept = W.latest(s, ["part"], [F.col("k"), F.col("source")], 12).select("source", "part")
    return W.latest(d.join(kept, "source"), ["source"], [F.col("h"), F.col("doc_id")], 20).select("doc_id", "source", "part")


@query("WITH v AS (SELECT o_custkey AS source, o_totalprice AS views FROM orders), s AS (SELECT source, max(views) AS top, min(views) AS bottom FROM v GROUP BY source) (SELECT 'top' AS side, source, top AS views FROM s ORDER BY top DESC, source LIMIT 10) UNION ALL (SELECT 'bottom', source, bottom FROM s ORDER BY bottom, source LIMIT 10)")
def f7_source_diverse_extremes(table):
    s = table("orders").groupBy(F.col("o_custkey").alias("source")).agg(F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("bottom"))
    top = s.orderBy(F.desc("top"), "source").limit(10).select(F.lit("top").alias("side"), "source", F.col("top").alias("views"))
    return top.union(s.orderBy("bottom", "source").limit(10).select(F.lit("bottom"), "source", "bottom"))


@query("SELECT p_partkey FROM part p WHERE NOT EXISTS (SELECT 1 FROM part q WHERE q.p_size >= p.p_size AND q.p_retailprice >= p.p_retailprice AND (q.p_size > p.p_size OR q.p_retailprice > p.p_retailprice))")
def f13_pareto_front(table):
    """For two objectives the front follows from the best price at each size and above: one window over the sizes."""
    p = table("part")
    best = p.groupBy("p_size").agg(F.max("p_retailprice").alias("own"))
    w = Window.orderBy(F.desc("p_size")).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("above", F.max("own").over(w)).filter("above is null or own > above").select("p_size", F.col("own").alias("p_retailprice"))
    return p.join(front, ["p_size", "p_retailprice"], "left_semi").select("p_partkey")


@query("SELECT event_id FROM events WHERE contains(event_type, 'c') OR contains(props, '7') ORDER BY ts DESC, event_id LIMIT 8")
def f15_log_search(table):
    return table("events").filter(F.col("event_type").contains("c") | F.col("props").contains("7")).orderBy(F.desc("ts"), "event_id").limit(8).select("event_id")
