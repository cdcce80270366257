"""Statistics and experiment families (J, K) over the creator panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from creatorlake.operators import experiments as X
from creatorlake.operators import statistics as S
from creatorlake.operators.windows import quantiles, value_places, with_average_rank
from creatorlake.plans.panel import LONG_SQL, PLACED_SQL, VIDEOS_SQL, bucket_sql, metric_values, videos
from creatorlake.plans.registry import query


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


@query(f"""WITH {LONG_SQL}, s AS (SELECT metric, count(*) AS n, corr(value, target) AS r FROM long GROUP BY metric)
SELECT metric, n, round(r, 6) AS r, round(tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3)), 6) AS high FROM s""")
def j1_pearson_interval(table):
    return S.pearson(metric_values(table), ["metric"], least=50).select("metric", "n", *r6("r", "low", "high"))


RANKS = """, ranks AS (
  SELECT *, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0 AS rx,
            rank() OVER (PARTITION BY metric ORDER BY target) + (count(*) OVER (PARTITION BY metric, target) - 1) / 2.0 AS ry FROM long)"""


@query(f"WITH {LONG_SQL}{RANKS} SELECT metric, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM ranks GROUP BY metric")
def j2_spearman(table):
    return S.spearman(metric_values(table), ["metric"]).select("metric", "n", *r6("rho"))


@query(f"WITH {LONG_SQL} SELECT metric, round(regr_slope(target, value), 6) AS slope, round(regr_intercept(target, value), 6) AS intercept, round(corr(value, target), 6) AS r FROM long GROUP BY metric")
def j4_regression_line(table):
    return S.line(metric_values(table), ["metric"]).select("metric", *r6("slope", "intercept", "r"))


@query(f"""WITH {LONG_SQL}, m AS (SELECT metric, avg(value) AS a, stddev_pop(value) AS s FROM long GROUP BY metric)
SELECT metric, round(avg(power((value - a) / s, 3)), 6) AS skew FROM long JOIN m USING (metric) GROUP BY metric""")
def j5_skewness(table):
    return metric_values(table).groupBy("metric").agg(F.round(F.skewness("value"), 6).alias("skew"))


KIND_P = f"""WITH {LONG_SQL}, p AS (
  SELECT kind, metric, 2 / (1 + exp(1.702 * abs(atanh(r) * sqrt(n - 3)))) AS p FROM (
    SELECT kind, metric, count(*) AS n, corr(value, target) AS r FROM long JOIN (SELECT video_id, kind FROM videos) USING (video_id) GROUP BY kind, metric)
), k AS (SELECT *, count(*) OVER (PARTITION BY kind) AS m, row_number() OVER (PARTITION BY kind ORDER BY p) AS i FROM p)"""


def kind_tests(table):
    """A p-value for each kind and metric."""
    rows = metric_values(table).join(videos(table).select("video_id", "kind"), "video_id")
    return S.pearson(rows, ["kind", "metric"]).withColumn("p", S.normal_p(F.atanh("r") * F.sqrt(F.col("n") - 3))).select("kind", "metric", "p")


@query(KIND_P + " SELECT kind, metric, round(p, 6) AS p, round(least(1, min(p * m / i) OVER (PARTITION BY kind ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k")
def j8_benjamini_hochberg(table):
    return S.benjamini_hochberg(kind_tests(table), "p", "kind").select("kind", "metric", *r6("p", "q"))


@query(KIND_P + " SELECT kind, metric, round(least(1, min(p * m / i * (1 + 1/2.0 + 1/3.0 + 1/4.0 + 1/5.0)) OVER (PARTITION BY kind ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM k")
def j9_benjamini_yekutieli(table):
    return S.benjamini_hochberg(kind_tests(table), "p", "kind", yekutieli=True).select("kind", "metric", *r6("q"))


@query(KIND_P + " SELECT kind, metric, round(least(1, max((m - i + 1) * p) OVER (PARTITION BY kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS q FROM k")
def j10_holm(table):
    return S.holm(kind_tests(table), "p", "kind").select("kind", "metric", *r6("q"))


@query(f"""WITH {VIDEOS_SQL}, s AS (SELECT kind, count(*) AS n, count(*) FILTER (views > 150000) AS hits FROM videos GROUP BY kind), p AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM s)
SELECT kind, n, hits, round((p + z*z/(2*n)) / (1 + z*z/n) - z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS low, round((p + z*z/(2*n)) / (1 + z*z/n) + z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n), 6) AS high FROM p""")
def j20_wilson_interval(table):
    s = videos(table).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("views") > 150000).alias("hits"))
    low, high = S.wilson(F.col("hits"), F.col("n"))
    return s.select("kind", "n", "hits", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(f"""WITH {VIDEOS_SQL}, s AS (SELECT kind, avg(quantity) FILTER (hit) AS m1, avg(quantity) FILTER (NOT hit) AS m0, var_samp(quantity) FILTER (hit) AS v1, var_samp(quantity) FILTER (NOT hit) AS v0,
  count(*) FILTER (hit) AS n1, count(*) FILTER (NOT hit) AS n0 FROM (SELECT *, views > 150000 AS hit FROM videos) GROUP BY kind)
SELECT kind, round((m1 - m0) / sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)), 6) AS d FROM s""")
def j23_cohens_d(table):
    return S.cohens_d(videos(table).withColumn("hit", (F.col("views") > 150000).cast("int")), ["kind"], "hit", "quantity").select("kind", *r6("d"))


@query(f"""WITH {VIDEOS_SQL}, g AS (SELECT source, avg(views) AS m, var_pop(views) AS v, count(*) AS n FROM videos GROUP BY source), a AS (
  SELECT sum(n*m*m)/sum(n) - power(sum(n*m)/sum(n), 2) AS between_var, sum(n*v)/sum(n) AS within_var FROM g)
SELECT round(between_var, 2) AS between_var, round(within_var, 2) AS within_var, round(between_var / (between_var + within_var), 6) AS share FROM a""")
def j25_variance_components(table):
    return S.variance_components(videos(table), "source", "views").select(F.round("between_var", 2).alias("between_var"), F.round("within_var", 2).alias("within_var"), *r6("share"))


@query("""WITH p AS (SELECT label, count(*) AS n, sum(x) AS s, sum(x*x) AS q FROM (SELECT label, embedding[1]::DOUBLE AS x FROM embeddings) GROUP BY label), t AS (SELECT sum(n) AS n, sum(s) AS s, sum(q) AS q, sum(s*s/n) AS b FROM p)
SELECT round((b - s*s/n) / (q - s*s/n), 6) AS eta2 FROM t""")
def j26_eta_squared(table):
    return S.eta_squared(table("embeddings").select("label", F.col("embedding")[0].cast("double").alias("x")), "label", "x").select(*r6("eta2"))


@query(f"""WITH {VIDEOS_SQL}, r AS (SELECT kind, views > 150000 AS hit, rank() OVER (PARTITION BY kind ORDER BY quantity) + (count(*) OVER (PARTITION BY kind, quantity) - 1) / 2.0 AS r FROM videos),
s AS (SELECT kind, sum(r) FILTER (hit) AS s, count(*) FILTER (hit) AS p, count(*) FILTER (NOT hit) AS q FROM r GROUP BY kind)
SELECT kind, round((s - p * (p + 1) / 2) / (p * q), 6) AS auc FROM s""")
def j27_roc_auc(table):
    return S.roc_auc(videos(table).withColumn("hit", (F.col("views") > 150000).cast("int")), ["kind"], "quantity", "hit").select("kind", *r6("auc"))


@query(f"""WITH {VIDEOS_SQL}, o AS (SELECT kind, views > 150000 AS hit, row_number() OVER (PARTITION BY kind ORDER BY quantity DESC, video_id) AS i FROM videos),
c AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY kind ORDER BY i) AS h FROM o)
SELECT kind, round(avg(h / i), 6) AS ap FROM c WHERE hit GROUP BY kind""")
def j29_average_precision(table):
    v = videos(table).withColumn("hit", F.col("views") > 150000)
    placed = X.order_in_metric(v.withColumn("down", -F.col("quantity")), ["kind"], "down")
    # places are distinct: a hit's precision is the hits before it and itself over its place
    hits = value_places(placed.filter("hit"), "place", "kind")
    return hits.groupBy("kind").agg(F.round(F.avg((F.col("__below") + 1) / (F.col("place") + 1)), 6).alias("ap"))


PRED = f"WITH {VIDEOS_SQL}, pred AS (SELECT *, avg(views) OVER (PARTITION BY kind) AS guess FROM videos)"


def predicted(table):
    v = videos(table)
    return v.join(v.groupBy("kind").agg(F.avg("views").alias("guess")), "kind")


@query(PRED + " SELECT status, round(avg(abs(guess - views)), 3) AS mae, round(sqrt(avg(power(guess - views, 2))), 3) AS rmse, round(avg(guess - views), 3) AS bias, round(1 - sum(power(guess - views, 2)) / (var_pop(views) * count(views)), 6) AS r2 FROM pred GROUP BY status")
def j30_errors(table):
    return S.errors(predicted(table), ["status"], "views", "guess").select("status", *[F.round(c, 3).alias(c) for c in ("mae", "rmse", "bias")], *r6("r2"))


@query("""WITH l AS (SELECT toxic, least(1, length(text) / 10000) AS p FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL), b AS (SELECT avg(power(p - toxic, 2)) AS brier, avg(toxic) AS base FROM l)
SELECT round(brier, 6) AS brier, round(1 - brier / (base * (1 - base)), 6) AS skill FROM b""")
def j31_brier_skill(table):
    l = table("labels").filter("toxic is not null").join(table("documents").select("doc_id", "text"), "doc_id").select("toxic", F.least(F.lit(1.0), F.length("text") / 10000).alias("p"))
    b = l.agg(F.avg((F.col("p") - F.col("toxic")) ** 2).alias("brier"), F.avg("toxic").alias("base"))
    return b.select(*r6("brier"), F.round(1 - F.col("brier") / (F.col("base") * (1 - F.col("base"))), 6).alias("skill"))


@query("""WITH l AS (SELECT toxic, least(1, length(text) / 10000) AS p FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL)
SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(toxic), 6) AS rate FROM l GROUP BY 1""")
def j32_calibration_bins(table):
    l = table("labels").filter("toxic is not null").join(table("documents").select("doc_id", "text"), "doc_id").select("toxic", F.least(F.lit(1.0), F.length("text") / 10000).alias("p"))
    return l.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"), F.round(F.avg("toxic"), 6).alias("rate"))


@query("""WITH l AS (SELECT toxic, least(1, length(text) / 10000) AS p FROM labels JOIN documents USING (doc_id) WHERE toxic IS NOT NULL)
SELECT round(regr_slope(toxic, p), 6) AS slope, round(regr_intercept(toxic, p), 6) AS intercept FROM l""")
def j33_linear_calibration(table):
    l = table("labels").filter("toxic is not null").join(table("documents").select("doc_id", "text"), "doc_id").select("toxic", F.least(F.lit(1.0), F.length("text") / 10000).alias("p"))
    return l.agg(F.round(F.regr_slope("toxic", "p"), 6).alias("slope"), F.round(F.regr_intercept("toxic", "p"), 6).alias("intercept"))


@query(f"""WITH {VIDEOS_SQL}, t AS (SELECT unnest([20, 60, 100, 140]) AS threshold), b AS (SELECT avg((views > 150000)::INT) AS base, count(*) AS n_all, count(*) FILTER (views > 150000) AS hits_all FROM videos),
w AS (SELECT threshold, count(*) AS n, avg((views > 150000)::INT) AS p, 1.959963984540054 AS z FROM t JOIN videos ON quantity >= threshold GROUP BY threshold),
i AS (SELECT threshold, (p + z*z/(2*n)) / (1 + z*z/n) AS mid, z * sqrt(p*(1-p)/n + z*z/(4*n*n)) / (1 + z*z/n) AS half FROM w)
SELECT threshold, any_value(round(mid - half, 6)) AS hit_low, any_value(round(mid + half, 6)) AS hit_high, round(count(*) / any_value(n_all), 6) AS pass_rate, round(avg((views > 150000)::INT), 6) AS hit_rate, round(avg((views > 150000)::INT) / any_value(base), 6) AS lift,
  round(count(*) FILTER (views > 150000) / any_value(hits_all), 6) AS recall, round(median(views), 1) AS median_views FROM t JOIN videos ON quantity >= threshold JOIN i USING (threshold), b GROUP BY threshold""")
def j35_threshold_risk(table):
    v = videos(table).select("quantity", "views", (F.col("views") > 150000).alias("hit"))
    base = v.agg(F.count(F.lit(1)).alias("n_all"), F.count_if("hit").alias("hits_all"))
    # each row goes to the thresholds that it passes, four at most
    passed = v.select("*", F.explode(F.filter(F.array(*[F.lit(t) for t in (20, 60, 100, 140)]), lambda t: F.col("quantity") >= t)).alias("threshold"))
    mid = quantiles(passed, "views", {"m": 0.5}, "threshold").select("threshold", F.round("m", 1).alias("median_views"))
    a = passed.groupBy("threshold").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h")).join(mid, "threshold", "left").join(F.broadcast(base))
    low, high = S.wilson(F.col("h"), F.col("n"))
    return a.select("threshold", F.round(low, 6).alias("hit_low"), F.round(high, 6).alias("hit_high"), F.round(F.col("n") / F.col("n_all"), 6).alias("pass_rate"), F.round(F.col("h") / F.col("n"), 6).alias("hit_rate"), F.round(F.col("h") / F.col("n") / (F.col("hits_all") / F.col("n_all")), 6).alias("lift"), F.round(F.col("h") / F.col("hits_all"), 6).alias("recall"), "median_views")


@query(f"WITH {VIDEOS_SQL}, s AS (SELECT source, views, rank() OVER (PARTITION BY source ORDER BY quantity) + (count(*) OVER (PARTITION BY source, quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY source ORDER BY views) + (count(*) OVER (PARTITION BY source, views) - 1) / 2.0 AS ry FROM videos), r AS (SELECT source, corr(rx, ry) AS rho FROM s GROUP BY source HAVING count(*) >= 5) SELECT round(avg(rho), 6) AS macro_rho FROM r WHERE NOT isnan(rho)")
def j37_source_macro_spearman(table):
    r = S.spearman(videos(table), ["source"], "quantity", "views")
    return r.filter("n >= 5 and rho is not null and not isnan(rho)").agg(F.round(F.avg("rho"), 6).alias("macro_rho"))


PAIRS = f"WITH {LONG_SQL}, pairs AS (SELECT l.video_id, l.metric AS a, r.metric AS b, l.value AS va, r.value AS vb, l.target FROM long l JOIN long r ON l.video_id = r.video_id AND l.metric < r.metric)"
C3 = PAIRS + ", c AS (SELECT a, b, corr(va, target) AS ra, corr(vb, target) AS rb, corr(va, vb) AS rab FROM pairs GROUP BY a, b)"


@query(PAIRS + """, c AS (SELECT a, b, corr(va, target) AS ra, corr(vb, target) AS rb, corr(va, vb) AS ab, corr(va * vb, target) AS rp, corr(va * vb, va) AS ap, corr(va * vb, vb) AS bp FROM pairs GROUP BY a, b),
d AS (SELECT *, (ra*ra + rb*rb - 2*ra*rb*ab) / (1 - ab*ab) AS two, (ra*ra*(1 - bp*bp) + rb*rb*(1 - ap*ap) + rp*rp*(1 - ab*ab) + 2*ra*rb*(ap*bp - ab) + 2*ra*rp*(ab*bp - ap) + 2*rb*rp*(ab*ap - bp)) / (1 + 2*ab*ap*bp - ab*ab - ap*ap - bp*bp) AS three FROM c)
SELECT a, b, round(two - ra*ra - rb*rb, 6) AS synergy, round(three - two, 6) AS product_gain FROM d""")
def j40_synergy(table):
    return X.synergy(metric_values(table)).select("a", "b", *r6("synergy", "product_gain"))


@query(PAIRS + " SELECT a, b, count(*) AS n, round(corr(va, vb), 6) AS r FROM pairs GROUP BY a, b")
def k1_pair_correlation(table):
    return X.pair_correlation(metric_values(table)).select("a", "b", "n", *r6("r"))


@query(PAIRS + ", mid AS (SELECT metric, median(value) AS mid FROM long GROUP BY metric) SELECT a, b, round(corr(va, target) FILTER (vb > mid) - corr(va, target) FILTER (NOT vb > mid), 6) AS delta FROM pairs JOIN mid ON metric = b GROUP BY a, b")
def k2_conditional_delta(table):
    return X.conditional_delta(metric_values(table)).select("a", "b", *r6("delta"))


@query(PAIRS + " SELECT a, b, p.metric AS c, round(corr(va * vb * p.value, pairs.target), 6) AS r_product FROM pairs JOIN long p ON p.video_id = pairs.video_id AND b < p.metric GROUP BY a, b, p.metric")
def k3_triple_product(table):
    return X.triple_correlation(metric_values(table)).select("a", "b", "c", *r6("r_product"))


@query(f"WITH {LONG_SQL}{RANKS} SELECT l.metric AS a, r.metric AS b, round(corr(l.rx, r.rx), 6) AS rho, round(corr(l.value, r.value), 6) AS r, round(abs(corr(l.rx, r.rx)) - abs(corr(l.value, r.value)), 6) AS gap FROM ranks l JOIN ranks r ON l.video_id = r.video_id AND l.metric < r.metric GROUP BY 1, 2")
def k4_rank_pair(table):
    return X.rank_pair(metric_values(table)).select("a", "b", *r6("rho", "r", "gap"))


def curve_sql(k):
    return f"""WITH {PLACED_SQL}, m AS (SELECT metric, {bucket_sql(k)} AS bucket, avg(target) AS m FROM placed GROUP BY 1, 2), s AS (SELECT *, lead(m) OVER (PARTITION BY metric ORDER BY bucket) - m AS step FROM m)
SELECT metric, round(greatest(count(*) FILTER (step > 0), count(*) FILTER (step < 0)) / {k - 1}, 6) AS monotone, round(max(m) - min(m), 6) AS span, round(corr(bucket, m), 6) AS bucket_r FROM s GROUP BY metric"""


@query(curve_sql(5))
def k5_bucket_curve(table):
    return X.bucket_curve(metric_values(table), 5).select("metric", *r6("monotone", "span", "bucket_r"))


@query(f"WITH {PLACED_SQL} SELECT metric, round(corr(value, target) FILTER ({bucket_sql(2)} = 0), 6) AS r_low, round(corr(value, target) FILTER ({bucket_sql(2)} = 1), 6) AS r_high FROM placed GROUP BY metric")
def k6_piecewise_halves(table):
    return X.halves(metric_values(table)).select("metric", *r6("r_low", "r_high"))


@query(f"WITH {PLACED_SQL}, r AS (SELECT metric, {bucket_sql(4)} AS bucket, corr(value, target) AS r FROM placed GROUP BY 1, 2), s AS (SELECT *, r - lag(r) OVER (PARTITION BY metric ORDER BY bucket) AS step FROM r) SELECT metric, arg_max(bucket, abs(step))::INTEGER AS at_bucket, round(max(abs(step)), 6) AS largest_step FROM s GROUP BY metric")
def k7_quarter_steps(table):
    return X.quarter_steps(metric_values(table)).select("metric", "at_bucket", *r6("largest_step"))


@query(f"WITH {PLACED_SQL} SELECT metric, round(avg(target) FILTER ({bucket_sql(4)} = 3) - avg(target) FILTER ({bucket_sql(4)} = 0), 6) AS gap FROM placed GROUP BY metric")
def k8_quantile_gap(table):
    return X.quantile_gap(metric_values(table)).select("metric", *r6("gap"))


@query(C3 + " SELECT a, b, round((rb - ra * rab) / sqrt(1 - ra * ra), 6) AS r_residual FROM c")
def k9_residual_pair(table):
    return X.residual_pair(metric_values(table)).select("a", "b", *r6("r_residual"))


@query("WITH " + ", ".join(f"c{k} AS ({curve_sql(k)})" for k in (3, 5, 7)) + " SELECT metric, round(least(c3.monotone, c5.monotone, c7.monotone), 5) AS least_monotone, round((c3.monotone + c5.monotone + c7.monotone) / 3, 5) AS mean_monotone FROM c3 JOIN c5 USING (metric) JOIN c7 USING (metric)")
def k10_monotone_consistency(table):
    values = metric_values(table)
    parts = [X.bucket_curve(values, k).select("metric", F.round("monotone", 6).alias("m")) for k in (3, 5, 7)]
    return parts[0].union(parts[1]).union(parts[2]).groupBy("metric").agg(F.round(F.min("m"), 5).alias("least_monotone"), F.round(F.avg("m"), 5).alias("mean_monotone"))


@query(f"WITH {LONG_SQL}, r AS (SELECT metric, corr(value, target) AS r FROM long GROUP BY metric) SELECT metric, round(r, 6) AS r, CASE WHEN abs(r) >= 0.5 THEN 'strong' WHEN abs(r) >= 0.3 THEN 'moderate' WHEN abs(r) >= 0.1 THEN 'weak' ELSE 'none' END AS strength, CASE WHEN r >= 0 THEN 'positive' ELSE 'negative' END AS direction FROM r")
def k14_strength_labels(table):
    r = S.pearson(metric_values(table), ["metric"])
    return r.select("metric", *r6("r"), X.strength(F.col("r")).alias("strength"), F.when(F.col("r") >= 0, "positive").otherwise("negative").alias("direction"))


@query(PAIRS + " SELECT a, b, round(corr(va * vb, target), 6) AS r_product FROM pairs GROUP BY a, b")
def k12_product_pairs(table):
    return X.product_correlation(metric_values(table)).select("a", "b", *r6("r_product"))
