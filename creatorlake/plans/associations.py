"""Association tables, digests and panels: partial ranks, shrunk correlations, ledgers, bands, draws."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from creatorlake.operators import experiments as X
from creatorlake.operators import statistics as S
from creatorlake.operators import windows as W
from creatorlake.plans import more  # noqa: F401  registers the SQL that g18 reads
from creatorlake.plans.evaluation import FOLD_SQL, fold
from creatorlake.plans.panel import LONG_SQL, VIDEOS_SQL, metric_values, videos
from creatorlake.plans.registry import SQL, query
from creatorlake.sources.steps import step
from creatorlake.plans.statistics import KIND_P, PAIRS, RANKS, kind_tests, r6


@query(f"""WITH {VIDEOS_SQL}, u AS (SELECT video_id, views, (('0x' || substr(md5(video_id::VARCHAR), 1, 8))::BIGINT + 0.5) / 4294967296 AS u FROM videos WHERE views > 0)
SELECT video_id, row_number() OVER (ORDER BY -ln(u) / views, video_id) AS place FROM u QUALIFY place <= 100""")
def f14_weighted_draw(table):
    """100 videos drawn without replacement by weight: the first of an exponential race whose draws are hashes of the key."""
    u = (F.conv(F.substring(F.md5(F.col("video_id").cast("string")), 1, 8), 16, 10).cast("long") + 0.5) / 4294967296
    race = videos(table).filter("views > 0").select("video_id", (-F.log(u) / F.col("views")).alias("time"))
    first = race.orderBy("time", "video_id").limit(100)
    return first.select("video_id", F.row_number().over(Window.orderBy("time", "video_id")).cast("long").alias("place"))


@query(PAIRS + """, r AS (SELECT a, b, corr(va, vb) AS r FROM pairs GROUP BY a, b), d AS (SELECT b AS target, a AS predictor, r FROM r UNION ALL SELECT a, b, r FROM r)
SELECT target, predictor, round(abs(r), 6) AS strength, row_number() OVER (PARTITION BY target ORDER BY abs(r) DESC, predictor) AS place FROM d QUALIFY place <= 30""")
def g16_predictor_lists(table):
    """The 30 strongest predictors of each metric."""
    r = X.pair_correlation(metric_values(table))
    both = r.select(F.col("b").alias("target"), F.col("a").alias("predictor"), "r").union(r.select("a", "b", "r"))
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc(F.abs("r")), "predictor"))
    return both.select("target", "predictor", F.round(F.abs("r"), 6).alias("strength"), place.cast("long").alias("place"), place.alias("__p")).filter("__p <= 30").drop("__p")


@query(f"SELECT metric, r_low, r_high, largest_step, monotone, (r_low * r_high < 0) AS turns, (largest_step >= 0.1) AS steps, (monotone >= 0.75) AS monotone_enough FROM ({SQL['k6_piecewise_halves']}) JOIN ({SQL['k7_quarter_steps']}) USING (metric) JOIN ({SQL['k5_bucket_curve']}) USING (metric)")
def g17_nonlinearity_digest(table):
    """Halves, threshold and monotone evidence of each metric in one row, all from one order of its values."""
    rows = step(X.order_in_metric(step(metric_values(table), "metrics")), "ordered")
    joined = X.halves(rows).select("metric", *r6("r_low", "r_high")).join(X.quarter_steps(rows).select("metric", *r6("largest_step")), "metric").join(X.bucket_curve(rows, 5).select("metric", *r6("monotone")), "metric")
    return joined.select("*", (F.col("r_low") * F.col("r_high") < 0).alias("turns"), (F.col("largest_step") >= 0.1).alias("steps"), (F.col("monotone") >= 0.75).alias("monotone_enough"))


@query(f"WITH a AS (SELECT 'regime' AS kind, metric, d AS size FROM ({SQL['k11_regime_gap']}) UNION ALL SELECT 'quantile', metric, gap FROM ({SQL['k8_quantile_gap']})) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY abs(size) DESC, metric) AS place FROM a")
def g18_gap_leaderboards(table):
    """Metrics by regime gap and by quantile gap, each a ranking of its own."""
    b = X.buckets(metric_values(table), 4).filter("bucket in (0, 3)").withColumn("top", (F.col("bucket") == 3).cast("int"))
    d = S.cohens_d(b, ["metric"], "top", "target").select(F.lit("regime").alias("kind"), "metric", F.round("d", 6).alias("size"))
    gap = X.quantile_gap(metric_values(table)).select(F.lit("quantile").alias("kind"), "metric", F.round("gap", 6).alias("size"))
    return d.union(gap).withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc(F.abs("size")), "metric")).cast("long"))


@query(f"""WITH {LONG_SQL}{RANKS}, f AS (SELECT video_id, rx AS rc FROM ranks WHERE metric = 'price'),
c AS (SELECT metric, count(*) AS n, corr(rx, ry) AS xy, corr(rx, rc) AS xc, corr(ry, rc) AS yc FROM ranks JOIN f USING (video_id) WHERE metric <> 'price' GROUP BY metric)
SELECT metric, n, round((xy - xc * yc) / sqrt((1 - xc * xc) * (1 - yc * yc)), 6) AS partial_rho FROM c""")
def j6_partial_rank_correlation(table):
    """Rank correlation of each metric with the outcome, price held fixed: what a line through the ranks of price leaves of both."""
    rows = W.with_average_rank(W.with_average_rank(metric_values(table), "value", "metric", name="rx"), "target", "metric", name="ry").select("video_id", "metric", "rx", "ry")
    fixed = rows.filter("metric = 'price'").select("video_id", F.col("rx").alias("rc"))
    c = rows.filter("metric <> 'price'").join(fixed, "video_id").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), S.corr("rx", "ry").alias("xy"), S.corr("rx", "rc").alias("xc"), S.corr("ry", "rc").alias("yc"))
    xc, yc = F.col("xc"), F.col("yc")
    return c.select("metric", "n", F.round((F.col("xy") - xc * yc) / F.sqrt((1 - xc * xc) * (1 - yc * yc)), 6).alias("partial_rho"))


@query(PAIRS + """, m AS (SELECT metric, avg(value) AS mean, stddev_pop(value) AS sd FROM long GROUP BY metric), z AS (SELECT video_id, sum(power((value - mean) / sd, 2)) AS q FROM long JOIN m USING (metric) GROUP BY video_id),
f AS (SELECT avg(q * q) AS four, count(*) AS n FROM z), r AS (SELECT a, b, corr(va, vb) AS r FROM pairs GROUP BY a, b), t AS (SELECT 2 * sum(r * r) AS off, (SELECT count(*) FROM m) AS p FROM r),
s AS (SELECT least((four - p - off) / (p * n), off / p) / (off / p) AS s FROM f, t) SELECT a, b, round(r, 6) AS r, round((1 - s) * r, 6) AS shrunk FROM r, s""")
def j41_shrunk_correlations(table):
    """Correlations pulled towards zero by the Ledoit-Wolf share of standardised metrics; the share comes from sums over rows and pairs alone."""
    rows = metric_values(table)
    m = rows.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    z = rows.join(m, "metric").groupBy("video_id").agg(F.sum(F.pow((F.col("value") - F.col("mean")) / F.col("sd"), 2)).alias("q"))
    r = X.pair_correlation(rows).select("a", "b", "r")
    sums = z.agg(F.avg(F.col("q") * F.col("q")).alias("four"), F.count(F.lit(1)).alias("n")).join(r.agg((2 * F.sum(F.col("r") * F.col("r"))).alias("off"))).join(m.agg(F.count(F.lit(1)).alias("p")))
    spread = F.col("off") / F.col("p")
    share = sums.select((F.least((F.col("four") - F.col("p") - F.col("off")) / (F.col("p") * F.col("n")), spread) / spread).alias("s"))
    return r.join(F.broadcast(share)).select("a", "b", F.round("r", 6).alias("r"), F.round((1 - F.col("s")) * F.col("r"), 6).alias("shrunk"))


@query(KIND_P + ", b AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY p) AS j, count(*) OVER (PARTITION BY metric) AS mm FROM p) SELECT kind, metric, round(p, 6) AS p, round(least(1, min(p * mm / j) OVER (PARTITION BY metric ORDER BY j ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM b")
def j42_ledger_q_values(table):
    """The ledger of tests with q-values inside each metric's family."""
    return S.benjamini_hochberg(kind_tests(table), "p", "metric").select("kind", "metric", *r6("p", "q"))


AUDIT_SQL = VIDEOS_SQL + """, f AS (SELECT video_id, 'quantity' AS feature, quantity::DOUBLE AS x FROM videos UNION ALL SELECT video_id, 'discount', discount FROM videos UNION ALL SELECT video_id, 'control', views FROM videos),
g AS (SELECT video_id, 'views' AS target, views::DOUBLE AS y FROM videos UNION ALL SELECT video_id, 'age', date_diff('day', DATE '1970-01-01', published::DATE)::DOUBLE FROM videos),
a AS (SELECT feature, target, rank() OVER (PARTITION BY feature, target ORDER BY x) + (count(*) OVER (PARTITION BY feature, target, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY feature, target ORDER BY y) + (count(*) OVER (PARTITION BY feature, target, y) - 1) / 2.0 AS ry FROM f JOIN g USING (video_id))"""


@query(f"WITH {AUDIT_SQL} SELECT feature, target, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM a GROUP BY feature, target")
def j43_confound_audit(table):
    """Spearman of features with targets; the control is the outcome itself, so its row must be 1. Each side is ranked once, not for each pair."""
    v = videos(table).withColumn("age", F.unix_date(F.to_date("published")).cast("double"))
    x = v.select("video_id", "quantity", "discount", F.col("views").alias("control")).select("video_id", *[F.col(c).cast("double").alias(c) for c in ("quantity", "discount", "control")]).unpivot("video_id", ["quantity", "discount", "control"], "feature", "x")
    y = v.select("video_id", F.col("views").cast("double").alias("views"), "age").unpivot("video_id", ["views", "age"], "target", "y")
    both = W.with_average_rank(x, "x", "feature", name="rx").join(W.with_average_rank(y, "y", "target", name="ry"), "video_id")
    return both.groupBy("feature", "target").agg(F.count(F.lit(1)).alias("n"), F.round(S.corr("rx", "ry"), 6).alias("rho"))


@query(f"""WITH {VIDEOS_SQL}, e AS (SELECT video_id, {FOLD_SQL} AS fold, CASE WHEN discount >= 0.03 THEN discount END AS x FROM videos), t AS (SELECT median(x) AS mid FROM e WHERE fold <> 0),
i AS (SELECT video_id, fold, coalesce(x, mid) AS x FROM e, t), s AS (SELECT avg(x) AS m, stddev_pop(x) AS sd FROM i WHERE fold <> 0) SELECT video_id, fold = 0 AS test, round((x - m) / sd, 6) AS z FROM i, s""")
def n14_impute_and_standardise(table):
    """Missing values take the median, all are standardised; median, mean and deviation come from the training folds alone."""
    e = videos(table).select("video_id", fold(), F.when(F.col("discount") >= 0.03, F.col("discount")).alias("x"))
    mid = W.quantiles(e.filter("fold <> 0"), "x", {"mid": 0.5})
    filled = e.join(F.broadcast(mid)).select("video_id", "fold", F.coalesce("x", "mid").alias("x"))
    fitted = filled.filter("fold <> 0").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("sd"))
    return filled.join(F.broadcast(fitted)).select("video_id", (F.col("fold") == 0).alias("test"), F.round((F.col("x") - F.col("m")) / F.col("sd"), 6).alias("z"))


@query("""WITH m AS (SELECT user_id, extract(hour FROM ts)::INT AS point, avg(value) AS y FROM events GROUP BY 1, 2)
SELECT point, count(*) AS sources, round(avg(y), 6) AS mean, round(quantile_cont(y, 0.1), 6) AS low, round(median(y), 6) AS mid, round(quantile_cont(y, 0.9), 6) AS high FROM m WHERE y IS NOT NULL GROUP BY point""")
def i15_source_equal_bands(table):
    """Mean and quantiles over sources at each point of the curve; a source counts once, however many rows it has."""
    m = table("events").groupBy("user_id", F.hour("ts").alias("point")).agg(F.avg("value").alias("y")).filter("y is not null")
    bands = W.quantiles(m, "y", {"low": 0.1, "mid": 0.5, "high": 0.9}, "point")
    return m.groupBy("point").agg(F.count(F.lit(1)).alias("sources"), F.round(F.avg("y"), 6).alias("mean")).join(bands, "point").select("point", "sources", "mean", *r6("low", "mid", "high"))


def _median(values: Column) -> Column:
    s = F.sort_array(values)
    return (F.get(s, F.floor((F.size(values) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(values) / 2).cast("int"))) / 2


@query("""WITH s AS (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS seg FROM events WHERE value IS NOT NULL),
m AS (SELECT *, list_aggregate(seg, 'median') AS mid FROM s), d AS (SELECT *, list_aggregate(list_transform(seg, lambda x: abs(x - mid)), 'median') + 1e-9 AS mad FROM m)
SELECT event_id, value > mid + 3 * 1.4826 * mad AS spike, round(CASE WHEN value > mid + 3 * 1.4826 * mad THEN mid ELSE value END, 6) AS cleaned FROM d""")
def i11_upward_spikes(table):
    """Values far above the median of the seven around them, by three scaled median deviations, become that median; dips stay."""
    seg = F.collect_list("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 3))
    m = table("events").filter("value is not null").select("event_id", "value", seg.alias("seg")).withColumn("mid", _median(F.col("seg")))
    away = m.withColumn("away", F.transform("seg", lambda x: F.abs(x - F.col("mid"))))
    spike = F.col("value") > F.col("mid") + 3 * 1.4826 * (_median(F.col("away")) + 1e-9)
    return away.select("event_id", spike.alias("spike"), F.round(F.when(spike, F.col("mid")).otherwise(F.col("value")), 6).alias("cleaned"))


@query(f"""WITH {VIDEOS_SQL} SELECT CASE WHEN lines <= 3 THEN 'short' ELSE 'long' END || ':' || video_id AS observation, CASE WHEN lines <= 3 THEN 'short' ELSE 'long' END AS format, source, published::DATE AS day, views, quantity, NULL::DOUBLE AS level FROM videos
UNION ALL SELECT 'event:' || event_id, 'event', user_id, ts::DATE, NULL, NULL, value FROM events""")
def a17_unified_panel(table):
    """One panel over formats: an observation is format:id, columns that a format lacks are null."""
    kind = F.when(F.col("lines") <= 3, "short").otherwise("long")
    v = videos(table).select(F.concat_ws(":", kind, "video_id").alias("observation"), kind.alias("format"), "source", F.to_date("published").alias("day"), "views", "quantity")
    e = table("events").select(F.concat_ws(":", F.lit("event"), "event_id").alias("observation"), F.lit("event").alias("format"), F.col("user_id").alias("source"), F.to_date("ts").alias("day"), F.col("value").alias("level"))
    return v.unionByName(e, allowMissingColumns=True)


@query(f"WITH {LONG_SQL}, new AS (SELECT metric || '/' || kind AS run, count(*) AS n, round(corr(value, target), 6) AS r FROM long JOIN (SELECT video_id, kind FROM videos) USING (video_id) GROUP BY metric, kind), old AS (SELECT run, n, -1.0 AS r FROM new WHERE run LIKE 'price/%') SELECT * FROM old UNION ALL SELECT * FROM new WHERE run NOT IN (SELECT run FROM old)")
def a22_experiment_log(table):
    """The log after a run: rows whose key it has already stay as they were logged, only new keys are added."""
    rows = metric_values(table).join(videos(table).select("video_id", "kind"), "video_id")
    new = rows.groupBy("metric", "kind").agg(F.count(F.lit(1)).alias("n"), F.round(S.corr("value", "target"), 6).alias("r")).select(F.concat_ws("/", "metric", "kind").alias("run"), "n", "r")
    old = new.filter(F.col("run").startswith("price/")).withColumn("r", F.lit(-1.0))
    return old.unionByName(new.join(old, "run", "left_anti"))
