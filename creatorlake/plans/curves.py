"""Curve operators (I) and curve metrics. A customer's 100 percent-buckets of spending over their own time are the curve."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creatorlake.functions import arrays as A
from creatorlake.functions import curves as C
from creatorlake.plans.registry import query

#: A fixed-length curve for each user: mean value of the events in each of 100 equal parts of the user's time, over 100.
CURVES_SQL = """
span AS (SELECT user_id, min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events GROUP BY user_id HAVING max(epoch_us(ts)) > min(epoch_us(ts))),
bucket AS (SELECT user_id, least(floor((epoch_us(ts) - a) * 100.0 / (b - a)), 99)::INT AS i, round(avg(value) / 100, 6) AS v FROM events JOIN span USING (user_id) GROUP BY 1, 2),
pts AS (SELECT s.user_id, g.i, coalesce(v, 0) AS v FROM span s CROSS JOIN (SELECT unnest(range(100))::INT AS i) g LEFT JOIN bucket ON bucket.user_id = s.user_id AND bucket.i = g.i),
curve AS (SELECT user_id, list(v ORDER BY i) AS c FROM pts GROUP BY user_id)"""


def curves(table):
    """(user_id, c): a user's events are averaged by bucket before they are put together, so a curve never costs more than 100 values."""
    e = table("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "value")
    span = e.groupBy("user_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("b > a")
    i = F.least(F.floor((F.col("t") - F.col("a")) * 100.0 / (F.col("b") - F.col("a"))), F.lit(99)).cast("int")
    means = e.join(span, "user_id").groupBy("user_id", i.alias("i")).agg(F.avg("value").alias("v")).withColumn("v", A.rounded(F.col("v") / 100, 6))
    by = means.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return by.select("user_id", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("c"))


def base(i):
    return f"(1 - ({i} - 1) / 99.0)"


STEP = "list_transform(range(2, 101), lambda i: c[i] - c[i - 1])"
OVER = "list_transform(range(1, 101), lambda i: c[i] - (1 - (i - 1) / 99.0))"
METRIC_SQL = {
    "hook_retention_pct": "c[11]",
    "final_5pct_retention": "list_avg(c[96:100])",
    "mid_video_cliff": f"list_max(list_transform({STEP}, lambda x: abs(x)))",
    "retention_entropy": "-list_sum(list_transform(list_filter(c, lambda x: x <> 0), lambda x: abs(x) / list_sum(list_transform(c, lambda y: abs(y))) * log2(abs(x) / list_sum(list_transform(c, lambda y: abs(y))))))",
    "hook_drop_rate": "list_sum(list_transform(range(1, 11), lambda i: (i - 5.5) * c[i])) / 82.5",
    "early_momentum": "c[26] - c[11]",
    "retention_25pct": "c[26]",
    "retention_50pct": "c[51]",
    "retention_75pct": "c[76]",
    "retention_90pct": "c[91]",
    "above_baseline_mean": f"list_avg({OVER})",
    "peak_count": "len(list_filter(range(2, 100), lambda i: c[i] > c[i - 1] AND c[i] > c[i + 1]))",
    "drop_count": f"len(list_filter({STEP}, lambda x: x < -0.03))",
    "max_peak_delta": f"greatest(list_max({STEP}), 0)",
    "max_drop_delta": f"greatest(-list_min({STEP}), 0)",
    "retention_variance": "list_var_pop(c)",
    "retention_skew": "CASE WHEN list_var_pop(c) > 0 THEN list_avg(list_transform(c, lambda x: power(x - list_avg(c), 3))) / power(list_var_pop(c), 1.5) ELSE 0 END",
    "hook_payoff_gap": "list_avg(c[96:100]) - c[11]",
    "end_recovery_score": f"list_avg(({OVER})[81:95])",
    "retention_recovery_count": "len(list_filter(range(2, 100), lambda i: c[i] < c[i - 1] AND c[i] < c[i + 1]))",
    "above_baseline_area": f"list_sum(list_transform({OVER}, lambda x: greatest(x, 0)))",
    "below_baseline_area": f"list_sum(list_transform({OVER}, lambda x: greatest(-x, 0)))",
    "late_drop_severity": "coalesce(-list_avg(list_filter(list_transform(range(62, 101), lambda i: c[i] - c[i - 1]), lambda x: x < 0)), 0)",
    "retention_concavity": "((c[100] - c[99]) - (c[2] - c[1])) / 98",
    "retention_quartile_spread": "list_avg(c[76:100]) / (list_avg(c[1:25]) + 0.01)",
    "early_late_drop_ratio": f"list_avg(list_transform(({STEP})[71:99], lambda x: greatest(-x, 0))) / (list_avg(list_transform(({STEP})[1:30], lambda x: greatest(-x, 0))) + 0.001)",
}


@query(f"WITH {CURVES_SQL} SELECT user_id, " + ", ".join(f"round(({s})::DOUBLE, 9) AS {n}" for n, s in METRIC_SQL.items()) + " FROM curve")
def i_curve_metrics(table):
    c = F.col("c")
    return curves(table).select("user_id", *[F.round(C.CURVE_METRICS[n](c).cast("double"), 9).alias(n) for n in METRIC_SQL])


@query(f"""WITH {CURVES_SQL}, f AS (SELECT user_id, i, v >= 1 - i / 99.0 AS up FROM pts), g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) - row_number() OVER (PARTITION BY user_id, up ORDER BY i) AS k FROM f),
r AS (SELECT user_id, count(*) AS n FROM g WHERE up GROUP BY user_id, k) SELECT c.user_id, coalesce(max(n), 0)::INT AS momentum_zone_length FROM curve c LEFT JOIN r USING (user_id) GROUP BY c.user_id""")
def i_momentum_zone(table):
    return curves(table).select("user_id", C.CURVE_METRICS["momentum_zone_length"](F.col("c")).alias("momentum_zone_length"))


@query(f"WITH {CURVES_SQL} SELECT user_id, c[31] AS pct_30, round(list_avg(c[11:40]), 9) AS mean_10_40, round(list_sum(list_transform(range(1, 21), lambda i: (i - 10.5) * c[20 + i])) / 665, 9) AS slope_20_40, round(list_stddev_pop(list_transform(range(52, 81), lambda i: c[i] - c[i - 1])), 9) AS volatility_50_80 FROM curve")
def i4_parameterised_curve_metrics(table):
    c = F.col("c")
    return curves(table).select("user_id", C.retention_pct(30)(c).alias("pct_30"), F.round(C.retention_mean(10, 40)(c), 9).alias("mean_10_40"), F.round(C.retention_slope(20, 40)(c), 9).alias("slope_20_40"), F.round(C.retention_volatility(50, 80)(c), 9).alias("volatility_50_80"))


@query(f"WITH {CURVES_SQL}, e AS (SELECT user_id, c, list_avg(c[96:100]) AS e FROM curve) SELECT user_id, list_transform(c, lambda x: round((x - e) / (c[1] - e), 4)) AS shape FROM e WHERE abs(c[1] - e) > 0.02")
def i5_affine_normalised(table):
    out = curves(table).select("user_id", C.normalised(F.col("c")).alias("s")).filter("s is not null")
    return out.select("user_id", F.transform("s", lambda x: A.rounded(x, 4)).alias("shape"))


@query(f"WITH {CURVES_SQL}, h AS (SELECT i, ln(greatest(lead(v) OVER (PARTITION BY user_id ORDER BY i), 0.001) / greatest(v, 0.001)) AS h FROM pts) SELECT i, round(avg(h), 6) AS hazard FROM h WHERE i < 99 GROUP BY i")
def i9_hazard_baseline(table):
    c = F.transform("c", lambda x: F.greatest(x, F.lit(0.001)))
    steps = F.zip_with(F.slice(c, 2, 99), F.slice(c, 1, 99), lambda y, x: F.ln(y / x))
    return curves(table).select(F.posexplode(steps).alias("i", "h")).groupBy("i").agg(F.round(F.avg("h"), 6).alias("hazard"))


@query(f"WITH {CURVES_SQL}, m AS (SELECT i, avg(v) AS m FROM pts GROUP BY i) SELECT i, round(sum(m) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) AS remaining FROM m")
def i10_watch_time_priority(table):
    m = curves(table).select(F.posexplode("c").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
    return m.select("i", F.round(F.sum("m").over(Window.orderBy("i").rowsBetween(Window.currentRow, Window.unboundedFollowing)), 9).alias("remaining"))


@query("SELECT o_orderkey, round(100 * exp(ln(greatest(o_totalprice / 10000, 1e-4) / 100) / greatest(o_orderkey % 60, 1e-4)), 9) AS rate FROM orders")
def i13_geometric_survival(table):
    return table("orders").select("o_orderkey", F.round(C.geometric_survival(F.col("o_totalprice") / 10000, F.col("o_orderkey") % 60), 9).alias("rate"))


@query(f"WITH {CURVES_SQL} SELECT user_id, (i // 10)::INT AS bin, round(avg(v), 9) AS mean FROM pts GROUP BY 1, 2")
def i18_binned_means(table):
    return curves(table).select("user_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: F.struct(b.alias("bin"), F.round(A.mean(F.slice("c", b * 10 + 1, F.lit(10))), 9).alias("mean")))).alias("x")).select("user_id", "x.*")


@query("WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT user_id, n, row_number() OVER (PARTITION BY user_id ORDER BY day) - 1 AS i FROM d) SELECT user_id, round(log10(sum(n) FILTER (i < 7) + 1), 6) AS view_accel_7day, round(sum(n) FILTER (i BETWEEN 7 AND 13) / (sum(n) FILTER (i < 7) + 1), 6) AS week2_ratio, round(sum(n) FILTER (i = 0) / sum(n) FILTER (i < 7), 6) AS view_day1_share FROM r GROUP BY user_id")
def i_daily_view_metrics(table):
    d = table("events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    r = d.withColumn("i", F.row_number().over(Window.partitionBy("user_id").orderBy("day")) - 1)
    s = lambda test: F.sum(F.when(test, F.col("n")))
    first = s(F.col("i") < 7)
    return r.groupBy("user_id").agg(F.round(F.log10(first + 1), 6).alias("view_accel_7day"), F.round(s(F.col("i").between(7, 13)) / (first + 1), 6).alias("week2_ratio"), F.round(s(F.col("i") == 0) / first, 6).alias("view_day1_share"))
