"""Experiment families over a long metric table: (video_id, metric, value, target)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.operators.statistics import corr
from creatorlake.operators.windows import quantiles, value_class, value_places, with_average_rank
from creatorlake.sources.steps import step


def unpivoted(df: DataFrame, ident: str, metrics: list[str], target: Column) -> DataFrame:
    """(video_id, metric, value, target), one row for each metric of a row."""
    return df.select(F.col(ident).alias("video_id"), F.explode(F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "value"), target.alias("target"))


def order_in_metric(df: DataFrame, by: list[str] = ["metric"], value: str = "value", ident: str = "video_id") -> DataFrame:
    """df with place (from 0, by value then ident) and n of each group; rows with a null value or ident are left out.

    Rows of smaller values are counted by value_places. Rows of one value are split by classes of the ident, whose counts are
    summed up in order, so that only rows of one value and class meet in a window.
    """
    rows = df.filter(F.col(ident).isNotNull()).withColumn("__class", F.shiftright(value_class(F.col(ident)), 22))
    below = value_places(rows, value, *by)
    ties = rows.groupBy(*by, value, "__class").agg(F.count(F.lit(1)).alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.partitionBy(*by, value).orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = ties.withColumn("__before", before).join(below, [*by, value]).select(*by, value, "__class", (F.col("__below") + F.col("__before")).alias("__start"), F.col("__n").alias("n"))
    inside = F.row_number().over(Window.partitionBy(*by, value, "__class").orderBy(ident)) - 1
    return rows.withColumn("__in", inside).join(start, [*by, value, "__class"]).withColumn("place", F.col("__start") + F.col("__in")).drop("__start", "__in", "__class")


def buckets(df: DataFrame, k: int, by: list[str] = ["metric"]) -> DataFrame:
    """df with bucket 0 to k - 1 of equal size by value; the last takes what is left over. A df that has been through order_in_metric keeps its places."""
    placed = df if {"place", "n"} <= set(df.columns) else order_in_metric(df, by)
    return placed.withColumn("bucket", F.least(F.floor(F.col("place") / F.floor(F.col("n") / k)), F.lit(k - 1)).cast("int")).filter(F.col("n") >= k)


def bucket_curve(df: DataFrame, k: int, by: list[str] = ["metric"]) -> DataFrame:
    """For each metric: share of steps of the same sign as the whole, the span of bucket means, and r of bucket and mean."""
    means = buckets(df, k, by).groupBy(*by, "bucket").agg(F.avg("target").alias("m"))
    step = F.lead("m").over(Window.partitionBy(*by).orderBy("bucket")) - F.col("m")
    a = means.withColumn("step", step).groupBy(*by).agg(F.count_if(F.col("step") > 0).alias("ups"), F.count_if(F.col("step") < 0).alias("downs"), (F.max("m") - F.min("m")).alias("span"), corr("bucket", "m").alias("bucket_r"))
    return a.select(*by, (F.greatest("ups", "downs") / (k - 1)).alias("monotone"), "span", "bucket_r")


def halves(df: DataFrame) -> DataFrame:
    """r in the lower and upper half of each metric."""
    b = buckets(df, 2)
    return b.groupBy("metric").agg(*[corr(F.when(F.col("bucket") == i, F.col("value")), F.when(F.col("bucket") == i, F.col("target"))).alias(n) for i, n in enumerate(("r_low", "r_high"))])


def quarter_steps(df: DataFrame) -> DataFrame:
    """r in each quarter of each metric and the largest change from one to the next."""
    r = buckets(df, 4).groupBy("metric", "bucket").agg(corr("value", "target").alias("r"))
    step = r.withColumn("step", F.col("r") - F.lag("r").over(Window.partitionBy("metric").orderBy("bucket")))
    return step.groupBy("metric").agg(F.max_by("bucket", F.abs("step")).alias("at_bucket"), F.max(F.abs("step")).alias("largest_step"))


def quantile_gap(df: DataFrame) -> DataFrame:
    """Mean target in the top quarter minus that in the bottom quarter."""
    return buckets(df, 4).groupBy("metric").agg((F.avg(F.when(F.col("bucket") == 3, F.col("target"))) - F.avg(F.when(F.col("bucket") == 0, F.col("target")))).alias("gap"))


def pairs(df: DataFrame) -> DataFrame:
    """(a, b, video_id, va, vb, target) for metrics a < b of the same video: as many rows as a video has pairs of metrics."""
    left, right = df.select("video_id", F.col("metric").alias("a"), F.col("value").alias("va"), "target"), df.select("video_id", F.col("metric").alias("b"), F.col("value").alias("vb"))
    return left.join(right, "video_id").filter("a < b")


def pair_correlation(df: DataFrame) -> DataFrame:
    return pairs(df).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), corr("va", "vb").alias("r"))


def conditional_delta(df: DataFrame) -> DataFrame:
    """r of a and the target where b is above its median, minus r where it is not."""
    p = pairs(df)
    mid = quantiles(df, "value", {"mid": 0.5}, "metric").withColumnRenamed("metric", "b")
    r = lambda hit: corr(F.when(hit, F.col("va")), F.when(hit, F.col("target")))
    high = F.col("vb") > F.col("mid")
    return p.join(mid, "b").groupBy("a", "b").agg((r(high) - r(~high)).alias("delta"))


def synergy(df: DataFrame) -> DataFrame:
    """R2 of the target on both metrics minus the sum of their own r2, and what their product adds to that R2; null where metrics, or they and the product, lie on a line."""
    product = F.col("va") * F.col("vb")
    c = pairs(df).groupBy("a", "b").agg(
        corr("va", "target").alias("ra"), corr("vb", "target").alias("rb"), corr("va", "vb").alias("rab"),
        corr(product, "target").alias("rp"), corr(product, "va").alias("rap"), corr(product, "vb").alias("rbp"),
    )
    ra, rb, rp, ab, ap, bp = map(F.col, ("ra", "rb", "rp", "rab", "rap", "rbp"))
    two = F.try_divide(ra**2 + rb**2 - 2 * ra * rb * ab, 1 - ab**2)
    spread = 1 + 2 * ab * ap * bp - ab**2 - ap**2 - bp**2
    three = ra**2 * (1 - bp**2) + rb**2 * (1 - ap**2) + rp**2 * (1 - ab**2) + 2 * ra * rb * (ap * bp - ab) + 2 * ra * rp * (ab * bp - ap) + 2 * rb * rp * (ab * ap - bp)
    return c.select("a", "b", (two - ra**2 - rb**2).alias("synergy"), (F.try_divide(three, spread) - two).alias("product_gain"))


def product_correlation(df: DataFrame) -> DataFrame:
    """r of the product of two metrics with the target."""
    return pairs(df).groupBy("a", "b").agg(corr(F.col("va") * F.col("vb"), "target").alias("r_product"))


def triple_correlation(df: DataFrame) -> DataFrame:
    c = df.select("video_id", F.col("metric").alias("c"), F.col("value").alias("vc"))
    return pairs(df).join(c, "video_id").filter("b < c").groupBy("a", "b", "c").agg(corr(F.col("va") * F.col("vb") * F.col("vc"), "target").alias("r_product"))


def residual_pair(df: DataFrame) -> DataFrame:
    """r of b with what a leaves of the target, from sums alone."""
    c = pairs(df).groupBy("a", "b").agg(corr("va", "target").alias("ra"), corr("vb", "target").alias("rb"), corr("va", "vb").alias("rab"))
    return c.select("a", "b", ((F.col("rb") - F.col("ra") * F.col("rab")) / F.sqrt(1 - F.col("ra") ** 2)).alias("r_residual"))


def rank_pair(df: DataFrame) -> DataFrame:
    """Spearman and Pearson of a pair of metrics, and by how much the first is the stronger; ranks are made once for each metric."""
    ranked = with_average_rank(df, "value", "metric", name="rv")
    left, right = (ranked.select("video_id", F.col("metric").alias(m), F.col("value").alias(f"v{m}"), F.col("rv").alias(f"r{m}")) for m in "ab")
    both = left.join(right, "video_id").filter("a < b").groupBy("a", "b").agg(corr("ra", "rb").alias("rho"), corr("va", "vb").alias("r"))
    return both.select("a", "b", "rho", "r", (F.abs("rho") - F.abs("r")).alias("gap"))


def strength(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size >= 0.5, "strong").when(size >= 0.3, "moderate").when(size >= 0.1, "weak").otherwise("none")


def diverse_top(df: DataFrame, group: str, score: Column, n: int) -> DataFrame:
    """Round-robin over groups by score: each group's best first, then the second bests, up to n rows."""
    return df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(score.desc(), F.col("metric")))).orderBy("turn", score.desc(), "metric").limit(n)


def local_rate(df: DataFrame, ident: str, score: str, label: str, share: int = 20, piece: int = 65_536) -> DataFrame:
    """(ident, rate): the mean label of the rows whose place by score is within one `share`-th of all rows, at least one, of a row's own.

    A row's place is the number of smaller scores; the neighbourhood is [place - radius, place + radius), cut at the ends, its
    rows in order of score and ident. Sums up to each place are made by pieces of the order, and the rate of a score is the difference of two of them, so no
    window slides over all rows. Rows with a null in any column or a NaN score are left out.
    """
    fine = df.select(F.col(ident).alias("video_id"), F.col(score).cast("double").alias("value"), F.col(label).cast("double").alias("__y"), F.lit(0).alias("metric")).dropna()
    placed = step(order_in_metric(fine), "placed").withColumn("__piece", F.expr(f"cast(place as long) div {piece}"))
    inside = F.sum("__y").over(Window.partitionBy("__piece").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pieces = placed.groupBy("__piece").agg(F.sum("__y").alias("__s"))
    before = pieces.select("__piece", F.coalesce(F.sum("__s").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__before"))
    sums = step(placed.withColumn("__in", inside).join(F.broadcast(before), "__piece").select(F.col("place").cast("long").alias("place"), (F.col("__before") + F.col("__in")).alias("sum")), "sums")
    radius = F.greatest(F.lit(1), F.expr(f"cast(n as long) div {share}"))
    scores = placed.groupBy("value").agg(F.min("place").cast("long").alias("__at"), F.first("n").cast("long").alias("n"))
    ends = scores.select("value", F.greatest(F.col("__at") - radius, F.lit(0)).alias("__low"), F.least(F.col("__at") + radius, F.col("n")).alias("__high"))
    up = ends.join(sums.select((F.col("place") + 1).alias("__high"), F.col("sum").alias("__to")), "__high")
    both = up.join(sums.select((F.col("place") + 1).alias("__low"), F.col("sum").alias("__from")), "__low", "left")
    rate = both.select("value", ((F.col("__to") - F.coalesce("__from", F.lit(0.0))) / (F.col("__high") - F.col("__low"))).alias("rate"))
    return placed.select("video_id", "value").join(rate, "value").select(F.col("video_id").alias(ident), "rate")
