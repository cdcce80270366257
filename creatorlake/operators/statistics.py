"""Correlation, inference, calibration and multiple testing, as grouped aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.operators.windows import value_places, with_average_rank
from creatorlake.sources.steps import step

Z95 = 1.959963984540054


def finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))


def corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the rows where both are known; null, not an error, where either is constant."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson(df: DataFrame, by: list[str], x: str = "value", y: str = "target", least: int = 3) -> DataFrame:
    """r, n and the Fisher interval for each group; all but n are null below `least` rows."""
    sums = df.filter(finite(x) & finite(y)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr(x, y).alias("r"))
    z, half = F.atanh("r"), Z95 / F.sqrt(F.col("n") - 3)
    enough = (F.col("n") >= least) & (F.col("n") > 3) & (F.abs("r") < 1)
    return sums.select(*by, "n", F.when(F.col("n") >= least, F.col("r")).alias("r"), F.when(enough, F.tanh(z - half)).alias("low"), F.when(enough, F.tanh(z + half)).alias("high"))


def spearman(df: DataFrame, by: list[str], x: str = "value", y: str = "target") -> DataFrame:
    """rho of tie-averaged ranks for each group. The rows are made once; the ranks of both columns come from one pass over their values."""
    rows = step(df.filter(finite(x) & finite(y)).select(*by, F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y")), "rows")
    both = rows.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("__x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("__y").alias("v")))).alias("s")).select(*by, F.col("s.side").alias("__side"), F.col("s.v").alias("__v"))
    ranks = step(value_places(both, "__v", *by, "__side").select(*by, "__side", "__v", (F.col("__below") + (F.col("__c") + 1) / 2).alias("__r")), "ranks")
    side = lambda n, v, r: ranks.filter(F.col("__side") == n).select(*by, F.col("__v").alias(v), F.col("__r").alias(r))
    ranked = rows.join(side(0, "__x", "__rx"), [*by, "__x"]).join(side(1, "__y", "__ry"), [*by, "__y"])
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr("__rx", "__ry").alias("rho"))


def line(df: DataFrame, by: list[str], x: str = "value", y: str = "target") -> DataFrame:
    return df.filter(finite(x) & finite(y)).groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), corr(x, y).alias("r"))


def normal_p(z: Column) -> Column:
    """Two-sided p of a standard normal by the logistic approximation."""
    return 2 / (1 + F.exp(1.702 * F.abs(z)))


def benjamini_hochberg(df: DataFrame, p: str, *by: str, q: str = "q", yekutieli: bool = False) -> DataFrame:
    """Adjusted p-values within each group of tests."""
    over = Window.partitionBy(*by)
    m, rank = F.count(F.lit(1)).over(over), F.row_number().over(over.orderBy(p))
    ranked = df.withColumn("__m", m).withColumn("__k", rank)
    factor = F.aggregate(F.sequence(F.lit(1), F.col("__m").cast("int")), F.lit(0.0), lambda a, i: a + 1 / i) if yekutieli else F.lit(1.0)
    up = over.orderBy(F.col("__k")).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn(q, F.least(F.lit(1.0), F.min(F.col(p) * F.col("__m") / F.col("__k") * factor).over(up))).drop("__m", "__k")


def holm(df: DataFrame, p: str, *by: str, q: str = "q") -> DataFrame:
    over = Window.partitionBy(*by)
    ranked = df.withColumn("__m", F.count(F.lit(1)).over(over)).withColumn("__k", F.row_number().over(over.orderBy(p)))
    down = over.orderBy("__k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn(q, F.least(F.lit(1.0), F.max((F.col("__m") - F.col("__k") + 1) * F.col(p)).over(down))).drop("__m", "__k")


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p = hits / n
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return middle - half, middle + half


def cohens_d(df: DataFrame, by: list[str], flag: str, value: str) -> DataFrame:
    """Difference of the means of flagged and other rows over the pooled deviation."""
    a = df.groupBy(*by).agg(*[f(F.when(F.col(flag) == k, F.col(value))).alias(f"{n}{k}") for k in (1, 0) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = F.sqrt(((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2))
    return a.select(*by, ((F.col("m1") - F.col("m0")) / pooled).alias("d"))


def roc_auc(df: DataFrame, by: list[str], score: str, label: str) -> DataFrame:
    """Area under the curve from rank sums."""
    ranked = with_average_rank(df.select(*by, score, label), score, *by, name="__r")
    a = ranked.groupBy(*by).agg(F.sum(F.when(F.col(label) == 1, F.col("__r"))).alias("s"), F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return a.select(*by, F.when((F.col("p") > 0) & (F.col("q") > 0), (F.col("s") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q"))).alias("auc"))


def eta_squared(df: DataFrame, group: str, value: str) -> DataFrame:
    """Share of the value's variance that lies between groups: two sums, nothing is gathered."""
    parts = df.groupBy(group).agg(F.count(value).alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"))
    t = parts.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"))
    return t.select(((F.col("b") - F.col("s") ** 2 / F.col("n")) / (F.col("q") - F.col("s") ** 2 / F.col("n"))).alias("eta2"))


def errors(df: DataFrame, by: list[str], truth: str, guess: str) -> DataFrame:
    e = F.col(guess) - F.col(truth)
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"), (1 - F.sum(e * e) / (F.var_pop(truth) * F.count(truth))).alias("r2"))


def variance_components(df: DataFrame, source: str, value: str) -> DataFrame:
    """Variance between sources, mean variance inside them, and the share of the former."""
    inside = df.groupBy(source).agg(F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count(value).alias("n"))
    a = inside.agg((F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - (F.sum(F.col("n") * F.col("m")) / F.sum("n")) ** 2).alias("between_var"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("within_var"))
    return a.withColumn("share", F.col("between_var") / (F.col("between_var") + F.col("within_var")))
