"""Named metrics: each name has a layer, a description and a rule that gives a value or says why there is none."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from creatorlake.functions import curves

PATTERNS: dict[str, Callable] = {
    r"retention_pct_(\d+)": curves.retention_pct,
    r"retention_mean_(\d+)_(\d+)": curves.retention_mean,
    r"retention_slope_(\d+)_(\d+)": curves.retention_slope,
    r"retention_volatility_(\d+)_(\d+)": curves.retention_volatility,
}


@dataclass(frozen=True)
class Metric:
    name: str
    layer: str
    rule: Callable[[Column], Column]


def metric(name: str) -> Metric:
    """A curve metric by its name, or by a pattern with numbers such as retention_mean_10_40; ValueError if there is none."""
    if name in curves.CURVE_METRICS:
        return Metric(name, "post", curves.CURVE_METRICS[name])
    for pattern, make in PATTERNS.items():
        if m := re.fullmatch(pattern, name):
            numbers = [int(x) for x in m.groups()]
            if all(0 <= x <= 100 for x in numbers) and numbers == sorted(set(numbers)):
                return Metric(name, "post", make(*numbers))
    raise ValueError(f"no metric {name}")


def measured(df: DataFrame, ident: str, curve: str, names: list[str], least: int = 10) -> DataFrame:
    """(ident, metric, value, reason) in one pass; reason is no_curve, short_curve or undefined where value is null."""
    c = F.col(curve)
    why = F.when(c.isNull(), "no_curve").when(F.size(c) < least, "short_curve")
    rows = []
    for name in names:
        value = F.when(why.isNull(), metric(name).rule(c).cast("double"))
        value = F.when(F.isnan(value), None).otherwise(value)
        rows.append(F.struct(F.lit(name).alias("metric"), value.alias("value"), F.coalesce(why, F.when(value.isNull(), F.lit("undefined"))).alias("reason")))
    return df.select(ident, F.explode(F.array(*rows)).alias("__m")).select(ident, "__m.*")


def catalog(spark: SparkSession) -> DataFrame:
    """(name, layer) of all metrics with a fixed name."""
    return spark.createDataFrame([(n, metric(n).layer) for n in sorted(curves.CURVE_METRICS)], "name string, layer string")
