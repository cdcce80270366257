"""Metrics of a retention curve: an array<double> of 100 points, from the first to the last percent of a video."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from creatorlake.functions import arrays as A


def _baseline(c: Column) -> Column:
    """The straight fall from 1 to 0."""
    return F.transform(c, lambda x, i: 1 - i / (F.size(c) - 1))


def _over(c: Column) -> Column:
    return F.zip_with(c, _baseline(c), lambda x, b: x - b)


def _extrema(c: Column, sign: int) -> Column:
    """How many inner points lie strictly above (1) or below (-1) both neighbours."""
    return F.size(F.filter(F.sequence(F.lit(1), F.size(c) - 2), lambda i: (sign * F.get(c, i) > sign * F.get(c, i - 1)) & (sign * F.get(c, i) > sign * F.get(c, i + 1))))


def _drops(c: Column) -> Column:
    return F.transform(A.steps(c), lambda x: F.greatest(-x, F.lit(0.0)))


def _mean_fall(a: Column) -> Column:
    falls = F.filter(a, lambda x: x < 0)
    return F.coalesce(-A.mean(falls), F.lit(0.0))


CURVE_METRICS = {
    "hook_retention_pct": lambda c: A.at(c, 10),
    "final_5pct_retention": lambda c: A.mean(F.slice(c, -5, 5)),
    "mid_video_cliff": lambda c: F.array_max(F.transform(A.steps(c), F.abs)),
    "retention_entropy": A.entropy,
    "hook_drop_rate": lambda c: A.slope(A.part(c, 0, 10)),
    "early_momentum": lambda c: A.at(c, 25) - A.at(c, 10),
    "retention_25pct": lambda c: A.at(c, 25),
    "retention_50pct": lambda c: A.at(c, 50),
    "retention_75pct": lambda c: A.at(c, 75),
    "retention_90pct": lambda c: A.at(c, 90),
    "above_baseline_mean": lambda c: A.mean(_over(c)),
    "peak_count": lambda c: _extrema(c, 1),
    "drop_count": lambda c: A.count(A.steps(c), lambda x: x < -0.03),
    "max_peak_delta": lambda c: F.greatest(F.array_max(A.steps(c)), F.lit(0.0)),
    "max_drop_delta": lambda c: F.greatest(-F.array_min(A.steps(c)), F.lit(0.0)),
    "retention_variance": A.variance,
    "retention_skew": A.skew,
    "hook_payoff_gap": lambda c: A.mean(A.part(c, 95)) - A.at(c, 10),
    "end_recovery_score": lambda c: A.mean(A.part(_over(c), 80, 95)),
    "momentum_zone_length": lambda c: A.longest_run(F.transform(_over(c), lambda x: x >= 0)),
    "retention_recovery_count": lambda c: _extrema(c, -1),
    "above_baseline_area": lambda c: A.total(F.transform(_over(c), lambda x: F.greatest(x, F.lit(0.0)))),
    "below_baseline_area": lambda c: A.total(F.transform(_over(c), lambda x: F.greatest(-x, F.lit(0.0)))),
    "late_drop_severity": lambda c: _mean_fall(A.steps(A.part(c, 60))),
    "retention_concavity": lambda c: A.mean(A.steps(A.steps(c))),
    "retention_quartile_spread": lambda c: A.mean(A.part(c, 75)) / (A.mean(A.part(c, 0, 25)) + 0.01),
    "early_late_drop_ratio": lambda c: A.mean(A.part(_drops(c), 70)) / (A.mean(A.part(_drops(c), 0, 30)) + 0.001),
}


def retention_pct(p: int):
    return lambda c: A.at(c, p)


def retention_mean(low: int, high: int):
    return lambda c: A.mean(A.part(c, low, high))


def retention_slope(low: int, high: int):
    return lambda c: A.slope(A.part(c, low, high))


def retention_volatility(low: int, high: int):
    return lambda c: F.sqrt(A.variance(A.steps(A.part(c, low, high))))


def normalised(c: Column, least: float = 0.02) -> Column:
    """(x - end) / (start - end), the end being the mean of the last 5 percent, three points at least; null if both are too near."""
    tail = F.greatest(F.lit(3), F.ceil(F.size(c) * 0.05).cast("int"))
    end = A.mean(F.slice(c, F.size(c) - tail + 1, tail))
    height = A.at(c, 0) - end
    return F.when(F.abs(height) > least, F.transform(c, lambda x: (x - end) / height))


def geometric_survival(x: Column, seconds: Column) -> Column:
    """Rate per second that leaves x percent after so many seconds."""
    return 100 * F.exp(F.ln(F.greatest(x, F.lit(1e-4)) / 100) / F.greatest(seconds, F.lit(1e-4)))
