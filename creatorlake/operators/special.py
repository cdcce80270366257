"""Special functions as columns: log-gamma, the incomplete beta function, and p-values made of them."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Lanczos' series for g = 7.
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)
#: Coefficients of Stirling's series in 1 / x for x from 8, as the C library has them.
STIRLING = (
    8.33333333333329678849e-02, -2.77777777728775536470e-03, 7.93650558643019558500e-04,
    -5.95187557450339963135e-04, 8.36339918996282139126e-04, -1.63092934096575273989e-03,
)
STEPS = 300


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for x > 0; null elsewhere."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (y + i)
    t = y + 7.5
    at = F.lit(0.5 * log(2 * pi)) + (y + 0.5) * F.ln(t) - t + F.ln(series)
    # below one half the series loses digits: gamma(x) = gamma(x + 1) / x
    up = series_of(x) - F.ln(x)
    return F.when(x >= 0.5, at).when(x > 0, up)


def series_of(x: Column) -> Column:
    """ln of gamma(x + 1)."""
    series = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (x + i)
    t = x + 7.5
    return F.lit(0.5 * log(2 * pi)) + (x + 0.5) * F.ln(t) - t + F.ln(series)


def log_factorial(n: Column) -> Column:
    """ln of n!: from 7 on by Stirling's series, whose error stays that of one rounding when n goes into millions."""
    n = n.cast("double")
    x = n + 1
    y = 1 / (x * x)
    series = F.lit(STIRLING[-1])
    for c in STIRLING[-2::-1]:
        series = c + y * series
    return F.when(n >= 7, (x - 0.5) * (F.ln(x) - 1) + (4.18938533204672725052e-01 + series / x)).otherwise(series_of(n))


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by STEPS of Lentz' method; it stands still once it has converged."""
    tiny = 1e-300
    solid = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def turn(s: Column, numerator: Column) -> Column:
        d = 1 / solid(1 + numerator * s["d"])
        c = solid(1 + numerator / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * d * c).alias("h"))

    def both(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # each step is made once: a struct in an array of one is a value of its own
        first = F.transform(F.array(s), lambda t: turn(t, even))
        return F.element_at(F.transform(first, lambda t: turn(t, odd)), 1)

    d = 1 / solid(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d.alias("d"), d.alias("h"))
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(STEPS)), lambda m: m.cast("double")), start, both)["h"]


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function for a, b > 0 and x from 0 to 1; null for nulls and values outside."""
    a, b, x = (c.cast("double") for c in (a, b, x))
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    low = x < (a + 1) / (a + b + 2)
    # one fraction for both halves
    p, q, at = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)
    share = front * _fraction(p, q, at) / p
    fine = (a > 0) & (b > 0)
    return F.when(fine & (x == 0), F.lit(0.0)).when(fine & (x == 1), F.lit(1.0)).when(fine & (x > 0) & (x < 1), F.when(low, share).otherwise(1 - share))


def t_p_value(t: Column, freedom: Column) -> Column:
    """Two-tailed p of Student's t; null without a degree of freedom."""
    n = freedom.cast("double")
    return F.when(n > 0, incomplete_beta(n / 2, F.lit(0.5), n / (n + t.cast("double") * t.cast("double"))))


def correlation_p_value(r: Column, n: Column) -> Column:
    """Two-tailed p of a correlation over n pairs; 0 for a perfect one, null for fewer than three pairs."""
    t = r * F.sqrt((n - 2) / (1 - r * r))
    return F.when(n > 2, F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_p_value(t, n - 2)))


def fisher_p_value(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of the fourfold table a, b / c, d: all tables of the same margins that are no likelier, by log factorials.

    Null where a count is null or negative; 1 where a margin is empty. Its work grows with the root of the smallest margin:
    by Hoeffding's bound tables further than 20 roots from the expected one have less than exp(-800), which is zero as a double.
    """
    a, b, c, d = (x.cast("long") for x in (a, b, c, d))
    row, column, total = a + b, a + c, a + b + c + d
    margins = log_factorial(row) + log_factorial(total - row) + log_factorial(column) + log_factorial(total - column) - log_factorial(total)

    def weight(x: Column, s: Column) -> Column:
        return -(log_factorial(x) + log_factorial(s["row"] - x) + log_factorial(s["column"] - x) + log_factorial(s["total"] - s["row"] - s["column"] + x))

    def tail(s: Column) -> Column:
        middle = F.coalesce(s["row"].cast("double") * s["column"] / F.nullif(s["total"], F.lit(0)), F.lit(0.0))
        far = 20 * F.sqrt(F.least(s["row"], s["column"], s["total"] - s["row"], s["total"] - s["column"])) + 2
        low = F.greatest(F.lit(0), s["row"] + s["column"] - s["total"], F.floor(middle - far).cast("long"))
        high = F.least(s["row"], s["column"], F.ceil(middle + far).cast("long"))
        own = F.transform(F.array(s), lambda t: F.struct(weight(t["a"], t).alias("own"), t["margins"].alias("margins")))
        weights = F.transform(F.sequence(low, high), lambda x: weight(x, s))
        return F.element_at(F.transform(own, lambda o: F.aggregate(weights, F.lit(0.0), lambda t, w: t + F.when(w <= o["own"] + 1e-7, F.exp(w + o["margins"])).otherwise(0.0))), 1)

    # what each step reads is made once: a struct in an array of one is a value of its own
    table = F.struct(a.alias("a"), row.alias("row"), column.alias("column"), total.alias("total"), margins.alias("margins"))
    p = F.element_at(F.transform(F.array(table), tail), 1)
    return F.when((F.least(a, b, c, d) >= 0) & (a + b + c + d).isNotNull(), F.least(p, F.lit(1.0)))
