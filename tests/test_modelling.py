"""Special functions against exact sums and numeric integrals, models and axes against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlake.operators import models as M
from creatorlake.operators import special as Z
from creatorlake.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_log_gamma(spark):
    xs = [1e-6, 0.1, 0.5, 0.75, 1.0, 1.5, 2.0, 3.7, 10.0, 171.3, 1e4, 1e8]
    got = {r.x: r.y for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", Z.log_gamma(F.col("x")).alias("y")).collect()}
    assert got == {x: pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12) for x in xs}
    assert spark.range(1).select(Z.log_gamma(F.lit(-1.0))).first()[0] is None


def test_t_p_values(spark):
    # two-tailed p by exact formulas for 1, 2 and 4 degrees of freedom, by a fine sum for the others
    def exact(t, n):
        if n == 1:
            return 1 - 2 / math.pi * math.atan(t)
        if n == 2:
            return 1 - t / math.sqrt(2 + t * t)
        x = np.linspace(0, t, 400_001)
        y = (1 + x * x / n) ** (-(n + 1) / 2)
        whole = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi)
        h = x[1] - x[0]
        return 1 - 2 * whole * h / 3 * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum())

    cases = [(t, n) for t in (0.1, 1.0, 2.5, 7.0) for n in (1, 2, 3, 4, 10, 57, 1000, 100_000)]
    df = spark.createDataFrame([(float(t), n) for t, n in cases], "t double, n long")
    got = {(r.t, r.n): r.p for r in df.select("t", "n", Z.t_p_value(F.col("t"), F.col("n")).alias("p")).collect()}
    assert got == {(t, n): pytest.approx(exact(t, n), abs=1e-9) for t, n in cases}
    edges = spark.createDataFrame([(0.0, 5), (1.0, 0), (None, 3)], "t double, n long").select(Z.t_p_value(F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in edges] == [pytest.approx(1.0), None, None]
    r = spark.createDataFrame([(1.0, 10), (-1.0, 10), (0.3, 2), (0.0, 9)], "r double, n long").select(Z.correlation_p_value(F.col("r"), F.col("n"))).collect()
    assert [x[0] for x in r] == [0.0, 0.0, None, pytest.approx(1.0)]


def test_fisher(spark):
    def exact(a, b, c, d):
        r, k, n = a + b, a + c, a + b + c + d
        p = {x: math.comb(r, x) * math.comb(n - r, k - x) for x in range(max(0, r + k - n), min(r, k) + 1)}
        return min(1.0, sum(v for v in p.values() if v <= p[a]) / math.comb(n, k))

    cases = [(3, 1, 1, 3), (1, 9, 11, 3), (0, 5, 5, 0), (0, 0, 3, 4), (10, 10, 10, 10), (200, 150, 180, 260), (2, 0, 0, 0), (0, 0, 0, 0)]
    df = spark.createDataFrame([*cases, (None, 1, 1, 1), (-1, 2, 2, 2)], "a long, b long, c long, d long")
    got = [r[0] for r in df.coalesce(1).select(Z.fisher_p_value(*map(F.col, "abcd"))).collect()]
    assert got[:-2] == [pytest.approx(exact(*c), abs=1e-9) for c in cases] and got[-2:] == [None, None]


def test_logistic_is_at_its_optimum(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((400, 3)) * [1, 50, 1e-3] + [0, 1e4, 5]
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - (x[:, 1] - 1e4) / 40)))).astype(int)
    rows = [(*map(float, r), 3.0, int(t)) for r, t in zip(x, y, strict=True)] + [(None, 1.0, 1.0, 3.0, 1), (1.0, float("nan"), 1.0, 3.0, 0), (1.0, 1.0, 1.0, 3.0, None)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, y int")
    m = M.logistic_model(df, ["a", "b", "c", "same"], "y")
    z = (x - x.mean(0)) / x.std(0)
    z = np.column_stack([np.ones(400), z, np.zeros(400)])
    p = 1 / (1 + np.exp(-z @ m.weights))
    gradient = z.T @ (y - p) - np.array([0, 1, 1, 1, 1]) * m.weights
    assert np.abs(gradient).max() < 1e-6 and m.weights[4] == 0 and m.gradient < 1e-6
    got = [r[0] for r in df.coalesce(1).limit(400).select(m.probability()).collect()]
    assert np.allclose(got, p)
    apart = M.logistic_model(df.withColumn("y", (F.col("a") > 0).cast("int")), ["a"], "y")  # the penalty keeps it finite
    assert np.isfinite(apart.weights).all() and apart.gradient < 1e-6
    assert (M.logistic_model(df.limit(0), ["a"], "y").weights == 0).all()


def vectors():
    rng = np.random.default_rng(3)
    return rng.standard_normal((300, 5)) @ np.diag([5, 3, 1, 0.5, 0.1]) @ np.linalg.qr(rng.standard_normal((5, 5)))[0] + 1000


def table(spark, v):
    return spark.createDataFrame([*[(i, x.tolist()) for i, x in enumerate(v)], (7000, None), (7001, [float("inf")] * 5), (7002, [1.0]), (None, [1.0] * 5)], "vec_id long, embedding array<double>")


def test_axes_grid_and_novelty(spark):
    v = vectors()
    df = table(spark, v)
    found = M.principal_axes(df)
    values, axes = np.linalg.eigh(np.cov(v.T))
    assert np.allclose(found.variances, values[::-1]) and found.rows == 300
    assert np.allclose(np.abs((found.axes * axes.T[::-1]).sum(axis=1)), 1)
    assert (found.axes[np.arange(5), np.abs(found.axes).argmax(axis=1)] > 0).all()
    at = (v - v.mean(0)) @ found.axes[:2].T
    low, high = np.quantile(at, [0.01, 0.99], axis=0)
    cells = {(r.id, r.axis): r.cell for r in M.grid_coordinates(df).collect()}
    want = np.clip((at - low) / (high - low), 0, 1) * 1000
    assert len(cells) == 600 and all(abs(cells[i, a] - want[i, a]) <= 0.5001 for i in range(300) for a in range(2))
    new = {r.id: r for r in M.axis_novelty(df, residuals=(2,)).collect()}
    c = v - v.mean(0)
    full = c @ found.axes.T
    for i in range(300):
        assert new[i].mahalanobis == pytest.approx(math.sqrt(c[i] @ np.linalg.inv(np.cov(v.T)) @ c[i]), rel=1e-6)
        assert new[i].residual_2 == pytest.approx(np.linalg.norm(full[i, 2:]) / np.linalg.norm(c[i]), rel=1e-6)
        assert new[i].from_mean == pytest.approx(1 - v[i] @ v.mean(0) / np.linalg.norm(v[i]) / np.linalg.norm(v.mean(0)), abs=1e-9)


def test_axes_of_nothing_and_of_one_row(spark):
    df = table(spark, vectors())
    assert M.grid_coordinates(df.limit(0)).count() == 0 and M.axis_novelty(df.limit(0)).count() == 0
    one = df.filter("vec_id = 3")
    assert [r.cell for r in M.grid_coordinates(one).collect()] == [500, 500]
    assert M.axis_novelty(one).first().mahalanobis == 0


def test_queries_cover_every_vector(spark):
    ids = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert QUERIES["l18_projection_grid"](spark, SF).count() == 2 * ids
    new = QUERIES["l4_novelty_family"](spark, SF).toPandas()
    assert len(new) == ids and new.notna().all().all()
    v = np.stack(spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"]).astype(float)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.sort(u @ u.T - 9 * np.eye(len(u)), axis=1)[:, ::-1]
    new = new.sort_values("vec_id")
    for k in (5, 15, 50):
        assert np.allclose(new[f"nearest_{k}"], 1 - s[:, :k].mean(axis=1), atol=2e-6)


def test_logistic_query_ranks_better_than_chance(spark):
    got = QUERIES["n15_logistic_model"](spark, SF).toPandas()
    ranks = got["probability"].rank()
    pos = got["high"] == 1
    auc = (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert len(got) == spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().count() and auc > 0.5
