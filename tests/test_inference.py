import numpy as np
import pytest

from creatorlake.operators.resampling import bootstrap_mean, sign_flip
from creatorlake.operators.validation import ridge_out_of_fold


def test_bootstrap_interval_is_about_the_normal_one(spark):
    x = np.random.default_rng(0).normal(10, 2, 2000)
    df = spark.createDataFrame([("g", i, float(v)) for i, v in enumerate(x)], "g string, i long, v double")
    r = bootstrap_mean(df, ["g"], "v", ["i"]).first()
    half = 1.96 * x.std() / len(x) ** 0.5
    assert r.mean == pytest.approx(x.mean()) and (r.high - r.low) / 2 == pytest.approx(half, rel=0.25)


def test_sign_flip_tells_a_shift_from_none(spark):
    rng = np.random.default_rng(1)
    rows = [("none", i, float(v)) for i, v in enumerate(rng.normal(0, 1, 200))] + [("shift", i, float(v)) for i, v in enumerate(rng.normal(1, 1, 200))]
    p = {r.g: r.p for r in sign_flip(spark.createDataFrame(rows, "g string, i long, v double"), ["g"], "i", "v").collect()}
    assert p["shift"] < 0.01 < p["none"]


def test_ridge_is_numpys(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 300)
    df = spark.createDataFrame([(i, i % 3, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "i long, fold int, a double, b double, c double, y double")
    got = {r.i: r.guess for r in ridge_out_of_fold(df, ["a", "b", "c"], "y", "fold", 1.0).collect()}
    for k in range(3):
        train = np.arange(300) % 3 != k
        m, s = x[train].mean(0), x[train].std(0)
        z = (x[train] - m) / s
        w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y[train] - y[train].mean()))
        for i in np.flatnonzero(~train):
            assert got[i] == pytest.approx(y[train].mean() + (x[i] - m) / s @ w)
