"""Hard negatives against all pairs in plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlake.llm import hard_negatives as H
from creatorlake.llm.vectors import inner_products

SCHEMA = "vec_id long, embedding array<double>, label string"


def brute(rows, every=5, positives=5, negatives=3):
    rows = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, v, y in rows:
        if i % every == 0:
            others = [(-dot(v, w), j, z) for j, w, z in rows if j != i]
            for s, j, _ in sorted(o for o in others if o[2] == y)[:positives]:
                fit = sorted(o[:2] for o in others if o[2] != y and 50 * -s <= 100 * -o[0] <= 95 * -s)[:negatives]
                out += [(i, j, n, k, -s, -t) for n, (t, k) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit("x")).withColumn("Q", F.lit(1)).repartition(3)
    return sorted(map(tuple, H.hard_negatives(df, F.col("vec_id") % 5 == 0).collect()))


def shaped(kind):
    rng = random.Random(kind)
    near = lambda c, s: [x + rng.gauss(0, s) for x in c]
    if kind == "clusters":  # a hot label, small clusters, whole copies, repeated ids, shorter and zero vectors
        centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(8)]
        rows = [(i, near(centres[i % 8], 0.3), "a" if i % 3 else str(i % 7)) for i in range(240)]
        return rows + [(1000 + i, centres[0], rng.choice("ab")) for i in range(40)] + rows[:30] + [(5, [1.0, 2.0], "b"), (10, [0.0] * 6, "a"), (15, [0.0], "b")]
    if kind == "grid":  # few different scores: ties everywhere
        return [(i, [rng.choice([-0.5, 0.0, 0.5]) for _ in range(3)], rng.choice("abc")) for i in range(150)]
    if kind == "holes":
        return [(None, [1.0], "a"), (5, None, "a"), (10, [None, 1.0], "a"), (15, [float("nan")], "a"), (20, [float("inf")], "a"), (25, [1.0, 0.5], None), (30, [1.0, 0.5], "a"), (31, [0.9, 0.5], "a"), (32, [0.6, 0.5], "b"), (35, [], "b")]
    if kind == "labels":  # nearly every row has its own label
        return [(i, [rng.random() for _ in range(4)], str(i // 2)) for i in range(200)]
    size = {"wide": 1e6, "huge": 2.5e6}[kind]  # sums beyond 2**53, the second with a worst case beyond 2**63
    return [(i, [rng.gauss(0, size) for _ in range(5)], rng.choice("ab")) for i in range(60)]


@pytest.mark.parametrize("kind", ["clusters", "grid", "holes", "labels", "wide", "huge"])
def test_equals_brute_force(spark, kind, monkeypatch):
    for name, small in (("CELL_ROWS", 16), ("BLOCK_ROWS", 8), ("PAGE_CELLS", 4)):
        monkeypatch.setattr(H, name, small)
    rows = shaped(kind)
    want = brute(rows)
    assert mined(spark, rows) == want
    assert want or kind == "empty"


def test_empty(spark):
    assert mined(spark, []) == []


@pytest.mark.parametrize("dim", [1, 3, 40])
def test_bounds_hold_and_windows_lose_nothing(dim):
    rng = np.random.default_rng(dim)
    points = np.floor(rng.standard_normal((300, dim)) * rng.choice([1, 50, 3000], (300, 1))).astype(np.int64)
    points[:20] = points[0]
    points[20:25] = 0
    anchors = points[::7]
    refs = H.reference_directions(points[:50].astype(float), 4)
    norms, angles = H.angles_to(points, refs)
    scores = inner_products(anchors, points)
    order = np.argsort(angles[:, 0])
    low, high = (f(angles[order].reshape(30, 10, -1), axis=1) for f in (np.min, np.max))
    spread = norms[order].reshape(30, 10)
    least, most = H.score_bounds(norms[::7], angles[::7], (spread.min(1), spread.max(1)), (low, high))
    by_cell = scores[:, order].reshape(len(anchors), 30, 10)
    assert (by_cell.min(2) >= least).all() and (by_cell.max(2) <= most).all()
    for a, b in ((10, 90), (-500, -3), (0, 0), (2000, 10**7)):
        ask = np.full(len(anchors), float(a)), np.full(len(anchors), float(b))
        start, end = H.row_window(norms[::7], angles[::7, 0], *ask, (norms.min(), norms.max()), angles[order, 0])
        for i in range(len(anchors)):
            inside = np.flatnonzero((scores[i, order] >= a) & (scores[i, order] <= b))
            assert not len(inside) or (start[i] <= inside[0] and inside[-1] < end[i])


def test_products_are_exact_or_refused():
    for size in (2**20, 2**30, 2**31 - 1):
        some = np.array([[size, 5], [7, -size]])
        assert inner_products(some, some).tolist() == [[int(a[0]) * int(b[0]) + int(a[1]) * int(b[1]) for b in some] for a in some]
    # the worst case could pass a long, the product itself doesn't
    assert inner_products(np.array([[2**40, 1]]), np.array([[3, 2**40]])).tolist() == [[2**42]]
    with pytest.raises(OverflowError):
        inner_products(np.array([[2**40]]), np.array([[2**40]]))
