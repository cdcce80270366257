"""Components, neighbours, clusters and monotone fits against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlake.operators.clusters import centroid_distances, gated_clusters, spherical_kmeans
from creatorlake.operators.components import connected_components, exact_edges, mutual_edges, purged
from creatorlake.operators.isotonic import isotonic_fit, isotonic_levels, survival_and_replay
from creatorlake.operators.neighbours import cosine_neighbours, cosine_weighted_mean


def components(edges, nodes=()):
    root = {n: n for e in edges for n in e if None not in e} | {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        if a is not None and b is not None:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {n: find(n) for n in root}


def graph(kind):
    rng = random.Random(3)
    if kind == "path":
        order = list(range(1000))
        rng.shuffle(order)
        return list(zip(order, order[1:], strict=False))
    if kind == "hub":
        return [(7, n) for n in range(100, 1100)] + [(3000 + n, 3001 + n) for n in range(5)]
    return [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(5, 5), (None, 3), (4, None), (1, 2), (2, 1)]


@pytest.mark.parametrize("kind", ["path", "hub", "random"])
def test_components(spark, kind):
    edges = graph(kind)
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {n: c for n, c in components(edges).items() if any(n in e and e[0] != e[1] and None not in e for e in edges)}
    more = spark.createDataFrame([(n,) for n in [*range(50), None, 9999]], "n long")
    every = connected_components(df, more)
    assert {r.node: r.component for r in every.collect()} == {n: components(edges, [*range(50), 9999])[n] for n in [*range(50), 9999]}


def test_components_of_names_and_of_nothing(spark):
    assert {tuple(r) for r in connected_components(spark.createDataFrame([("c", "b"), ("b", "z")], "a string, b string")).collect()} == {("b", "b"), ("c", "b"), ("z", "b")}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_purge_and_edges(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None), (5, None), (6, "y"), (7, "x")], "id long, key string")
    edges = exact_edges(rows, "id", "key")
    assert sorted(map(tuple, edges.collect())) == [(2, 1), (6, 3), (7, 1)]
    left = purged(rows.filter("id > 2"), rows.filter("id <= 2"), connected_components(edges), "id")
    assert sorted(r.id for r in left.collect()) == [3, 4, 5, 6]
    near = spark.createDataFrame([(1, 2, 0.9), (2, 1, 0.9), (1, 3, 0.95), (4, 5, 0.2), (5, 4, 0.2)], "id long, other long, score double")
    assert [tuple(r) for r in mutual_edges(near, 0.5).collect()] == [(1, 2)]


def vectors(n, dim, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim))
    v[5] = v[4]
    v[6] = v[4] * 3
    return v


def table(spark, v):
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, [0.0] * v.shape[1]), (9003, [float("nan")] * v.shape[1]), (9004, [1.0]), (None, v[0].tolist())]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def nearest(v, k):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    return {i: sorted(((-s[i, j], j) for j in range(len(v)) if j != i))[:k] for i in range(len(v))}


@pytest.mark.parametrize("block", [7, 64, 1024])
def test_neighbours(spark, block):
    v = vectors(90, 6)
    got = {}
    for r in cosine_neighbours(table(spark, v), 4, block_rows=block).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((-r.score, r.other))
    assert got == {i: [(pytest.approx(s, abs=2e-9), j) for s, j in x] for i, x in nearest(v, 4).items()}
    some = cosine_neighbours(table(spark, v), 200, queries=F.col("vec_id") == 3, block_rows=block).collect()
    assert len(some) == 89 and {r.id for r in some} == {3}
    assert cosine_neighbours(table(spark, v).limit(0), 3).count() == 0


def test_weighted_mean(spark):
    near = spark.createDataFrame([(1, 2, 0.5), (1, 3, -0.9), (1, 4, 1.0), (2, 3, -0.1), (3, 9, 0.4)], "id long, other long, score double")
    values = spark.createDataFrame([(2, 8.0), (3, 100.0), (4, 2.0), (9, None)], "other long, v double")
    got = [tuple(r) for r in cosine_weighted_mean(near, values, "v").collect()]
    assert got == [(1, pytest.approx((8 * 0.5**8 + 2) / (0.5**8 + 1)), pytest.approx(0.5**8 + 1))]


def test_kmeans_scores_never_fall_and_rows_are_with_the_nearest(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.standard_normal(5) * 3 + rng.standard_normal((60, 5)) for _ in range(4)])
    found = spherical_kmeans(table(spark, v), 4, 6)
    assert all(b >= a - 1e-9 for a, b in zip(found.scores, found.scores[1:], strict=False)) and len(found.scores) == 6
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = np.round(u @ found.centroids.T, 9)
    rows = {r.id: r for r in found.assigned.collect()}
    assert set(rows) == set(range(240))
    for i, r in rows.items():
        assert r.cluster == s[i].argmax() and r.score == pytest.approx(s[i].max()) and r.second == pytest.approx(np.sort(s[i])[-2])
    groups = spark.createDataFrame([(i, i % 3) for i in range(240)], "id long, g long")
    gates = {r.cluster: r for r in gated_clusters(found.assigned, groups, "g", 10, 3, 0.9).collect()}
    assert sum(r.n for r in gates.values()) == 240 and all(r.kept == (r.n >= 10 and r.n_groups >= 3 and r.n <= 216) for r in gates.values())


def test_kmeans_in_batches_few_rows_and_none(spark):
    v = vectors(100, 4)
    assert spherical_kmeans(table(spark, v), 3, 4, share=0.5).assigned.count() == 100
    few = spherical_kmeans(table(spark, v[:2]), 5, 3)
    assert few.centroids.shape == (2, 4) and few.assigned.count() == 2
    assert spherical_kmeans(table(spark, v).limit(0), 5, 3).assigned.count() == 0


def fit(points, rising=True):
    """Max-min formula over distinct x."""
    sign = 1 if rising else -1
    by = {}
    for x, y in points:
        by.setdefault(x, []).append(sign * y)
    xs = sorted(by)
    s, n = np.cumsum([0, *(sum(by[x]) for x in xs)]), np.cumsum([0, *(len(by[x]) for x in xs)])
    mean = lambda a, b: (s[b + 1] - s[a]) / (n[b + 1] - n[a])
    return {x: sign * max(min(mean(a, b) for b in range(i, len(xs))) for a in range(i + 1)) for i, x in enumerate(xs)}


@pytest.mark.parametrize("piece", [4, 16, 65_536])
@pytest.mark.parametrize("shape", ["falling", "rising", "noise", "steps"])
def test_isotonic(spark, shape, piece):
    rng = random.Random(shape)
    y = {"falling": lambda i: -i, "rising": lambda i: i, "noise": lambda i: rng.gauss(i / 40, 1), "steps": lambda i: i // 10 % 3}[shape]
    points = [(float(i if i < 50 else i // 2), float(y(i))) for i in range(80)]
    rows = [("a", *p) for p in points] + [("b", 1.0, 2.0), ("b", 0.5, 3.0), ("a", None, 1.0), ("a", 3.0, None), ("a", 3.0, float("nan")), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    got = {(r.g, r.x): r.fit for r in isotonic_fit(df, "x", "y", "g", piece=piece).collect()}
    assert got == {("a", x): pytest.approx(v) for x, v in fit(points).items()} | {("b", 0.5): 2.5, ("b", 1.0): 2.5}
    if piece == 16:
        down = {r.x: r.fit for r in isotonic_fit(df.filter("g = 'a'").drop("g"), "x", "y", rising=False, piece=piece).collect()}
        assert down == {x: pytest.approx(v) for x, v in fit(points, False).items()}
        levels = isotonic_levels(df, "x", "y", "g", piece=piece).filter("g = 'a'").orderBy("first").collect()
        assert all(a.level < b.level and a.high < b.low and a.last + 1 == b.first for a, b in zip(levels, levels[1:], strict=False)) and sum(r.n for r in levels) == len(points)


def test_survival(spark):
    curve = [1.0, 0.8, 0.9, 0.4, 0.0]
    df = spark.createDataFrame([("u", i, v) for i, v in enumerate(curve)] + [("z", 0, 0.0), ("z", 1, 0.5)], "u string, i int, v double")
    got = {(r.u, r.i): (r.survival, r.replay) for r in survival_and_replay(df, "u", "i", "v").collect()}
    down = fit([(i, v) for i, v in enumerate(curve)], False)
    for i, v in enumerate(curve):
        s = max(down[i], 1e-4) / down[0]
        assert got["u", i] == (pytest.approx(s), pytest.approx(max(v / curve[0] - s, 0)))
    assert got["z", 1] == (1.0, None)


def test_centroid_distances(spark):
    v = vectors(60, 3)
    df = spark.createDataFrame([*[(i, x.tolist(), "abc"[i % 3]) for i, x in enumerate(v)], (90, None, "a"), (91, [1.0] * 3, None), (92, [1.0], "a"), (93, [float("nan")] * 3, "b")], "vec_id long, embedding array<double>, g string")
    means = np.array([v[i::3].mean(axis=0) for i in range(3)])
    d = np.linalg.norm(v[:, None] - means[None], axis=2)
    got = {r.id: r for r in centroid_distances(df, "g").collect()}
    assert set(got) == set(range(60))
    for i, r in got.items():
        other = [x for k, x in enumerate(d[i]) if k != i % 3]
        assert r.nearest == "abc"[d[i].argmin()] and (r.distance, r.own, r.other) == pytest.approx((d[i].min(), d[i, i % 3], min(other)), abs=2e-9)
    assert centroid_distances(df.filter("g = 'a'"), "g").filter("other is not null").count() == 0
    assert centroid_distances(df.limit(0), "g").count() == 0
    with pytest.raises(ValueError, match="too many"):
        centroid_distances(df, "g", most=5)
