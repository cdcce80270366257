"""Exact top-k over many shards: against brute force, and how often a query is sent."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlake.llm import topk


def brute(whole, k=5):
    want = []
    for q in {i for i, _ in whole if i % 50 == 0}:
        found = sorted((-sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), i) for j, a in whole if j == q for i, b in whole if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(want)


def table(spark, whole):
    return spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in whole], "vec_id long, embedding array<double>")


def made(shape):
    rng = np.random.default_rng(5)
    if shape == "apart":
        v = rng.integers(-120, 120, (1200, 24))
    elif shape == "clusters":  # boxes of other clusters are out of reach
        v = rng.integers(-900, 900, (12, 3))[rng.integers(0, 12, 1200)] + rng.integers(-9, 9, (1200, 3))
    elif shape == "ties":  # few scores, so ids decide
        v = rng.integers(0, 2, (1200, 12))
    elif shape == "below zero":
        v = -rng.integers(1, 300, (1200, 4)) * np.where(np.arange(1200) % 50, -1, 1)[:, None]
    else:  # sums beyond 2**24, 2**53 and 2**63 may come
        size = {"doubles": 10**4, "longs": 10**8, "integers": 1.3 * 10**9}[shape]
        v = np.floor(rng.uniform(-size, size, (1200, 6)))
    return [(i, [int(x) for x in r]) for i, r in enumerate(v)]


@pytest.mark.parametrize("shape", ["apart", "clusters", "ties", "below zero", "doubles", "longs", "integers"])
def test_many_shards_give_what_brute_force_gives(spark, monkeypatch, shape):
    monkeypatch.setattr(topk, "SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "LEAF_ROWS", 4)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "GROUPS", 8)
    whole = made(shape)
    kinds = {"doubles": np.float64, "longs": np.int64, "integers": object}
    assert topk.exact_kind(len(whole[0][1]), max(abs(x) for _, v in whole for x in v)) is kinds.get(shape, np.float32)
    assert sorted(map(tuple, topk.top_k(table(spark, whole), F.pmod("vec_id", F.lit(50)) == 0).collect())) == brute(whole)


def test_repeated_ids_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "GROUPS", 4)
    rnd = random.Random(9)
    whole = [(rnd.choice((i, i, i, 50, 51, 100)), [rnd.randint(-60, 60) for _ in range(5)]) for i in range(600)]
    got = sorted(map(tuple, topk.top_k(table(spark, whole), F.pmod("vec_id", F.lit(50)) == 0).collect()))
    assert got == brute(whole)


def test_a_query_goes_once_to_a_group_of_shards(spark, monkeypatch):
    """On vectors apart from each other all shards are reached; the rows sent must not be queries times shards."""
    monkeypatch.setattr(topk, "SHARD_ROWS", 8)
    monkeypatch.setattr(topk, "GROUPS", 8, raising=False)
    sent, visits = [], topk._visits
    monkeypatch.setattr(topk, "_visits", lambda shards, queries, *a: (sent.append((shards.select("shard").distinct().count(), queries.count())), visits(shards, queries, *a))[1])
    whole = [(i, [int(x) for x in r]) for i, r in enumerate(np.random.default_rng(6).integers(-120, 120, (2000, 24)))]
    topk.top_k(table(spark, whole), F.pmod("vec_id", F.lit(50)) == 0).collect()
    (shards, asked), (_, rows) = sent
    assert shards > 50 and asked == 40
    assert rows <= asked * shards / 4


def test_a_leaf_is_one_product_for_all_queries(monkeypatch):
    """1,000 queries that no box shuts out take about as many products as one."""
    rng = np.random.default_rng(7)
    points = rng.integers(-120, 120, (1024, 64)).astype(np.float32)
    tree, products = topk.Tree(points, [[i] for i in range(1024)]), []
    nonzero = np.nonzero
    monkeypatch.setattr(np, "nonzero", lambda x: (products.append(x.shape), nonzero(x))[1])
    queries = rng.integers(-120, 120, (1000, 64)).astype(np.float32)
    best = [[] for _ in queries]
    tree.search(queries, best, np.full(1000, topk.lowest(np.float32), np.float32), 6, 5)
    assert len(products) <= 2 * len(tree.leaves)
    scores = queries.astype(int) @ points.T.astype(int)
    assert best == [sorted((-int(s), i) for i, s in enumerate(r))[:6] for r in scores]
