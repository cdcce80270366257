"""NN-descent and graph search against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlake.llm.nn_descent import nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, every, k):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    dim = max((len(v) for _, v in rows), default=0)
    at = [(i, np.array(list(v) + [0.0] * (dim - len(v)))) for i, v in rows]
    out = {}
    for i, v in at:
        if i % every == 0:
            out.setdefault(i, []).extend((float(np.sqrt(((v - w) ** 2).sum())), j) for j, w in at if j != i)
    return {i: sorted(x)[:k] for i, x in out.items()}


def found(spark, rows, every, k=10, **graph):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("node", F.lit("x")).withColumn("Q", F.lit(1)).repartition(3)
    out = {}
    for r in nearest_neighbours(df, F.col("vec_id") % every == 0, k, **graph).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def recall(got, want):
    return sum(len({j for _, j in got.get(i, [])} & {j for _, j in x}) for i, x in want.items()) / sum(map(len, want.values()))


def test_recall_and_exact_scores(spark):
    """A third of the rows close to one vector, whole copies, repeated ids, rows that take no part; small leaves and parts, so that many are made."""
    rng = np.random.default_rng(7)
    v = rng.standard_normal((900, 16))
    v[:300] = v[0] + 0.05 * rng.standard_normal((300, 16))
    v[800:830] = v[800]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(40, v[5].tolist()), (45, v[700].tolist()), (45, v[700].tolist())]
    rows += [(None, [1.0]), (1000, None), (1020, [0.0] * 16), (1040, []), (1060, [float("nan")] * 16), (1080, [None, 1.0]), (1100, [1.0, 2.0])]
    got, want = found(spark, rows, 20, leaf_rows=128, part_rows=16), brute(rows, 20, 10)
    assert set(got) == set(want) and recall(got, want) >= 0.95
    exact = {i: dict() for i in want}
    for i, x in brute(rows, 20, len(rows)).items():
        exact[i] = {}
        for s, j in x:
            exact[i].setdefault(j, []).append(s)
    for i, x in got.items():
        assert x == sorted(x) and len(x) == 10
        assert all(any(s == pytest.approx(t, abs=1e-12) for t in exact[i][j]) for s, j in x)


def test_copies_are_found_by_smallest_id(spark):
    rows = [(i, [1.0, 2.0]) for i in range(30)] + [(100 + i, [float(i), 5.0]) for i in range(20)]
    got, want = found(spark, rows, 10), brute(rows, 10, 10)
    for i in (0, 10, 20):
        assert got[i] == [(0.0, j) for j in range(11) if j != i][:10] == want[i]


def test_few_rows_and_none(spark):
    assert found(spark, [], 1) == {}
    assert found(spark, [(1, [0.0]), (2, None)], 1) == {}
    assert found(spark, [(3, [2.0])], 1) == {}
    assert found(spark, [(3, [2.0, 0.0]), (4, [5.0, 4.0])], 1) == {3: [(5.0, 4)], 4: [(5.0, 3)]}
