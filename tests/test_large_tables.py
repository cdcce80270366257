"""What grows with the table: results at sizes where the whole enumeration would not come back."""

import time
from math import exp, lgamma

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlake.operators import nearest_text
from creatorlake.operators import special as Z
from creatorlake.operators.neighbours import cosine_neighbours
from creatorlake.operators.relational import best_match


def test_fisher_p_of_millions_comes_back(spark):
    a, b, c, d = table = 480_900, 959_100, 11_519_100, 23_040_900
    df = lambda *rows: spark.createDataFrame(rows, "a long, b long, c long, d long").coalesce(1).select(Z.fisher_p_value(*map(F.col, "abcd")))
    df((1, 2, 3, 4)).collect()
    start = time.time()
    got = df(table, (a + 200_000, b - 200_000, c, d)).collect()
    # every one of the 1,440,001 tables took over a minute
    assert time.time() - start < 30
    row, column, n = a + b, a + c, a + b + c + d
    weight = lambda x: -(lgamma(x + 1) + lgamma(row - x + 1) + lgamma(column - x + 1) + lgamma(n - row - column + x + 1))
    weights = [weight(x) for x in range(a - 30_000, a + 30_000)]
    top = max(weights)
    want = sum(exp(w - top) for w in weights if w <= weight(a) + 1e-7) / sum(exp(w - top) for w in weights)
    assert 0 < want < 1 and abs(got[0][0] - want) < 1e-7 and got[1][0] == 0


def shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()


def test_neighbours_shuffle_their_rows_and_lists_a_few_times(spark, tmp_path):
    n, k, rng = 6_000, 20, np.random.default_rng(3)
    v = rng.standard_normal((n, 64)).astype(np.float32)
    # many equal rows: ties go to the smaller ident
    v[: n // 4] = v[0]
    spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "v"))
    # as with tables that are too large to broadcast
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = shuffled(spark)
    got = cosine_neighbours(spark.read.parquet(str(tmp_path / "v")), k, block_rows=64).toPandas().sort_values(["id", "rank"])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
    # every query went to each four of 94 blocks
    assert shuffled(spark) - before < 20e6
    u = v.astype(np.float64)
    u /= np.sqrt((u * u).sum(1))[:, None]
    score = np.round(u @ u.T, 9)
    np.fill_diagonal(score, -np.inf)
    want = np.lexsort((np.broadcast_to(np.arange(n), score.shape), -score), axis=-1)[:, :k]
    assert (got.other.to_numpy().reshape(n, k) == want).all() and (got.score.to_numpy().reshape(n, k) == np.take_along_axis(score, want, 1)).all()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("most", [4, 1000])
def test_best_matches_of_odd_texts(spark, monkeypatch, most):
    monkeypatch.setattr(nearest_text, "ASKED_TEXTS", most)
    monkeypatch.setattr(nearest_text, "TREE_TEXTS", most + 3)
    rng = np.random.default_rng(most)

    def some(n):
        text = lambda: None if rng.random() < 0.05 else "".join(rng.choice(list("abé😀\0 "), rng.integers(0, 7)))
        return [(i, None if rng.random() < 0.03 else int(rng.integers(0, 4)), text()) for i in range(n)]

    left, right = some(80), some(150)
    left += [(500, 9, "a"), (501, 8, "x"), (502, 7, None), (503, 6, "none there")]
    right += [(601, 9, "b"), (602, 8, None), (603, 8, None), (604, 7, "a"), (605, 7, "b")]
    want = {}
    for i, n, a in left:
        met = sorted((-1.0 if None in (a, b) else 1 - edits(a, b) / max(len(a), len(b)) if a or b else 1.0, -j) for j, m, b in right if n is not None and m == n)[::-1]
        if met:
            (s, j), after = met[0], max(met[1][0] if len(met) > 1 else 0.0, 0.0)
            want[i] = (-j, None, None) if s < 0 else (-j, s, s - after)
    frames = [spark.createDataFrame(rows, f"{k} long, nation int, {k}_name string") for k, rows in (("l", left), ("r", right))]
    got = best_match(*frames, "nation", "l", "r", "l_name", "r_name").collect()
    assert len(got) == len(want) and {r.l: (r.r, r.similarity, r.margin) for r in got} == want


def test_best_matches_do_not_meet_every_pair(spark):
    left = spark.range(1000).select(F.col("id").alias("l"), F.lit(1).alias("nation"), F.format_string("Supplier#%09d", F.col("id") * 77).alias("l_name"))
    right = spark.range(60_000).select(F.col("id").alias("r"), F.lit(1).alias("nation"), F.format_string("Customer#%09d", F.col("id") * 3).alias("r_name"))
    start = time.time()
    got = {r.l: (r.r, r.similarity) for r in best_match(left, right, "nation", "l", "r", "l_name", "r_name").collect()}
    # 60 million pairs took some minutes
    assert time.time() - start < 60
    assert len(got) == 1000 and all(got[i] == (i * 77 // 3, 1 - edits("Supplier", "Customer") / 18) for i in range(0, 1000, 3) if i * 77 < 180_000)
