"""Partitions against all cuts, change points against their rule, the causal decomposition against brute force and as a restarted stream."""

import itertools
import random
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from creatorlake.operators.sequences import best_cuts, change_points, optimal_partitions, segments
from creatorlake.streaming.decomposition import LEAST, Decomposer, decomposed, decomposed_stream


def error(values, starts):
    ends = [*starts[1:], len(values)]
    return sum(((np.array(values[s:e]) - np.mean(values[s:e])) ** 2).sum() for s, e in zip(starts, ends, strict=True))


@pytest.mark.parametrize("seed", range(6))
def test_partitions_are_the_best_of_all_cuts(seed):
    rng = random.Random(seed)
    values = [rng.choice([0.0, 1.0, 5.0, 1e6]) + rng.random() for _ in range(rng.randint(1, 9))]
    found = best_cuts(np.array(values), 99)
    assert len(found) == len(values)
    for k, (cost, starts) in enumerate(found, 1):
        best = min(error(values, [0, *cut]) for cut in itertools.combinations(range(1, len(values)), k - 1))
        assert len(starts) == k and starts[0] == 0 and starts == sorted(set(starts))
        assert cost == pytest.approx(best, rel=1e-6, abs=1e-3) and error(values, starts) == pytest.approx(best, rel=1e-6, abs=1e-3)


def test_partitions_of_rows(spark):
    rows = [("a", [1.0, 1.0, 9.0, 9.0, 9.0, 2.0]), ("b", [None, 4.0, float("nan")]), ("c", []), ("d", None), ("a", [3.0, 3.0])]
    got = sorted(tuple(r) for r in optimal_partitions(spark.createDataFrame(rows, "id string, v array<double>"), "id", "v", 3).collect())
    assert [(i, k, s) for i, k, _, s in got if (i, k) != ("a", 1)] == sorted([("a", 2, [0, 1]), ("a", 2, [0, 2]), ("a", 3, [0, 2, 5]), ("b", 1, [0])], key=lambda r: (r[0], r[1], [c for i, k, c, s in got if (i, k, s) == r]))
    assert next(c for i, k, c, s in got if k == 3) == pytest.approx(0)


def test_change_points(spark):
    rng = random.Random(4)
    rows = [(u, i, None if i == 0 else 50.0 if (u, i) == (1, 7) else float(rng.choice([1, 2, 2, 3]))) for u in range(4) for i in range(30)]
    df = spark.createDataFrame(rows, "u int, i int, d double")
    null = [d for *_, d in rows if d is not None]
    got = {(r.u, r.i): r for r in change_points(df, "u", "i", "d", 0.6).collect()}
    assert set(got) == {(u, i) for u, i, d in rows if d is not None}
    for u in range(4):
        own = sorted(((1 + sum(n >= d for n in null)) / (len(null) + 1), i) for v, i, d in rows if v == u and d is not None)
        for k, (p, i) in enumerate(own):
            assert got[u, i].p == pytest.approx(p)
            assert got[u, i].q == pytest.approx(min(1, *(x * len(own) / (n + 1) for n, (x, _) in enumerate(own) if n >= k)))
    cuts = change_points(df, "u", "i", "d", 0.6).filter("cut")
    assert [(r.u, r.i) for r in cuts.collect()] == [(1, 7)]
    parts = sorted(tuple(r) for r in segments(df, cuts, "u", "i").collect())
    assert parts == sorted([(u, 0, 0, 29, 30) for u in (0, 2, 3)] + [(1, 0, 0, 6, 7), (1, 1, 7, 29, 23)])
    outside = change_points(df.filter("u = 1"), "u", "i", "d", 0.6, null=df.filter("u = 0"))
    assert {r.p for r in outside.filter("i = 7").collect()} == {1 / 30}


def tokens(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice([0.05, 0.5, 0.9, rng.random()]), rng.random() < 0.6) for i in range(n)]


def closed(rows, window=8, ahead=2, longest=4):
    d = Decomposer(window, ahead, longest)
    out = [c for r in rows for c in d.push(*r)]
    return out, out + list(d.finish())


@pytest.mark.parametrize("seed", range(8))
def test_components_cover_all_and_are_causal(seed):
    rows = tokens(60, seed)
    early, whole = closed(rows)
    assert [s for s, _, _ in whole] == [0, *(e for _, e, _ in whole[:-1])] and whole[-1][1] == 60
    assert all(w == sum(x for _, _, x in rows[s:e]) for s, e, w in whole)
    for n in (10, 23, 41):  # what has been closed stays, whatever comes later
        before, _ = closed(rows[:n])
        assert before == early[: len(before)]
    mixed = rows[:]
    random.Random(seed).shuffle(mixed)
    assert closed(mixed + rows)[1] == whole


@pytest.mark.parametrize("seed", range(8))
def test_a_block_is_the_likeliest_partition(seed):
    rows = tokens(9, seed + 50)
    _, whole = closed(rows, window=20, longest=4)
    odds, words = [min(max(p, LEAST), 1 - LEAST) for _, p, _ in rows], [w for *_, w in rows]

    def score(cuts):
        return sum(log(odds[i]) if i in cuts else log(1 - odds[i]) for i in range(1, 9))

    every = [c for k in range(9) for c in itertools.combinations(range(1, 9), k)]
    parts = lambda c: list(zip([0, *c], [*c, 9], strict=True))
    fit = [c for c in every if all(any(words[s:e]) for s, e in parts(c))]
    short = [c for c in fit if all(e - s <= 4 for s, e in parts(c))] or fit
    if short:
        assert score([s for s, _, _ in whole[1:]]) == pytest.approx(max(map(score, short)))
    else:
        assert [(s, e) for s, e, _ in whole] == [(0, 9)]


def test_gaps_and_repeats():
    d = Decomposer(8, 2, 4)
    assert list(d.push(0, 0.5, True)) == [] and list(d.push(5, 0.5, True)) == [] and list(d.push(0, 0.9, False)) == []
    assert [(s, e) for s, e, _ in d.finish()] == [(0, 1), (5, 6)]


def table(spark, keys=3, n=50):
    return spark.createDataFrame([(k, i, p, w) for k in range(keys) for i, p, w in tokens(n, k)], "k long, pos long, boundary double, word boolean")


def test_table_is_decomposed_like_its_tokens(spark):
    df = table(spark)
    more = df.unionByName(spark.createDataFrame([(0, None, 0.5, True), (None, 1, 0.5, True), (1, 4, 2.0, True)], df.schema))
    got = sorted(tuple(r) for r in decomposed(more.repartition(5), "k", 8, 2, 4).collect())
    assert got == sorted((k, s, e - 1, w) for k in range(3) for s, e, w in closed(tokens(50, k))[1])
    assert decomposed(df.limit(0), "k", 8, 2, 4).count() == 0


def test_stream_restarts_from_its_checkpoint(spark, tmp_path):
    source, sink, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    at = lambda rows: rows.withColumn("at", F.timestamp_seconds(1_700_000_000 + F.col("pos")))
    every = at(table(spark))
    schema = every.schema

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        q = decomposed_stream(stream, "k", "at", 8, 2, 4, "1 minute").writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(sink)
        assert q.awaitTermination(120)

    for low, high in ((0, 20), (20, 35), (35, 50)):
        every.filter((F.col("pos") >= low) & (F.col("pos") < high)).orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(source)
        run()  # each run is a new query that goes on from the checkpoint
    sent = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    want = sorted((k, s, e - 1, w) for k in range(3) for s, e, w in closed(tokens(50, k))[0])
    assert sent == want
    # the watermark passes: what is left of the keys is sent out
    late = at(spark.createDataFrame([(9, 0, 0.5, True)], "k long, pos long, boundary double, word boolean")).withColumn("at", F.timestamp_seconds(F.lit(1_700_100_000)))
    late.coalesce(1).write.mode("append").parquet(source)
    run()
    late.withColumn("pos", F.lit(1).cast("long")).withColumn("at", F.timestamp_seconds(F.lit(1_700_100_001))).coalesce(1).write.mode("append").parquet(source)
    run()
    whole = sorted((k, s, e - 1, w) for k in range(3) for s, e, w in closed(tokens(50, k))[1])
    assert sorted(tuple(r) for r in spark.read.parquet(sink).filter("k < 9").collect()) == whole
