"""Ranks, places and quantiles against plain Python, with ties, both signs, wide spreads, infinities and nulls."""

import math
import random

from creatorlake.operators.experiments import order_in_metric
from creatorlake.operators.windows import quantiles, value_class, value_places, with_average_rank
from pyspark.sql import functions as F


def rows():
    rng = random.Random(4)
    values = [rng.choice([0.0, 0.1, -3.5, 7.0]) for _ in range(200)] + [rng.uniform(-1, 1) * 10 ** rng.randint(-300, 300) for _ in range(300)]
    values += [1.7e9 + rng.random() * 1e-3 for _ in range(200)] + [math.inf, -math.inf, 5e-324, -5e-324, 1.0, 1.0 + 2**-52]
    return [(g, i, v) for i, v in enumerate(values) for g in ("a", "b") if g == "a" or i % 3] + [("a", 9001, None), (None, 9002, 1.0), ("c", 9003, 4.0)]


def test_places_ranks_and_order_match_a_sort(spark):
    df = spark.createDataFrame(rows(), "metric string, video_id long, value double")
    known = [r for r in rows() if r[0] is not None and r[2] is not None]
    group = lambda g: [v for m, _, v in known if m == g]
    places = {(r.metric, r.value): (r["__c"], r["__below"], r["__n"]) for r in value_places(df, "value", "metric").collect()}
    assert places == {(g, v): (group(g).count(v), sum(x < v for x in group(g)), len(group(g))) for g, _, v in known}
    ranks = {(r.metric, r.video_id): r["rank"] for r in with_average_rank(df, "value", "metric").collect()}
    assert ranks == {(g, i): places[g, v][1] + (places[g, v][0] + 1) / 2 for g, i, v in known}
    order = {(r.metric, r.video_id): r.place for r in order_in_metric(df).collect()}
    assert order == {(g, i): n for g in "abc" for n, (v, i) in enumerate(sorted((v, i) for m, i, v in known if m == g))}
    assert value_places(df.limit(0), "value").count() == 0


def test_repeated_rows_take_places_of_their_own(spark):
    df = spark.createDataFrame([("a", 1, 2.0)] * 3 + [("a", 2, 1.0)], "metric string, video_id long, value double")
    assert sorted(r.place for r in order_in_metric(df).collect()) == [0, 1, 2, 3]


def test_classes_never_fall(spark):
    values = sorted({v for _, _, v in rows() if v is not None}) + [math.nan]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(values)), "i int, v double").orderBy("i").select(value_class(F.col("v"))).collect()]
    assert got == sorted(got)


def test_quantiles_match_spark(spark):
    df = spark.createDataFrame([r for r in rows() if r[2] is None or abs(r[2]) < 1e12], "metric string, video_id long, value double").filter("metric is not null")
    at = {"low": 0.25, "mid": 0.5, "high": 0.9, "least": 0.0, "most": 1.0}
    got = {r.metric: [r[n] for n in at] for r in quantiles(df, "value", at, "metric").collect()}
    want = {r.metric: r.p for r in df.groupBy("metric").agg(F.percentile("value", F.array(*map(F.lit, at.values()))).alias("p")).collect()}
    assert got.keys() == want.keys()
    assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-300) for g in got for a, b in zip(got[g], want[g], strict=True))
