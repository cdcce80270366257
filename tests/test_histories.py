"""Prior outcomes against all pairs, with one source that holds most rows."""

import datetime as dt
import random

import pytest

from creatorlake.operators.experiments import local_rate
from creatorlake.operators.relational import prior_outcomes

START = dt.datetime(2024, 1, 1)


def test_prior_outcomes_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        at = START + dt.timedelta(days=rng.randrange(60))
        seen = None if rng.random() < 0.1 else at + dt.timedelta(days=rng.choice([0, 3, 10]))
        rows.append((i, "hot" if i % 3 else f"s{i % 5}", at, seen, rng.choice(["a", "b", "c", None]), None if rng.random() < 0.1 else float(rng.choice([1, 2, 2, 5, -3]))))
    more = [(None, "hot", START, START, "a", 9.0), (900, None, START, START, "a", 9.0)]
    df = spark.createDataFrame(rows + more, "id long, source string, published timestamp, observed timestamp, family string, views double").repartition(3)
    got = {r.id: (r.prior_n, r.prior_mean, r.prior_max) for r in prior_outcomes(df, "source", "published", "observed", "id", "family", "views").collect()}
    assert set(got) == {r[0] for r in rows}
    for i, source, at, _, family, _ in rows:
        prior = [v for j, s, _, seen, f, v in rows if s == source and j != i and seen is not None and seen <= at and f != family and v is not None]
        n, mean, most = got[i]
        assert n == len(prior) and most == (max(prior) if prior else None)
        assert mean == (pytest.approx(sum(prior) / len(prior)) if prior else None)
    assert prior_outcomes(df.limit(0), "source", "published", "observed", "id", "family", "views").count() == 0


def test_local_rate_equals_its_rule(spark):
    rng = random.Random(8)
    rows = [(i, float(rng.choice([1, 2, 2, 2, 5, 9, i])), rng.randrange(2)) for i in range(130)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1), (900, None, 1), (901, 2.0, None)], "id long, score double, y int").repartition(3)
    order = sorted((s, i, y) for i, s, y in rows)
    for piece in (7, 65_536):
        got = {r.id: r.rate for r in local_rate(df, "id", "score", "y", piece=piece).collect()}
        for i, s, _ in rows:
            at = sum(o[0] < s for o in order)
            near = [y for *_, y in order[max(0, at - 6) : min(130, at + 6)]]
            assert got[i] == pytest.approx(sum(near) / len(near))
    assert local_rate(df.limit(0), "id", "score", "y").count() == 0
    assert [r.rate for r in local_rate(df.filter("id = 3"), "id", "score", "y").collect()] == [rows[3][2]]
