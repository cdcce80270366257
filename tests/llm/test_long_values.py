"""Very long values and texts: right results, and time that grows with the length."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from creatorlake.llm import langid, pii, topk

KEY = b"k"
#: The scan as one pattern, which tries an email at each place.
AS_ONE = re.compile(r"(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})|" + pii.SCAN.pattern, re.ASCII)
TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")


def test_values_are_those_of_one_pattern():
    rng = random.Random(1)
    parts = ["a", "b9", ".", "@", "-", "+", " ", "1.2.3.4", "2020-01-02", "555-123-4567", "(555) 123-4567", "com", "x@y.org", "%", "_", "é", "4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32", "aaaaa", "0" * 32]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))
        assert list(pii.values(text)) == [(m.lastgroup, *m.span()) for m in AS_ONE.finditer(text)], text


def test_markup_is_that_of_one_pattern():
    rng = random.Random(2)
    parts = ["<", "<!--", "-->", ">", "<script>", "</script>", "</SCRIPT >", "<style a>", "</style>", "x", "<p>", " ", "<scripty>", "--"]
    for _ in range(20_000):
        html = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert langid.without_markup(html) == TAGS.sub(" ", html), html


@pytest.mark.parametrize("text", ["a" * 10**6, "a." * 5 * 10**5, "f" * 10**6, "7" * 10**6, "a" * 10**6 + "@b.com", "a@" * 5 * 10**5, "." * 10**6 + "1", "f" * 3600, "x" * 3100 + "@b.com"])
def test_long_runs_keep_their_form(text):
    began = time.time()
    new, spans = pii.pseudonymise(text, KEY)
    assert time.time() - began < 20 and len(new) == len(text)
    if spans:
        assert new != text and pii.pseudonymise(text, KEY)[0] == new
        assert [c.isdigit() for c in new] == [c.isdigit() for c in text] or spans[0][0] == "key"


def test_different_long_values_stay_different():
    a, b = "f" * 5000, "f" * 4999 + "e"
    assert len({pii.pseudonymise(x, KEY)[0] for x in (a, b, a.upper())}) == 3


@pytest.mark.parametrize("html", ["<" * 10**6, "<!--" * 250_000, "<script>" * 125_000, "<style" * 160_000, "<script>" * 60_000 + "</script>" * 60_000])
def test_hostile_markup_takes_one_pass(html):
    began = time.time()
    langid.without_markup(html)
    assert time.time() - began < 10


@pytest.mark.parametrize("size", [10_000, 1_000_000, 3_000_000])
def test_top_k_is_exact_for_large_components(spark, size):
    rng = random.Random(size)
    rows = [(i, [rng.uniform(-size, size) for _ in range(8)]) for i in range(60)]
    whole = {i: [int(256 * x // 1) for x in v] for i, v in rows}
    got = {(r.query_id, r["rank"]): (r.score, r.vec_id) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.lit(True)).collect()}
    for i, v in whole.items():
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in whole.items() if j != i)[:5]
        assert [got[i, n] for n in range(1, 6)] == [(-s, j) for s, j in best]


@pytest.mark.parametrize("size", [1e8, 1e18])
def test_scores_beyond_a_long_are_refused(spark, size):
    rows = spark.createDataFrame([(i, [size] * 8) for i in range(3)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit a long"):
        topk.top_k(rows, F.lit(True)).collect()
