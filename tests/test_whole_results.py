"""Queries whose result must have every row, the rare ones too."""

from pyspark.sql import functions as F

from creatorlake.functions.text import singular
from creatorlake.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_rare_terms_and_bigrams_and_all_spans_are_there(spark):
    terms = QUERIES["d10_inverse_document_frequency_all"](spark, SF)
    assert terms.count() == 26_244 and terms.filter("df = 1").count() > 0
    assert terms.filter("df >= 20").count() == 219
    bigrams = QUERIES["h5_bigrams_all"](spark, SF)
    assert bigrams.filter("docs = 1").count() > 0
    spans = QUERIES["c15_interval_join_all"](spark, SF)
    events = spark.read.parquet(f"{SF}/events.parquet").select("event_id").distinct()
    assert spans.count() == events.count() and spans.join(events, spans.span == events.event_id, "left_anti").count() == 0


def test_singulars(spark):
    want = {
        "houses": "house", "uses": "use", "cases": "case", "boxes": "box", "churches": "church", "dishes": "dish", "classes": "class", "quizzes": "quizz", "stories": "story", "ties": "tie",
        "Children": "child", "TVs": "tv", "TVS": "tv", "USB": "usb", "bus": "bus", "glass": "glass", "basis": "basis", "as": "as", "IS": "IS", "cats": "cat", "wolves": "wolf", "gas": "ga",
    }
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in want], "w string").select("w", singular(F.col("w")).alias("s")).collect()}
    assert got == want
