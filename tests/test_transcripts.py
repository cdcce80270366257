"""Transcripts without characters, without words or without a length give what their SQL gives."""

import duckdb
import pytest

from creatorlake.plans import QUERIES, SQL

TEXTS = [
    (1, "Hello you, I WE 12 now? No! Long sentence.", 0), (2, "", 0), (3, "   ", 3), (4, None, 0), (5, None, None), (6, "some words here", None), (7, "a\x0bb c", 5), (8, " foo bar　", 9),
    (9, "one two three four five six seven eight nine ten ", 150), (10, "a b c d e f g h i j", -80), (11, "\n\t", 0), (12, "x y", -3), (13, "a mean length at a half: " * 16, 64), (14, "a " * 639 + "aa", 1280),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(TEXTS, "doc_id long, text string, n_chars long").write.parquet(str(path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    return str(path), con


def same(spark, odd, name):
    path, con = odd
    found = con.execute(SQL[name])
    columns = [d[0] for d in found.description]
    assert [repr(tuple(r)) for r in QUERIES[name](spark, path).select(*columns).orderBy("doc_id").collect()] == [repr(r) for r in sorted(found.fetchall())]


def test_opening_words_of_empty_documents(spark, odd):
    same(spark, odd, "h7_opening_words")


def test_transcript_metrics_of_empty_documents(spark, odd):
    same(spark, odd, "h_transcript_metrics")
