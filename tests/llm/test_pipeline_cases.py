"""The pipeline over an empty table, and over null and empty texts beside columns whose names clash with its own."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from creatorlake.llm import simhash

SF = "/root/testdata/sf0.001"
CLASHING = ("language", "Host", "__hits", "__spans", "ids", "g0", "__digest")


@pytest.mark.parametrize("kind", ["empty", "nulls"])
def test_run(spark, tmp_path, kind):
    docs, sf = spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "sf")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{sf}/benchmark.parquet")
    if kind == "empty":
        docs.limit(0).write.parquet(f"{sf}/documents.parquet")
        assert corpus_pipeline.run(spark, sf).count() == 0
        return
    some = docs.limit(60)
    first = some.orderBy("doc_id").first()
    more = spark.createDataFrame([(9001, None, "en", "src0", None), (9002, "", "en", "src0", 0), (9003, " \n", None, None, 2), (None, first.text, first.lang, first.source, 5), (9004, first.text, None, None, None)], docs.schema)
    wide = some.unionByName(more).select("*", *[F.lit("x").alias(c) for c in CLASHING])
    wide.write.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    # texts without letters have no language; copies of a text with a smaller id go
    assert not kept.keys() & {9001, 9002, 9003, 9004, None}
    assert set(kept) <= {r.doc_id for r in some.collect()} and len(kept) > 30 and all(r.round_trip for r in kept.values())


def test_near_dedup_is_what_the_simhash_index_leaves(spark):
    """A set of copies with a word changed now and then: the stage keeps what op9 keeps, whether or not shingle sets are alike to 0.8."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(w if (i + k) % 97 else f"x{k}_{i}" for i, w in enumerate(words)), "en", "a", 1) for k in range(40)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{SF}/documents.parquet").schema)
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect())
    assert kept == sorted(r.doc_id for r in simhash.near_duplicates(docs).filter("doc_id = component_id").collect())
    assert kept != sorted(r.doc_id for r in simhash.one_of_each(docs).collect())
