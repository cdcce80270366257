"""A corpus from raw documents to tokens: language, near copies, benchmark passages, personal data, encoding.

Each stage gets what the one before has kept, written as Parquet and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from creatorlake.llm import byte_bpe, langid
from creatorlake.llm.common import written
from creatorlake.llm.decontamination import contamination
from creatorlake.llm.pii import pseudonymised
from creatorlake.llm.simhash import first_of_each

#: SQL has no word for these stages; tests hold run() against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in none of the languages that the corpus is labelled with go, as do those without letters."""
    return langid.identified(docs, langid.fit(docs, "text", "lang"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the SimHash index the document with the smallest doc_id stays."""
    return first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), hits="__hits")
    return found.filter(F.size("__hits") == 0).select(*docs.columns)


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms; n_chars follows the text."""
    out = pseudonymised(docs, spans="__spans")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def byte_bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether decoding the ids gives the text again."""
    vocabulary = byte_bpe.Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = byte_bpe.encode(docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("text")), vocabulary, offsets=None, decoded="decoded")
    return both.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.col("text").cast("binary")).alias("round_trip"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pseudonymise", pseudonymise), ("byte_bpe", byte_bpe_tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", tidy=True)
    return docs
