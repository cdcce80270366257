"""The registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creatorlake.llm import langid
from creatorlake.llm.byte_bpe import Vocabulary, encode
from creatorlake.llm.common import read, shared_dir
from creatorlake.llm.conversation_trie import numbered_turns, prefix_trie, with_shared_openings
from creatorlake.llm.decontamination import contamination
from creatorlake.llm.hard_negatives import hard_negatives
from creatorlake.llm.nn_descent import nearest_neighbours
from creatorlake.llm.pii import pseudonymised
from creatorlake.llm.secrets import secret_scan
from creatorlake.llm.sharding import layout, rewrite_affected
from creatorlake.llm.simhash import near_duplicates
from creatorlake.llm.token_counts import split_vocabulary, token_counts
from creatorlake.llm.topk import top_k
from creatorlake.llm.toxicity import held_out, learn, toxicity


def word_pieces(path: str) -> tuple[list[str], list[str]]:
    """(initial, inner) pieces of a SentencePiece vocabulary file, without its control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return split_vocabulary(map(model.id_to_piece, plain))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    initial, inner = word_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return token_counts(read(spark, sf_dir, "documents"), initial, inner)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    both = encode(read(spark, sf_dir, "documents"), vocabulary, offsets=None, keep=("doc_id",), decoded="decoded")
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = secret_scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang"), keep=("doc_id",))

    def digest(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(digest("base"), 256).alias("base_sha256"), digest("spans").alias("spans"), "n_live", "n_shared")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ours = labels.filter(~held_out(F.col("doc_id")))
    scored = toxicity(docs, learn(docs, ours))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), *[c for c in scored.columns if c.startswith("m_")])


def op6_flow_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with their texts, from 16 shards by text to 24; the affected shards are written, and the result is read from there."""
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        "text",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        # as the documents lie before: equal texts in one of 16 shards
        F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(16)).cast("int").alias("old_shard"),
    )
    plan = layout(rows, 24, order=["text_crc32", "doc_id"], group=["text"])
    out, path = plan.apply(rows), f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    # shards that nothing moves into or out of lie there already
    if still := sorted(set(range(24)) - set(plan.touched)):
        out.filter(F.col("shard").isin(still)).write.partitionBy("shard").parquet(path)
    rewrite_affected(out, path, touched=plan.touched)
    lie = spark.read.schema(T.StructType([f for f in out.schema if f.name != "shard"] + [out.schema["shard"]])).parquet(path)
    text = F.coalesce("text", F.lit(""))
    return lie.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard",
    )


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(read(spark, sf_dir, "documents"), keep=("doc_id",))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return found.select("doc_id", (F.size("benchmark_hits") > 0).alias("contaminated"), "benchmark_hits")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and pages together: page_id is null for documents, doc_id for pages. The text model learns from the documents' own languages."""
    docs, pages = read(spark, sf_dir, "documents"), read(spark, sf_dir, "pages")
    model = langid.fit(docs, "text", "lang")
    nothing = F.lit(None)
    of_docs = langid.text_evidence(docs, model, F.col("text"), False, {"doc_id": F.col("doc_id"), "page_id": nothing.cast("long"), "host": F.col("source"), "declared": nothing.cast("string"), "address": nothing.cast("string")})
    address = {"host": langid.host_of(F.col("url")), "declared": langid.declared_language(F.col("html")), "address": langid.address_language(F.col("url"), model.languages)}
    of_pages = langid.text_evidence(pages, model, F.col("html"), True, {"doc_id": nothing.cast("long"), "page_id": F.col("page_id")} | address)
    return langid.fused(of_docs.unionByName(of_pages), model.languages).select("doc_id", "page_id", "language", "confidence", "accepted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, label=moved)


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_shared_openings(numbered_turns(read(spark, sf_dir, "conversations"))))


def queries() -> dict:
    both = (op1_token_counts, op2_topk_search, op3_byte_bpe, op4_secret_scan, op5_toxicity, op6_flow_sharding, op7_pii_pseudonyms, op8_decontamination, op9_simhash, op10_language_id, op11_hard_negatives, op12_nn_descent, op13_conversation_trie)
    return {f.__name__: f for f in both}


TOP_K = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 5
"""


NEGATIVES = """
WITH e AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, list_inner_product(a.v, c.v)::BIGINT AS score
  FROM e a JOIN e c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT uid, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id) AS n FROM s WHERE same
), m AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.uid, n ORDER BY score DESC, s.vec_id) AS r, s.vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (uid) WHERE n <= 5 AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, r::INTEGER AS rank, negative_id, positive_score, negative_score FROM m WHERE r <= 3
"""


TRIE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) - 1 AS pos, d, length(text)::BIGINT AS size FROM t
), bits AS (
  SELECT conv_id, count(*) AS n, flatten([[4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))]) AS b
  FROM n GROUP BY conv_id
), c AS (
  SELECT conv_id, n, conv_id - conv_id % 100 AS base,
    xor(list_reduce(b, lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM bits
), o AS (
  SELECT c.*, least(h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN (SELECT conv_id AS base, n FROM c) b USING (base)
), r AS (
  SELECT o.conv_id, n.pos, d, size FROM o JOIN n ON n.conv_id = o.base WHERE n.pos < h
  UNION ALL SELECT o.conv_id, n.pos - h + m, d, size FROM o JOIN n ON n.conv_id = o.conv_id WHERE n.pos >= h
), p AS (
  SELECT conv_id, pos + 1 AS depth, string_agg(d, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path, size FROM r
  UNION ALL SELECT conv_id, 0, '', 0 FROM c
), ends AS (
  SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id
), nodes AS (
  SELECT depth, path, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = last), '') AS ended
  FROM p JOIN ends USING (conv_id) GROUP BY depth, path
), kids AS (
  SELECT a.depth, a.path, count(b.path) AS n_children FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth + 1 AND b.path[:-65] = a.path GROUP BY a.depth, a.path
), under AS (
  SELECT a.depth, a.path, sum((b.n_convs - 1) * b.size) AS saved_tokens, count(*) FILTER (k.n_children = 0) AS n_leaves
  FROM nodes a JOIN nodes b ON starts_with(b.path, a.path) JOIN kids k ON k.depth = b.depth AND k.path = b.path GROUP BY a.depth, a.path
)
SELECT a.conv_id, a.depth::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
  saved_tokens::BIGINT AS saved_tokens, sha256(a.ended) AS ends_sha256
FROM nodes a JOIN kids USING (depth, path) JOIN under USING (depth, path) LEFT JOIN nodes b ON b.depth = a.depth - 1 AND b.path = a.path[:-65]
"""


def oracle_sql() -> dict[str, str]:
    """The others can't be said in SQL; tests hold them against brute force."""
    return {"op2_topk_search": TOP_K, "op11_hard_negatives": NEGATIVES, "op13_conversation_trie": TRIE}
