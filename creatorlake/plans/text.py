"""Text operators (H) and transcript metrics over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from creatorlake.functions import arrays as A
from creatorlake.functions import text as T
from creatorlake.plans.registry import query

WORDS = "CASE WHEN trim(regexp_replace(coalesce({t}, ''), '\\s+', ' ', 'g')) = '' THEN []::VARCHAR[] ELSE string_split(trim(regexp_replace(coalesce({t}, ''), '\\s+', ' ', 'g')), ' ') END"
W, LOW = WORDS.format(t="text"), WORDS.format(t="lower(text)")


@query(f"""WITH d AS (SELECT doc_id, text, n_chars / 15.0 AS dur, {W} AS w, {LOW} AS l FROM documents)
SELECT doc_id, len(w) AS transcript_word_count, length(text) AS transcript_char_count, len(regexp_extract_all(text, '[0-9]+')) AS transcript_number_count, round(len(w) / dur, 6) AS speech_rate_wps,
  length(text) - length(replace(text, '?', '')) AS question_count, length(text) - length(replace(text, '!', '')) AS exclamation_count, len(regexp_extract_all(text, '[.!?]')) AS sentence_count,
  round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) AS avg_word_length,
  round(len(list_filter(w, lambda x: length(x) >= 2 AND x = upper(x) AND x <> lower(x))) / len(w), 6) AS uppercase_word_ratio,
  round(len(list_filter(w, lambda x: length(x) <= 3)) / len(w), 6) AS short_word_ratio, round(len(list_filter(w, lambda x: length(x) >= 8)) / len(w), 6) AS long_word_ratio,
  round(len(list_filter(l, lambda x: x IN ('i', 'me', 'my', 'we', 'our'))) / len(w), 6) AS first_person_ratio, round(len(list_filter(l, lambda x: x IN ('you', 'your', 'yours'))) / len(w), 6) AS second_person_ratio FROM d""")
def h_transcript_metrics(table):
    found = T.transcript_metrics(F.col("text"), F.col("__w"), F.col("n_chars") / 15.0)
    ratio = lambda n: A.rounded(F.col(n), 6).alias(n) if n.endswith(("ratio", "wps", "length")) else n
    return T.with_words(table("documents"), "text").select("doc_id", *[c.alias(n) for n, c in found.items()]).select("doc_id", *map(ratio, found))


TITLE = "SELECT conv_id, turn, string_split(text, chr(10))[1] AS title FROM conversations"


@query(f"""WITH t AS ({TITLE}), d AS (SELECT *, {WORDS.format(t='title')} AS w FROM t)
SELECT conv_id, turn, length(title) AS title_char_count, len(w) AS title_word_count, contains(title, '?') AS title_question_flag, contains(title, '!') AS title_exclamation_flag, regexp_matches(title, '[0-9]') AS title_number_flag,
  len(list_filter(w, lambda x: length(x) >= 2 AND x = upper(x) AND x <> lower(x))) AS title_all_caps_word_count, round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) AS title_avg_word_length,
  len(list_filter(w, lambda x: length(x) > 6)) AS title_uniqueness_score, round(length(title) / len(w), 6) AS title_compression_ratio FROM d""")
def h_title_metrics(table):
    found = T.title_metrics(F.col("title"), F.col("__w"))
    ratio = lambda n, c: F.round(c, 6).alias(n) if n.endswith(("ratio", "length")) else c.alias(n)
    titles = table("conversations").withColumn("title", F.get(F.split("text", "\n"), F.lit(0)))
    return T.with_words(titles, "title").select("conv_id", "turn", *[ratio(n, c) for n, c in found.items()])


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), 'https?://\\S+', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))) AS h FROM documents")
def h1_normalised_text(table):
    return table("documents").select("doc_id", F.md5(T.normalised(F.col("text"))).alias("h"))


STOP = "('the', 'and', 'of', 'that', 'with')"


@query(f"SELECT doc_id, len(list_filter({LOW}, lambda x: length(x) > 2 AND x NOT IN {STOP})) AS kept FROM documents")
def h4_stop_words(table):
    stop = ["the", "and", "of", "that", "with"]
    return table("documents").select("doc_id", F.size(F.filter(T.words(F.lower("text")), lambda x: (F.length(x) > 2) & ~x.isin(*stop))).cast("long").alias("kept"))


@query(f"WITH d AS (SELECT doc_id, {LOW} AS w FROM documents), b AS (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS bigram FROM d) SELECT bigram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM b GROUP BY bigram")
def h5_bigrams_all(table):
    return bigrams(table)


def bigrams(table):
    b = table("documents").select("doc_id", F.explode(T.shingles(T.words(F.lower("text")), 2)).alias("bigram"))
    per = b.groupBy("bigram", "doc_id").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("bigram").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("docs"))


@query("SELECT doc_id, ((length(t) - length(replace(t, 'the ', ''))) / 4 + (length(t) - length(replace(t, 'ing', ''))) / 3 + (length(t) - length(replace(t, 'tion', ''))) / 4)::BIGINT AS hits FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def h6_lexicon_phrases(table):
    return table("documents").select("doc_id", T.phrase_count(F.lower("text"), ["the ", "ing", "tion"]).alias("hits"))


@query(f"SELECT doc_id, array_to_string(({W})[1:ceil(len({W}) * least(1.0, 5.0 / (n_chars / 15.0)))::INT], ' ') AS opening FROM documents")
def h7_opening_words(table):
    return table("documents").select("doc_id", F.array_join(T.leading_words(T.words(F.col("text")), 5.0, F.col("n_chars") / 15.0), " ").alias("opening"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '\\bthe\\b')) AS n FROM documents")
def h9_whole_word_count(table):
    return table("documents").select("doc_id", T.whole_word_count(F.lower("text"), "the").alias("n"))


@query("SELECT s_suppkey, p_partkey, round(1 - levenshtein(s_name, p_name) / greatest(length(s_name), length(p_name)), 6) AS similarity FROM supplier JOIN part ON s_suppkey = p_partkey")
def h13_edit_similarity(table):
    from creatorlake.operators.relational import edit_similarity

    s, p = table("supplier"), table("part")
    return s.join(p, s["s_suppkey"] == p["p_partkey"]).select("s_suppkey", "p_partkey", F.round(edit_similarity(F.col("s_name"), F.col("p_name")), 6).alias("similarity"))


@query(f"WITH d AS (SELECT doc_id, unnest({LOW}) AS w FROM documents), c AS (SELECT doc_id, w, count(*) AS n FROM d GROUP BY 1, 2) SELECT doc_id, round(count(*) / sum(n), 6) AS unique_word_ratio, round(count(*) FILTER (n = 1) / sum(n), 6) AS hapax_legomena_ratio, round(1e4 * (sum(n * n) - sum(n)) / (sum(n) * sum(n)), 6) AS vocabulary_richness_yule_k FROM c GROUP BY doc_id")
def h_vocabulary_metrics(table):
    v = T.vocabulary_metrics(table("documents"), "doc_id", "text")
    return v.select("doc_id", *[F.round(c, 6).alias(c) for c in v.columns[1:]])


TURNS = f"WITH t AS (SELECT conv_id, turn, {LOW} AS w FROM conversations), s AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM t WHERE len(w) > 2)"


@query(TURNS + " SELECT a.conv_id, a.turn, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def h14_trigram_jaccard(table):
    s = table("conversations").select("conv_id", "turn", F.explode(T.shingles(T.words(F.lower("text")), 3)).alias("s"))
    found = T.set_jaccard(s, s.withColumn("turn", F.col("turn") - 1), ["conv_id", "turn"], "s")
    return found.select("conv_id", "turn", F.round("jaccard", 6).alias("jaccard"))


@query("SELECT doc_id, (('0x' || substr(sha256(doc_id::VARCHAR), 1, 2))::INT % 5)::INT AS fold FROM documents")
def h17_hash_fold(table):
    return table("documents").select("doc_id", T.hash_fold(F.col("doc_id").cast("string"), 5).alias("fold"))


@query("SELECT o_orderkey, (o_orderkey % 5) * 3600 + (o_orderkey % 60) * 60 + o_orderkey % 7 AS seconds FROM orders")
def h19_duration_text(table):
    o = table("orders").withColumn("d", F.format_string("%d:%02d:%02d", F.col("o_orderkey") % 5, F.col("o_orderkey") % 60, F.col("o_orderkey") % 7))
    return o.select("o_orderkey", T.duration_seconds(F.col("d")).alias("seconds"))


@query("SELECT o_orderkey, round(log10(o_totalprice + 1), 6) AS size, least(greatest(o_totalprice / 400000, 0), 1) AS clipped, round(1000 * (o_orderkey % 97) / (o_totalprice + 1), 6) AS per_1000 FROM orders")
def h26_safe_transforms(table):
    v = F.col("o_totalprice")
    return table("orders").select("o_orderkey", F.round(F.log10(v + 1), 6).alias("size"), F.least(F.greatest(v / 400000, F.lit(0.0)), F.lit(1.0)).alias("clipped"), F.round(1000 * (F.col("o_orderkey") % 97) / (v + 1), 6).alias("per_1000"))


@query("SELECT CASE WHEN i <= 5 THEN 'first5' WHEN i <= 10 THEN 'first10' WHEN i / n <= 0.25 THEN 'early' WHEN i / n <= 0.75 THEN 'middle' ELSE 'late' END AS bucket, count(*) AS n_rows FROM (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY 1")
def h22_position_bucket(table):
    from pyspark.sql import Window

    i, n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.count(F.lit(1)).over(Window.partitionBy("user_id"))
    e = table("events").select(i.alias("i"), n.alias("n"))
    at = F.col("i") / F.col("n")
    return e.groupBy(F.when(F.col("i") <= 5, "first5").when(F.col("i") <= 10, "first10").when(at <= 0.25, "early").when(at <= 0.75, "middle").otherwise("late").alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
