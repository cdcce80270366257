"""Sources, gates, joins (A, B, C)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creatorlake.operators import relational as R
from creatorlake.plans.panel import VIDEOS_SQL, videos
from creatorlake.plans.registry import query


@query("SELECT * FROM customer WHERE c_custkey = 42")
def a4_point_lookup(table):
    return table("customer").filter("c_custkey = 42")


@query("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def a6_partial_update(table):
    base = table("customer")
    changes = base.filter("c_custkey % 7 = 0").select("c_custkey", (F.col("c_acctbal") + 10).alias("c_acctbal"), F.lit("CHANGED").alias("c_mktsegment"))
    return R.upserted(base, changes, "c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def a7_delete_by_id(table):
    gone = table("orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table("customer").select("c_custkey", "c_name").join(gone, "c_custkey", "left_anti")


@query("SELECT origin, count(*) AS n, count(city) AS with_city, round(sum(balance), 2) AS balance FROM (SELECT 'customer' AS origin, c_acctbal AS balance, c_mktsegment AS city FROM customer UNION ALL SELECT 'supplier', s_acctbal, NULL FROM supplier) GROUP BY origin")
def a11_pooled_accounts(table):
    both = R.pooled({"customer": table("customer").select(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("city")), "supplier": table("supplier").select(F.col("s_acctbal").alias("balance"))})
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count("city").alias("with_city"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic, length(d.text) AS chars FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id")
def a13_label_rows(table):
    d = table("documents").select("doc_id", "lang", F.length("text").cast("long").alias("chars"))
    return d.join(table("labels"), "doc_id").join(table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id").select("doc_id", "lang", "quality", "toxic", "chars")


@query("SELECT o_custkey AS channel, count(*) AS n, min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY o_custkey")
def a14_channel_index(table):
    return table("orders").groupBy(F.col("o_custkey").alias("channel")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))


@query("SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT DISTINCT l_orderkey, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def a15_index_validation(table):
    """Orders that the item rows don't account for; none, if the index is right."""
    seen = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey")).distinct().join(table("orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return table("orders").select("o_orderkey", "o_custkey").exceptAll(seen.select("o_orderkey", "o_custkey"))


@query("SELECT count(*) AS n, count(DISTINCT vec_id) AS ids, count(*) - count(DISTINCT vec_id) AS repeated, count(*) FILTER (len(list_filter(embedding, lambda x: NOT isfinite(x))) > 0) AS not_finite, min(len(embedding)) AS least_size, max(len(embedding)) AS most_size, round(max(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 5) AS largest_norm FROM embeddings")
def a19_snapshot_check(table):
    x = F.col("embedding").cast("array<double>")
    odd = F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    return table("embeddings").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("ids"), (F.count(F.lit(1)) - F.countDistinct("vec_id")).alias("repeated"), F.count_if(odd).alias("not_finite"), F.min(F.size(x)).cast("long").alias("least_size"), F.max(F.size(x)).cast("long").alias("most_size"), F.round(F.max(norm), 5).alias("largest_norm"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def a24_vectors_by_keys(table):
    return table("embeddings").join(table("labels").filter("toxic = 1").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select("vec_id", "label")


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, 98 FROM embeddings WHERE vec_id % 5 = 0")
def a25_vector_upsert(table):
    base = table("embeddings").select("vec_id", "label")
    changed = base.filter("vec_id % 3 = 0").select("vec_id", F.lit(99).alias("label"))
    added = base.filter("vec_id % 5 = 0").select((F.col("vec_id") + 1000000).alias("vec_id"), F.lit(98).alias("label"))
    return R.upserted(base, changed.union(added), "vec_id")


@query("SELECT count(*) AS n, sum(vec_id) AS ids FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels)")
def a26_vector_delete(table):
    return table("embeddings").join(table("labels").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_anti").agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P' AND o_custkey IS NOT NULL AND date_diff('day', o_orderdate, TIMESTAMP '1998-08-01') BETWEEN 0 AND 366 AND (o_orderpriority <> '1-URGENT' OR o_totalprice <= 200000)")
def b1_observation_gate(table):
    age = F.datediff(F.to_date(F.lit("1998-08-01")), F.col("o_orderdate"))
    return table("orders").filter((F.col("o_orderstatus") != "P") & F.col("o_custkey").isNotNull() & age.between(0, 366) & F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice") <= 200000).otherwise(True)).select("o_orderkey")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(lang || ' ' || source || '-Raw Key'), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g')) AS key FROM documents")
def b6_canonical_key(table):
    raw = F.lower(F.concat("lang", F.lit(" "), "source", F.lit("-Raw Key")))
    return table("documents").select("doc_id", F.trim(F.regexp_replace(F.regexp_replace(raw, "[^a-z0-9_]", "_"), "_+", "_")).alias("key"))


@query("WITH l AS (SELECT l_returnflag AS layer, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS i FROM lineitem WHERE l_returnflag IN ('A', 'R')) SELECT layer, l_orderkey, l_linenumber, i FROM l WHERE (layer = 'A' AND i <= 70) OR (layer = 'R' AND i <= 30)")
def b8_biased_pool(table):
    """70 to 30 from two ranked streams."""
    rows = table("lineitem").filter(F.col("l_returnflag").isin("A", "R"))
    i = F.row_number().over(Window.partitionBy("l_returnflag").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    # the plain bound is kept before the shuffle, the share of each layer after it
    first = rows.select(F.col("l_returnflag").alias("layer"), "l_orderkey", "l_linenumber", i.cast("long").alias("i"), i.alias("place")).filter("place <= 70")
    return first.filter(F.col("i") <= F.when(F.col("layer") == "A", 70).otherwise(30)).drop("place")


@query("SELECT event_type AS metric, count(DISTINCT value) AS kinds, count(*) FILTER (value <> 0) AS non_zero FROM events GROUP BY event_type HAVING count(DISTINCT value) > 1 AND count(*) FILTER (value <> 0) > 10")
def b9_sparse_metric_exclusion(table):
    return table("events").groupBy(F.col("event_type").alias("metric")).agg(F.countDistinct("value").alias("kinds"), F.count_if(F.col("value") != 0).alias("non_zero")).filter("kinds > 1 and non_zero > 10")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '^[\\x00-\\x{24F}\\s\\p{P}\\p{S}]*$') AND len(regexp_extract_all(text, '[A-Za-z]')) >= 3")
def b13_latin_texts(table):
    return table("documents").filter(F.col("text").rlike(r"^[\x00-\x{24F}\s\p{P}\p{S}]*$") & (F.regexp_count("text", F.lit("[A-Za-z]")) >= 3)).select("doc_id")


@query("SELECT count(*) FILTER (l_discount < 0 OR l_discount > 1) AS bad_discount, count(*) FILTER (l_tax < 0 OR l_tax > 1) AS bad_tax, count(*) FILTER (l_quantity <= 0) AS bad_quantity, count(*) AS n FROM lineitem")
def b14_unit_validation(table):
    rules = {"bad_discount": "l_discount < 0 or l_discount > 1", "bad_tax": "l_tax < 0 or l_tax > 1", "bad_quantity": "l_quantity <= 0"}
    return table("lineitem").agg(*[F.count_if(F.expr(r)).alias(n) for n, r in rules.items()], F.count(F.lit(1)).alias("n"))


@query(f"WITH {VIDEOS_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY source ORDER BY published, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM videos) SELECT video_id, prior FROM n WHERE prior >= 5")
def b18_history_gate(table):
    prior = F.count(F.lit(1)).over(Window.partitionBy("source").orderBy("published", "video_id").rowsBetween(Window.unboundedPreceding, -1))
    return videos(table).select("video_id", prior.alias("prior")).filter("prior >= 5")


@query("SELECT d.doc_id, e.vec_id IS NOT NULL AS have, e.label FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id")
def c2_embedding_alignment(table):
    e = table("embeddings").select(F.col("vec_id").alias("doc_id"), "label", F.lit(True).alias("h"))
    return table("documents").select("doc_id").join(e, "doc_id", "left").select("doc_id", F.coalesce("h", F.lit(False)).alias("have"), "label")


@query("SELECT count(*) FILTER (l.doc_id IS NOT NULL AND r.vec_id IS NOT NULL) AS both_sides, count(*) FILTER (r.vec_id IS NULL) AS left_only, count(*) FILTER (l.doc_id IS NULL) AS right_only FROM (SELECT DISTINCT doc_id FROM documents) l FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) r ON l.doc_id = r.vec_id")
def c3_alignment_population(table):
    return R.population(table("documents").select("doc_id"), table("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id")


@query("SELECT n.n_nationkey, coalesce(nullif(trim(r.r_name), ''), n.n_name) AS region_name, CASE WHEN n.n_name = r.r_name THEN n.n_name ELSE concat_ws(' / ', n.n_name, r.r_name) END AS joined FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def c5_field_reconciliation(table):
    n, r = table("nation"), table("region")
    both = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return both.select("n_nationkey", F.coalesce(F.nullif(F.trim("r_name"), F.lit("")), "n_name").alias("region_name"), F.when(F.col("n_name") == F.col("r_name"), F.col("n_name")).otherwise(F.concat_ws(" / ", "n_name", "r_name")).alias("joined"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS linked FROM customer")
def c6_linked_split(table):
    keys = table("orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    c = table("customer").select("c_custkey")
    return c.join(keys, "c_custkey", "left_semi").withColumn("linked", F.lit(True)).union(c.join(keys, "c_custkey", "left_anti").withColumn("linked", F.lit(False)))


@query("""WITH s AS (SELECT s_suppkey, c_custkey, 1 - levenshtein(s_name, c_name) / greatest(length(s_name), length(c_name)) AS similarity FROM supplier JOIN customer ON s_nationkey = c_nationkey),
r AS (SELECT *, row_number() OVER w AS i, lead(similarity) OVER w AS nxt FROM s WINDOW w AS (PARTITION BY s_suppkey ORDER BY similarity DESC, c_custkey))
SELECT s_suppkey, c_custkey, round(similarity, 6) AS similarity, round(similarity - coalesce(nxt, 0), 6) AS margin FROM r WHERE i = 1""")
def c7_fuzzy_title_match(table):
    s, c = table("supplier").withColumnRenamed("s_nationkey", "nation"), table("customer").withColumnRenamed("c_nationkey", "nation")
    return R.best_match(s, c, "nation", "s_suppkey", "c_custkey", "s_name", "c_name").select("s_suppkey", "c_custkey", F.round("similarity", 6).alias("similarity"), F.round("margin", 6).alias("margin"))


@query(f"""WITH {VIDEOS_SQL} SELECT a.video_id, count(b.video_id) AS prior_n, round(avg(b.views), 6) AS prior_mean, round(max(b.views), 2) AS prior_max FROM videos a
LEFT JOIN videos b ON a.source = b.source AND b.published + INTERVAL 30 DAY <= a.published AND b.video_id <> a.video_id AND b.kind IS DISTINCT FROM a.kind GROUP BY a.video_id""")
def c9_asof_history(table):
    v = videos(table).select("video_id", "source", "published", "views", F.col("kind").alias("family"), (F.col("published") + F.expr("INTERVAL 30 DAYS")).alias("observed"))
    found = R.prior_outcomes(v, "source", "published", "observed", "video_id", "family", "views")
    return found.select("video_id", "prior_n", F.round("prior_mean", 6).alias("prior_mean"), F.round("prior_max", 2).alias("prior_max"))


@query(f"WITH {VIDEOS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY published, video_id) AS i, count(*) OVER (PARTITION BY source) AS n FROM videos) SELECT video_id, CASE WHEN i <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS part FROM n")
def c10_time_split(table):
    return R.time_split(videos(table), "source", "published", "video_id").select("video_id", "part")


@query("WITH f AS (SELECT doc_id, sha256(text) AS family, doc_id % 5 = 0 AS test FROM documents) SELECT doc_id FROM f WHERE NOT test AND family NOT IN (SELECT family FROM f WHERE test)")
def c11_family_purge(table):
    f = table("documents").select("doc_id", F.sha2("text", 256).alias("family"), (F.col("doc_id") % 5 == 0).alias("test"))
    return R.purged(f.filter(~F.col("test")), f.filter("test"), "family").select("doc_id")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, value FROM events), s AS (SELECT user_id, t AS start_at, t + 600 AS end_at, event_id AS span FROM e)
SELECT span, count(*) AS n, round(sum(value), 4) AS total FROM e JOIN s ON e.user_id = s.user_id AND e.t >= s.start_at AND e.t < s.end_at GROUP BY span""")
def c15_interval_join_all(table):
    return event_spans(table)


def event_spans(table):
    """Events in the ten minutes from each event of their user."""
    e = table("events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "value")
    s = e.select("user_id", F.col("at").alias("start_at"), (F.col("at") + 600).alias("end_at"), F.col("event_id").alias("span"))
    return R.interval_join(e, s, "user_id", "at", "start_at", "end_at", 600.0).groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT l_partkey AS part, list_sort(list_distinct(list(l_suppkey))) AS suppliers FROM lineitem GROUP BY l_partkey")
def c19_membership_multimap(table):
    return table("lineitem").select("l_partkey", "l_suppkey").distinct().groupBy(F.col("l_partkey").alias("part")).agg(F.sort_array(F.collect_list("l_suppkey")).alias("suppliers"))
