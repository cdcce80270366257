"""Row contracts, gates and text keys (A, B, G, H): what is created, kept or renamed, row by row or by a small dimension."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from creatorlake.functions import text as T
from creatorlake.plans.panel import LONG_SQL, VIDEOS_SQL, metric_values, videos
from creatorlake.plans.registry import query

NEW_YEAR = "2000-01-01"
#: What each metric is made of; price is the outcome.
LINEAGE = {"lines": ["lines"], "quantity": ["quantity"], "price": ["price"], "discount": ["discount"], "tax": ["price", "tax"]}
PRE = ("lines", "quantity")
SHAPES_SQL = "shapes AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' THEN l_quantity END AS w, 10 * l_linenumber AS h, CASE WHEN l_tax > 0.01 THEN l_extendedprice / 500 END AS d FROM lineitem)"


def shapes(table):
    return table("lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("w"), (10 * F.col("l_linenumber")).alias("h"), F.when(F.col("l_tax") > 0.01, F.col("l_extendedprice") / 500).alias("d")
    )


@query(f"SELECT md5(concat_ws('|', c_name, c_mktsegment, c_nationkey)) AS id, c_name, c_mktsegment, TIMESTAMP '{NEW_YEAR}' AS created_at, TIMESTAMP '{NEW_YEAR}' AS updated_at FROM customer")
def a5_created_rows(table):
    """New rows get an id made of their fields, so that creating them again gives the same ones, and both timestamps."""
    now = F.lit(NEW_YEAR).cast("timestamp_ntz")
    key = F.md5(F.concat_ws("|", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string")))
    return table("customer").select(key.alias("id"), "c_name", "c_mktsegment", now.alias("created_at"), now.alias("updated_at"))


@query(f"WITH {VIDEOS_SQL} SELECT source, video_id, views, CASE WHEN status = 'P' THEN 'not stored' WHEN lines < 3 THEN 'too few lines' WHEN views <= 0 THEN 'no outcome' ELSE 'eligible' END AS eligibility FROM videos")
def a12_manifest_rows(table):
    """Each channel's videos as rows, with the first reason against each; no channel is put together."""
    row = videos(table)
    reason = F.when(F.col("status") == "P", "not stored").when(F.col("lines") < 3, "too few lines").when(F.col("views") <= 0, "no outcome").otherwise("eligible")
    return row.select("source", "video_id", "views", reason.alias("eligibility"))


@query("SELECT vec_id, label, round(embedding[1], 5) AS x, round(embedding[2], 5) AS y FROM embeddings ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT 200")
def a20_plot_sample(table):
    """Two projections and the colour of the 200 rows with the lowest hashes."""
    v = table("embeddings").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(200)
    return v.select("vec_id", "label", F.round(F.col("embedding")[0], 5).alias("x"), F.round(F.col("embedding")[1], 5).alias("y"))


@query("SELECT p_type AS name, round(sum(l_extendedprice), 2) AS total, round(sum(l_extendedprice) / (SELECT sum(l_extendedprice) FROM lineitem JOIN part ON p_partkey = l_partkey), 6) AS share FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def a21_chart_data(table):
    by = table("lineitem").join(table("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_type").alias("name")).agg(F.sum("l_extendedprice").alias("t"))
    return by.select("name", F.round("t", 2).alias("total"), F.round(F.col("t") / F.sum("t").over(Window.partitionBy()), 6).alias("share"))


@query("WITH e AS (SELECT DISTINCT l_suppkey AS a, l_partkey AS b FROM lineitem) SELECT 's' || a AS node, count(*) AS degree FROM e GROUP BY a UNION ALL SELECT 'p' || b, count(*) FROM e GROUP BY b")
def a23_compact_graph_nodes(table):
    """The nodes of a graph without their connection arrays, which the edges say already."""
    e = table("lineitem").select(F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")).distinct()
    side = lambda c, mark: e.groupBy(c).count().select(F.concat(F.lit(mark), F.col(c).cast("string")).alias("node"), F.col("count").alias("degree"))
    return side("a", "s").union(side("b", "p"))


@query(f"WITH p AS (SELECT o_orderkey, date_diff('day', o_orderdate, TIMESTAMP '{NEW_YEAR}') AS d FROM orders), t AS (SELECT o_orderkey, CASE WHEN d < 0 THEN NULL WHEN d < 365 THEN (d // 30) || ' months ago' ELSE (d // 365) || ' Years ago' END AS said FROM p) SELECT o_orderkey, said FROM t WHERE said IS NULL OR NOT regexp_matches(said, '(?i)year')")
def b2_recent_by_relative_text(table):
    """Videos whose "... ago" names no years; those without such a text stay."""
    d = F.datediff(F.lit(NEW_YEAR).cast("date"), F.col("o_orderdate").cast("date"))
    said = F.when(d < 0, F.lit(None)).when(d < 365, F.concat(F.floor(d / 30).cast("string"), F.lit(" months ago"))).otherwise(F.concat(F.floor(d / 365).cast("string"), F.lit(" Years ago")))
    return table("orders").select("o_orderkey", said.alias("said")).filter(F.col("said").isNull() | ~F.col("said").rlike("(?i)year"))


@query(f"WITH {SHAPES_SQL} SELECT l_orderkey, l_linenumber FROM shapes WHERE NOT coalesce(w > 0 AND h > 0 AND h <= w, false) AND NOT coalesce(d > 185, false)")
def b3_vertical_short(table):
    """Not known to be as wide as high or wider, nor known to be longer than 185 seconds."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    w, h, d = F.col("w"), F.col("h"), F.col("d")
    return shapes(table).filter(no((w > 0) & (h > 0) & (h <= w)) & no(d > 185)).select("l_orderkey", "l_linenumber")


@query(f"WITH {SHAPES_SQL} SELECT l_orderkey, l_linenumber FROM shapes WHERE CASE WHEN w > 0 AND h > 0 THEN w > h ELSE true END")
def b4_landscape(table):
    return shapes(table).filter(F.when((F.col("w") > 0) & (F.col("h") > 0), F.col("w") > F.col("h")).otherwise(True)).select("l_orderkey", "l_linenumber")


@query(f"WITH {LONG_SQL} SELECT metric, CASE WHEN metric IN {PRE} THEN 'pre' ELSE 'post' END AS layer, count(*) AS n FROM long GROUP BY 1, 2")
def b7_metric_layer(table):
    return metric_values(table).groupBy("metric", F.when(F.col("metric").isin(*PRE), "pre").otherwise("post").alias("layer")).agg(F.count(F.lit(1)).alias("n"))


COMPOSITE_SQL = "WITH c AS (SELECT DISTINCT p_brand || '_x_' || p_type AS key FROM part), b AS (SELECT p_brand AS k FROM part GROUP BY 1 HAVING count(*) >= 8), t AS (SELECT p_type AS k FROM part GROUP BY 1 HAVING avg(p_size) > 25)"


@query(f"{COMPOSITE_SQL} SELECT key FROM c WHERE split_part(key, '_x_', 1) IN (SELECT k FROM b) AND split_part(key, '_x_', 2) IN (SELECT k FROM t)")
def b10_composites_with_components(table):
    """Composite keys both of whose components exist."""
    p = table("part")
    keys = p.select(F.concat_ws("_x_", "p_brand", "p_type").alias("key")).distinct().withColumn("s", F.split("key", "_x_"))
    first = p.groupBy("p_brand").count().filter("count >= 8").select(F.col("p_brand").alias("a"))
    second = p.groupBy("p_type").agg(F.avg("p_size").alias("m")).filter("m > 25").select(F.col("p_type").alias("b"))
    return keys.join(first, F.col("s")[0] == F.col("a"), "left_semi").join(second, F.col("s")[1] == F.col("b"), "left_semi").select("key")


@query(f"WITH {LONG_SQL}, w AS (SELECT metric, value, target FROM long UNION ALL SELECT 'log_views', log10(views + 1), log10(views + 1) FROM videos) SELECT metric, round(corr(value, target), 6) AS r FROM w GROUP BY metric HAVING abs(corr(value, target)) < 0.99")
def b11_target_proxy_guard(table):
    """The metrics that are not the outcome under another name: log_views is, and goes."""
    outcome = F.log10(F.col("views") + 1)
    proxy = videos(table).select(F.lit("log_views").alias("metric"), outcome.alias("value"), outcome.alias("target"))
    r = metric_values(table).select("metric", "value", "target").unionByName(proxy).groupBy("metric").agg(F.corr("value", "target").alias("r"))
    return r.filter(F.abs("r") < 0.99).select("metric", F.round("r", 6).alias("r"))


@query(f"WITH {LONG_SQL} SELECT metric, count(*) AS n, round(avg(value), 4) AS mean FROM long WHERE NOT regexp_matches(metric, '^(dis|tax)') GROUP BY 1")
def b12_dropped_keys(table):
    return metric_values(table).filter(~F.col("metric").rlike("^(dis|tax)")).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"WITH {VIDEOS_SQL}, e AS (SELECT source, count(*) FILTER (WHERE views > 100000) AS k FROM videos GROUP BY 1) SELECT source, k >= 8 AS eligible_only, count(*) AS n, round(avg(views), 5) AS mean FROM videos JOIN e USING (source) WHERE k < 8 OR views > 100000 GROUP BY 1, 2")
def b15_analysis_population(table):
    """A source's eligible rows if there are 8, else all it has; both sums are kept, so rows aren't read twice."""
    v, good = videos(table), F.col("views") > 100_000
    s = v.groupBy("source").agg(F.count_if(good).alias("k"), F.count(F.lit(1)).alias("all"), F.avg(F.when(good, F.col("views"))).alias("a"), F.avg("views").alias("b"))
    only = F.col("k") >= 8
    return s.select("source", only.alias("eligible_only"), F.when(only, F.col("k")).otherwise(F.col("all")).alias("n"), F.round(F.when(only, F.col("a")).otherwise(F.col("b")), 5).alias("mean"))


@query(f"WITH {LONG_SQL} SELECT metric, count(*) AS n, round(avg(value), 4) AS mean FROM long WHERE metric NOT IN ('price', 'tax') GROUP BY 1")
def b16_leakage_safe_features(table):
    """Features none of whose inputs is the outcome."""
    safe = [k for k, made_of in LINEAGE.items() if "price" not in made_of]
    return metric_values(table).filter(F.col("metric").isin(safe)).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("WITH e AS (SELECT event_id, CASE WHEN event_type = 'view' THEN NULL WHEN event_type = 'click' AND value > 100 THEN 'nan'::DOUBLE ELSE value END AS v FROM events) SELECT event_id, CASE WHEN v IS NOT NULL AND isfinite(v) THEN v END AS value, v IS NOT NULL AND isfinite(v) AS available, CASE WHEN v IS NULL THEN 'missing' WHEN NOT isfinite(v) THEN 'not finite' END AS reason FROM e")
def b17_feature_cell(table):
    """A value, whether it can be used, and if not why."""
    v = F.when(F.col("event_type") == "view", F.lit(None).cast("double")).when((F.col("event_type") == "click") & (F.col("value") > 100), F.lit(float("nan"))).otherwise(F.col("value"))
    e = table("events").select("event_id", v.alias("v"))
    bad = F.isnan("v") | (F.abs("v") == float("inf"))
    ok = F.col("v").isNotNull() & ~bad
    return e.select("event_id", F.when(ok, F.col("v")).alias("value"), F.coalesce(ok, F.lit(False)).alias("available"), F.when(F.col("v").isNull(), "missing").when(bad, "not finite").alias("reason"))


@query("SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN 'id:' || p_brand END, CASE WHEN p_size > 25 THEN 'title:' || lower(p_name) END, CASE WHEN p_size > 10 THEN 'type:' || p_type END, 'video:' || p_partkey) AS family FROM part")
def g3_family_by_precedence(table):
    """The first that is known of: declared family, title, type, the row itself."""
    known = lambda size, mark, c: F.when(F.col("p_size") > size, F.concat(F.lit(mark), c))
    family = F.coalesce(known(40, "id:", F.col("p_brand")), known(25, "title:", F.lower("p_name")), known(10, "type:", F.col("p_type")), F.concat(F.lit("video:"), F.col("p_partkey").cast("string")))
    return table("part").select("p_partkey", family.alias("family"))


@query("WITH m AS (SELECT DISTINCT l_partkey AS x, l_returnflag AS g FROM lineitem), s AS (SELECT g, count(*) AS n FROM m GROUP BY g), b AS (SELECT a.g AS a, b.g AS b, count(*) AS c FROM m a JOIN m b ON a.x = b.x AND a.g < b.g GROUP BY 1, 2) SELECT a, b, round(c / (p.n + q.n - c), 6) AS jaccard FROM b JOIN s p ON p.g = a JOIN s q ON q.g = b")
def g7_member_set_jaccard(table):
    """Jaccard of the member sets of any two groups: a member's groups are put together, so pairs grow with the groups of a member."""
    m = table("lineitem").select(F.col("l_partkey").alias("x"), F.col("l_returnflag").alias("g")).distinct()
    sets = m.groupBy("x").agg(F.sort_array(F.collect_set("g")).alias("gs"))
    pair = sets.select(F.posexplode("gs").alias("i", "a"), "gs").select("a", F.explode(F.slice("gs", F.col("i") + 2, F.size("gs"))).alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    n = m.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    both = pair.join(n.toDF("a", "na"), "a").join(n.toDF("b", "nb"), "b")
    return both.select("a", "b", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 6).alias("jaccard"))


@query("WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, len(k) AS lines, md5(array_to_string(k, ' ')) AS text_md5 FROM (SELECT doc_id, list_filter(l, lambda x, i: x <> '' AND (i = 1 OR x <> l[i - 1])) AS k FROM s)")
def h3_caption_text(table):
    """Lines that repeat the one before, and empty ones, are left out."""
    d = table("documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    kept = F.filter("l", lambda x, i: (x != "") & ((i == 0) | (x != F.get("l", i - 1))))
    return d.select("doc_id", kept.alias("k")).select("doc_id", F.size("k").cast("long").alias("lines"), F.md5(F.array_join("k", " ")).alias("text_md5"))


SINGULAR_SQL = (
    "CASE WHEN length(word) <= 2 THEN word "
    + " ".join(f"WHEN low = '{a}' THEN '{b}'" for a, b in T.IRREGULAR_PLURALS.items())
    + r""" WHEN word = upper(word) AND length(word) <= 4 THEN CASE WHEN low LIKE '%s' THEN left(low, length(low) - 1) ELSE low END
WHEN low LIKE '%ies' AND length(low) > 4 THEN left(low, length(low) - 3) || 'y' WHEN regexp_matches(low, '(x|z|ch|sh|ss)es$') THEN left(low, length(low) - 2)
WHEN low LIKE '%ses' AND length(low) > 4 THEN left(low, length(low) - 1) WHEN low LIKE '%s' AND NOT regexp_matches(low, '(ss|us|is)$') THEN left(low, length(low) - 1) ELSE low END"""
)


@query(f"WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM conversations), l AS (SELECT word, lower(word) AS low FROM w) SELECT word, {SINGULAR_SQL} AS single FROM l")
def h10_singular(table):
    """Each word as it is written, and its singular."""
    w = table("conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), 0)).alias("word")).distinct()
    return w.select("word", T.singular(F.col("word")).alias("single"))


@query("SELECT c_custkey, sha256(to_json({'c_custkey': c_custkey, 'c_mktsegment': c_mktsegment, 'c_name': c_name, 'c_nationkey': c_nationkey})::VARCHAR) AS hash FROM customer")
def h20_row_hash(table):
    """SHA-256 of the row as JSON with its keys in order."""
    keys = sorted(["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return table("customer").select("c_custkey", F.sha2(F.to_json(F.struct(*keys)), 256).alias("hash"))


@query("WITH i AS (SELECT DISTINCT 'mech:' || p_type || ':' || p_brand AS id FROM part) SELECT id, split_part(id, ':', 2) AS kind, split_part(id, ':', 3) AS name, replace(id, 'mech:', 'principle:') AS principle FROM i")
def h23_mechanism_id(table):
    """Ids composed of kind and name, and parsed again."""
    i = table("part").select(F.concat_ws(":", F.lit("mech"), "p_type", "p_brand").alias("id")).distinct()
    part = lambda k: F.regexp_extract("id", r"^mech:([^:]*):(.*)$", k)
    return i.select("id", part(1).alias("kind"), part(2).alias("name"), F.concat_ws(":", F.lit("principle"), part(1), part(2)).alias("principle"))


@query("SELECT l_orderkey, l_linenumber, greatest(least(l_discount * 12 - 0.1, 1), 0) AS unit, l_discount * 12 - 0.1 BETWEEN 0 AND 1 AS inside FROM lineitem")
def h27_unit_interval(table):
    x = F.col("l_discount") * 12 - 0.1
    return table("lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0)).alias("unit"), x.between(0, 1).alias("inside"))


@query("WITH t AS (SELECT DISTINCT string_split(p_name, ' ') AS w FROM part) SELECT array_to_string(w, ' ') AS name, i, j, array_to_string(w[i:j], ' ') AS span FROM (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM t) CROSS JOIN LATERAL (SELECT unnest(range(i, len(w) + 1)) AS j)")
def o1_spans(table):
    """All contiguous spans of a token list."""
    t = table("part").select(F.col("p_name").alias("name")).distinct().withColumn("w", F.split("name", " "))
    i = t.select("name", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("i"))
    ij = i.select("name", "w", "i", F.explode(F.sequence("i", F.size("w"))).alias("j"))
    return ij.select("name", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.array_join(F.slice("w", F.col("i"), F.col("j") - F.col("i") + 1), " ").alias("span"))


@query("""WITH t AS (SELECT DISTINCT p_name AS name, string_split(p_name, ' ') AS w FROM part), i AS (SELECT name, w, unnest(range(1, len(w) + 1)) AS i FROM t), j AS (SELECT name, w, i, unnest(range(i, len(w) + 1)) AS j FROM i)
SELECT name, i, j, array_to_string(list_filter(w, lambda x, k: k <> i AND k <> j), ' ') AS variant FROM j""")
def o2_leave_one_out(table):
    """A text without each of its words (i = j), and without each pair of them."""
    t = table("part").select(F.col("p_name").alias("name")).distinct().withColumn("w", F.split("name", " "))
    i = t.select("name", "w", F.posexplode("w").alias("a", "gone"))
    both = i.select("name", "w", "a", F.explode(F.sequence(F.col("a"), F.size("w") - 1)).alias("b"))
    variant = F.array_join(F.filter("w", lambda x, at: (at != F.col("a")) & (at != F.col("b"))), " ")
    return both.select("name", (F.col("a") + 1).cast("long").alias("i"), (F.col("b") + 1).cast("long").alias("j"), variant.alias("variant"))
