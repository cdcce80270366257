"""Evaluation and evidence tables (B, G, H, J, K, L, N, O, U): sums by small keys, and row by row; no group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from creatorlake.operators.windows import with_average_rank
from creatorlake.plans.panel import LONG_SQL, METRICS, VIDEOS_SQL, metric_values, videos
from creatorlake.plans.registry import query

FAMILIES = {"ask": ["how", "what", "why"], "number": ["one", "two", "three"], "time": ["now", "today", "new"]}
QUANTITIES = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "couple": 2, "dozen": 12}
WORDS_SQL = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '')"
LEXICON_SQL = "lexicon(family, word) AS (VALUES " + ", ".join(f"('{f}', '{w}')" for f, ws in FAMILIES.items() for w in ws) + ")"
WEIGHTED_SQL = VIDEOS_SQL + ", w AS (SELECT *, 1.0 / count(*) OVER (PARTITION BY source) AS weight, log10(views + 1) AS y, log10(quantity) AS x FROM videos)"
FOLD_SQL = "(('0x' || substr(md5(source::VARCHAR), 1, 4))::INT % 5)"
#: sums that a line through x and y needs, by group; and its slope and intercept from them
MOMENTS_SQL = "count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy"


def words(text: str = "text") -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def lexicon(table) -> DataFrame:
    spark = table("region").sparkSession
    return spark.createDataFrame([(f, w) for f, ws in FAMILIES.items() for w in ws], "family string, word string")


def weighted(table) -> DataFrame:
    """The videos with the weight that makes all sources equal, y = log10(views + 1) and x = log10(quantity)."""
    v = videos(table)
    return v.join(v.groupBy("source").agg((1.0 / F.count(F.lit(1))).alias("weight")), "source").withColumn("y", F.log10(F.col("views") + 1)).withColumn("x", F.log10("quantity"))


def fold() -> Column:
    return (F.conv(F.substring(F.md5(F.col("source").cast("string")), 1, 4), 16, 10).cast("int") % 5).alias("fold")


def moments(rows: DataFrame, *by) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("x") * F.col("y")).alias("sxy"))


def without_own(sums: DataFrame, key: str) -> DataFrame:
    """slope and icept of the line through all groups but each one's own, for groups of a small dimension."""
    names = ["n", "sx", "sy", "sxx", "sxy"]
    total = sums.agg(*[F.sum(c).alias(f"t_{c}") for c in names])
    n, sx, sy, sxx, sxy = (F.col(f"t_{c}") - F.col(c) for c in names)
    slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
    return sums.join(F.broadcast(total), F.lit(True)).select(key, slope.alias("slope"), ((sy - slope * sx) / n).alias("icept"), (sy / n).alias("guess"))


def rest_sql(key: str) -> str:
    sums = f"s AS (SELECT {key}, {MOMENTS_SQL} FROM r GROUP BY 1), t AS (SELECT sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(sxx) AS sxx, sum(sxy) AS sxy FROM s)"
    left = f"d AS (SELECT s.{key}, t.n - s.n AS n, t.sx - s.sx AS sx, t.sy - s.sy AS sy, t.sxx - s.sxx AS sxx, t.sxy - s.sxy AS sxy FROM s CROSS JOIN t)"
    return f"{sums}, {left}, m AS (SELECT {key}, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, sy / n AS guess, (sy - (n * sxy - sx * sy) / (n * sxx - sx * sx) * sx) / n AS icept FROM d)"


def errors_sql(key: str) -> str:
    return f"SELECT {key}, count(*) AS n, round(avg(abs(y - icept - slope * x)), 6) AS mae, round(1 - sum(power(y - icept - slope * x, 2)) / sum(power(y - guess, 2)), 6) AS skill FROM r JOIN m USING ({key}) GROUP BY 1"


def errors(rows: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    e, g = F.col("y") - F.col("icept") - F.col("slope") * F.col("x"), F.col("y") - F.col("guess")
    return rows.join(F.broadcast(lines), key).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(1 - F.sum(e * e) / F.sum(g * g), 6).alias("skill"))


@query("WITH c AS (SELECT DISTINCT p_brand || '_at_' || p_size AS key FROM part), b AS (SELECT p_brand FROM part GROUP BY 1 HAVING count(*) >= 8) SELECT key FROM c WHERE regexp_extract(key, '^(.+)_at_([0-9]+)$', 2)::INT BETWEEN 5 AND 45 AND regexp_extract(key, '^(.+)_at_([0-9]+)$', 1) IN (SELECT p_brand FROM b)")
def b5_valid_composites(table):
    """Parameterised keys whose number is in range and whose name is known."""
    p, form = table("part"), "^(.+)_at_([0-9]+)$"
    keys = p.select(F.concat("p_brand", F.lit("_at_"), F.col("p_size").cast("string")).alias("key")).distinct()
    known = p.groupBy("p_brand").count().filter("count >= 8").select("p_brand")
    cut = keys.select("key", F.regexp_extract("key", form, 1).alias("p_brand"), F.regexp_extract("key", form, 2).cast("int").alias("at"))
    return cut.filter("at between 5 and 45").join(known, "p_brand", "left_semi").select("key")


@query(f"WITH u AS (SELECT conv_id AS doc_id, arg_min(text, turn) AS opening FROM conversations WHERE role = 'user' GROUP BY 1), d AS (SELECT doc_id, n_chars / 15.0 AS seconds, {WORDS_SQL} AS own FROM documents) SELECT doc_id, md5(coalesce(opening, array_to_string(own[1:ceil(len(own) * 5 / greatest(seconds, 5))::INT], ' '))) AS opening, opening IS NOT NULL AS labelled FROM d LEFT JOIN u USING (doc_id)")
def h8_opening_text(table):
    """The labelled opening segment (the first turn of the user), else the words of the first five seconds at an even rate."""
    said = table("conversations").filter("role = 'user'").groupBy(F.col("conv_id").alias("doc_id")).agg(F.min_by("text", "turn").alias("opening"))
    d = table("documents").select("doc_id", (F.col("n_chars") / 15.0).alias("seconds"), words().alias("own"))
    first = F.array_join(F.slice("own", 1, F.ceil(F.size("own") * 5 / F.greatest("seconds", F.lit(5.0))).cast("int")), " ")
    return d.join(said, "doc_id", "left").select("doc_id", F.md5(F.coalesce("opening", first)).alias("opening"), F.col("opening").isNotNull().alias("labelled"))


@query("WITH w AS (SELECT unnest(" + WORDS_SQL + ") AS word FROM documents), q AS (SELECT CASE " + " ".join(f"WHEN word = '{w}' THEN {n}" for w, n in QUANTITIES.items()) + " WHEN regexp_full_match(word, '[0-9]{1,6}') THEN word::INT END AS quantity FROM w) SELECT quantity, count(*) AS n FROM q WHERE quantity IS NOT NULL GROUP BY 1")
def h11_quantity_words(table):
    """Quantities said in words or digits, and how often."""
    counts = table("documents").select(F.explode(words()).alias("word")).groupBy("word").count()
    said = F.create_map(*[F.lit(x) for pair in QUANTITIES.items() for x in pair])
    value = F.coalesce(said[F.col("word")], F.when(F.col("word").rlike("^[0-9]{1,6}$"), F.expr("try_cast(word AS int)")))
    return counts.select(value.alias("quantity"), "count").filter("quantity is not null").groupBy("quantity").agg(F.sum("count").alias("n"))


@query(f"WITH q AS (SELECT list_distinct({WORDS_SQL}) AS own FROM benchmark ORDER BY item_id LIMIT 1), d AS (SELECT doc_id, list_distinct({WORDS_SQL}) AS own FROM documents) SELECT doc_id, round(len(list_intersect(d.own, q.own)) / len(q.own)::DOUBLE, 6) AS overlap FROM d CROSS JOIN q")
def h15_lexical_similarity(table):
    """Share of the tokens of one prompt (the first item) that each document has."""
    prompt = table("benchmark").orderBy("item_id").limit(1).select(F.array_distinct(words()).alias("asked"))
    d = table("documents").select("doc_id", F.array_distinct(words()).alias("own"))
    return d.join(F.broadcast(prompt), F.lit(True)).select("doc_id", F.round(F.size(F.array_intersect("own", "asked")) / F.size("asked"), 6).alias("overlap"))


@query(f"WITH {LEXICON_SQL}, w AS (SELECT conv_id, turn, unnest({WORDS_SQL}) AS word FROM conversations) SELECT family, count(*) AS units FROM (SELECT DISTINCT conv_id, turn, family FROM w JOIN lexicon USING (word)) GROUP BY 1")
def h21_phrase_families(table):
    """In how many turns each family of phrases is; a family counts once for a turn."""
    w = table("conversations").select("conv_id", "turn", F.explode(F.array_distinct(words())).alias("word"))
    return w.join(F.broadcast(lexicon(table)), "word").select("conv_id", "turn", "family").distinct().groupBy("family").agg(F.count(F.lit(1)).alias("units"))


@query(f"WITH {WEIGHTED_SQL}, a AS (SELECT *, rank() OVER (ORDER BY quantity) + (count(*) OVER (PARTITION BY quantity) - 1) / 2.0 AS p, rank() OVER (ORDER BY views) + (count(*) OVER (PARTITION BY views) - 1) / 2.0 AS q FROM w), m AS (SELECT sum(weight * p) / sum(weight) AS mp, sum(weight * q) / sum(weight) AS mq FROM a) SELECT count(*) AS n, round(sum(weight * (p - mp) * (q - mq)) / sqrt(sum(weight * (p - mp) * (p - mp)) * sum(weight * (q - mq) * (q - mq))), 6) AS rho FROM a CROSS JOIN m")
def j7_weighted_spearman(table):
    """Rank correlation of quantity and outcome with each source of equal weight."""
    a = with_average_rank(with_average_rank(weighted(table), "quantity", name="p"), "views", name="q")
    w, p, q = F.col("weight"), F.col("p"), F.col("q")
    m = a.agg((F.sum(w * p) / F.sum(w)).alias("mp"), (F.sum(w * q) / F.sum(w)).alias("mq"))
    dp, dq = p - F.col("mp"), q - F.col("mq")
    return a.join(F.broadcast(m), F.lit(True)).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(w * dp * dq) / F.sqrt(F.sum(w * dp * dp) * F.sum(w * dq * dq)), 6).alias("rho"))


@query(f"WITH {WEIGHTED_SQL}, r AS (SELECT *, {FOLD_SQL} AS fold FROM w), {rest_sql('fold')}, e AS (SELECT fold, y, y - icept - slope * x AS e, y - guess AS b FROM r JOIN m USING (fold)), v AS (SELECT sum(e * e) / count(*) AS ve, sum(b * b) / count(*) AS vb FROM e) SELECT fold, count(*) AS n, round(avg((b * b / vb - e * e / ve + ln(vb / ve)) / (2 * ln(2))), 6) AS bits FROM e CROSS JOIN v GROUP BY 1")
def j38_information_gain(table):
    """Bits that a line through quantity adds to a Gaussian around the mean, on sources held out, by fold."""
    r = weighted(table).withColumn("fold", fold())
    line = without_own(moments(r, "fold"), "fold")
    e = r.join(F.broadcast(line), "fold").select("fold", (F.col("y") - F.col("icept") - F.col("slope") * F.col("x")).alias("e"), (F.col("y") - F.col("guess")).alias("b"))
    spread = e.agg(F.avg(F.col("e") * F.col("e")).alias("ve"), F.avg(F.col("b") * F.col("b")).alias("vb"))
    bits = (F.col("b") * F.col("b") / F.col("vb") - F.col("e") * F.col("e") / F.col("ve") + F.log(F.col("vb") / F.col("ve"))) / (2 * F.log(F.lit(2.0)))
    return e.join(F.broadcast(spread), F.lit(True)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(bits), 6).alias("bits"))


@query(f"WITH s AS (SELECT user_id AS id, event_type AS signal, avg(value) AS x FROM events GROUP BY 1, 2), o AS (SELECT o_custkey AS id, count(*)::DOUBLE AS orders, avg(o_totalprice) AS price FROM orders GROUP BY 1), m AS (SELECT id, 'orders' AS metric, orders AS y FROM o UNION ALL SELECT id, 'price', price FROM o) SELECT signal, metric, count(*) AS n, round(corr(x, y), 6) AS r FROM s JOIN m USING (id) GROUP BY 1, 2 HAVING count(*) >= 3")
def j44_lens_grid(table):
    """Correlation of each signal with each metric over the ids that have both."""
    s = table("events").groupBy(F.col("user_id").alias("id"), F.col("event_type").alias("signal")).agg(F.avg("value").alias("x"))
    o = table("orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("orders"), F.avg("o_totalprice").alias("price"))
    m = o.unpivot("id", ["orders", "price"], "metric", "y")
    return s.join(m, "id").groupBy("signal", "metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("x", "y"), 6).alias("r")).filter("n >= 3")


@query(f"WITH {LONG_SQL}, e AS (SELECT metric, count(*) AS n, corr(value, target) AS r FROM long GROUP BY 1) SELECT metric AS source, 'views' AS target, 'pearson' AS kind, n, round(abs(r), 6) AS strength, CASE WHEN r < 0 THEN 'negative' ELSE 'positive' END AS direction FROM e WHERE n >= 50")
def k15_derived_edges(table):
    """Edges of the metric graph from experiments that have enough rows."""
    e = metric_values(table).groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.corr("value", "target").alias("r")).filter("n >= 50")
    return e.select(F.col("metric").alias("source"), F.lit("views").alias("target"), F.lit("pearson").alias("kind"), "n", F.round(F.abs("r"), 6).alias("strength"), F.when(F.col("r") < 0, "negative").otherwise("positive").alias("direction"))


BRAND_SQL = VIDEOS_SQL + """, c AS (SELECT l_orderkey AS video_id, p_brand AS mechanism, count(*) AS k FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
g AS (SELECT video_id, views, mechanism, coalesce(k, 0) AS k FROM videos CROSS JOIN (SELECT DISTINCT mechanism FROM c) LEFT JOIN c USING (video_id, mechanism)),
a AS (SELECT mechanism, rank() OVER (PARTITION BY mechanism ORDER BY k) + (count(*) OVER (PARTITION BY mechanism, k) - 1) / 2.0 AS p, rank() OVER (PARTITION BY mechanism ORDER BY views) + (count(*) OVER (PARTITION BY mechanism, views) - 1) / 2.0 AS q, k FROM g)"""


@query(f"WITH {BRAND_SQL} SELECT mechanism, sum((k > 0)::INT)::BIGINT AS n, round(corr(p, q), 6) AS rho FROM a GROUP BY 1 HAVING sum((k > 0)::INT) >= 20")
def k16_mechanism_grid(table):
    """Spearman of how often a mechanism is in a video, zeros included, with the outcome. The zeros of a mechanism are never made: they share one rank."""
    v = with_average_rank(videos(table).select("video_id", "views"), "views", name="q")
    c = table("lineitem").join(table("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("l_orderkey").alias("video_id"), F.col("p_brand").alias("mechanism")).agg(F.count(F.lit(1)).alias("k"))
    total = v.agg(F.count(F.lit(1)).alias("all"), F.var_pop("q").alias("vq"))
    mid = (F.col("all") + 1) / 2
    by_k = c.join(v, "video_id").join(F.broadcast(total), F.lit(True)).groupBy("mechanism", "k", "all", "vq").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("q") - mid).alias("dq"))
    held = by_k.groupBy("mechanism", "all", "vq").agg(F.sum("m").alias("n"), F.sort_array(F.collect_list(F.struct("k", "m", "dq"))).alias("by"))  # one entry for each count
    zeros, start = F.col("all") - F.col("n"), F.struct((F.col("all") - F.col("n")).cast("double").alias("below"), F.lit(0.0).alias("cov"), F.lit(0.0).alias("var"))
    zero_rank = (zeros + 1) / 2

    def step(s, x):
        rank = s["below"] + (x["m"] + 1) / 2
        return F.struct((s["below"] + x["m"]).alias("below"), (s["cov"] + (rank - zero_rank) * x["dq"]).alias("cov"), (s["var"] + x["m"] * (rank - mid) * (rank - mid)).alias("var"))

    s = held.withColumn("s", F.aggregate("by", start, step))
    var = F.col("s.var") + zeros * (zero_rank - mid) * (zero_rank - mid)
    return s.filter("n >= 20").select("mechanism", "n", F.round(F.col("s.cov") / F.sqrt(var * F.col("all") * F.col("vq")), 6).alias("rho"))


@query(f"WITH {WEIGHTED_SQL}, m AS (SELECT 'status' AS map, status AS cluster, weight, y FROM w UNION ALL SELECT 'kind', kind, weight, y FROM w), c AS (SELECT map, cluster, count(*) AS n, sum(weight) AS w, sum(weight * y) AS wy, sum(weight * y * y) AS wyy FROM m GROUP BY 1, 2) SELECT map, count(*) AS clusters, round(max(n) / sum(n), 6) AS largest, round((sum(wy * wy / w) - sum(wy) * sum(wy) / sum(w)) / (sum(wyy) - sum(wy) * sum(wy) / sum(w)), 6) AS eta2 FROM c GROUP BY 1")
def l19_partition_summary(table):
    """Clusters of each map, the share of the largest, and how much of the outcome they account for with sources of equal weight."""
    m = weighted(table).unpivot(["weight", "y"], ["status", "kind"], "map", "cluster")
    w, y = F.col("weight"), F.col("y")
    c = m.groupBy("map", "cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("w"), F.sum(w * y).alias("wy"), F.sum(w * y * y).alias("wyy"))
    mean = F.sum("wy") * F.sum("wy") / F.sum("w")
    return c.groupBy("map").agg(F.count(F.lit(1)).alias("clusters"), F.round(F.max("n") / F.sum("n"), 6).alias("largest"), F.round((F.sum(F.col("wy") * F.col("wy") / F.col("w")) - mean) / (F.sum("wyy") - mean), 6).alias("eta2"))


@query(f"WITH {WEIGHTED_SQL}, r AS (SELECT *, {FOLD_SQL} AS fold FROM w), c AS (SELECT fold, kind, count(*) AS n, sum(y) AS s FROM r GROUP BY 1, 2), t AS (SELECT kind, sum(n) AS n, sum(s) AS s FROM c GROUP BY 1), m AS (SELECT fold, kind, (t.s - c.s) / (t.n - c.n) AS guess FROM c JOIN t USING (kind) WHERE t.n > c.n) SELECT fold, count(*) AS n, round(corr(guess, y), 6) AS r FROM r JOIN m USING (fold, kind) GROUP BY 1")
def l20_source_transfer(table):
    """How cluster means of the other sources' videos go with the outcomes of the sources held out, by fold of the source."""
    r = weighted(table).withColumn("fold", fold())
    c = r.groupBy("fold", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s"))
    t = c.groupBy("kind").agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"))
    m = c.join(t, "kind").filter("tn > n").select("fold", "kind", ((F.col("ts") - F.col("s")) / (F.col("tn") - F.col("n"))).alias("guess"))
    return r.join(F.broadcast(m), ["fold", "kind"]).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.corr("guess", "y"), 6).alias("r"))


@query(f"WITH {WEIGHTED_SQL}, r AS (SELECT w.*, c_mktsegment AS account FROM w JOIN customer ON c_custkey = source), {rest_sql('account')} {errors_sql('account')}")
def n10_leave_account_out(table):
    """A line through quantity fitted without each account, tried on that account. One set of sums is all that is fitted from."""
    r = weighted(table).join(table("customer").select("c_custkey", F.col("c_mktsegment").alias("account")), F.col("c_custkey") == F.col("source"))
    return errors(r, without_own(moments(r, "account"), "account"), "account")


@query(f"WITH {WEIGHTED_SQL}, t AS (SELECT count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM w), m AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS slope, sxx - sx * sx / n AS dxx FROM t), e AS (SELECT y, (y - (sy - slope * sx) / n - slope * x) / (1 - 1.0 / n - power(x - sx / n, 2) / dxx) AS e, (y - sy / n) * n / (n - 1) AS b FROM w CROSS JOIN m) SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(1 - sum(e * e) / sum(b * b), 6) AS skill FROM e")
def n16_leave_one_out(table):
    """Errors of a line fitted without each row, by the row's leverage, so that it's fitted once."""
    w = weighted(table)
    n, sx, sy, sxx, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "sxy"))
    line = moments(w).withColumn("slope", (n * sxy - sx * sy) / (n * sxx - sx * sx)).withColumn("dxx", sxx - sx * sx / n)
    x, y, gap = F.col("x"), F.col("y"), F.col("x") - sx / n
    e = w.join(F.broadcast(line), F.lit(True)).select(((y - (sy - F.col("slope") * sx) / n - F.col("slope") * x) / (1 - 1.0 / n - gap * gap / F.col("dxx"))).alias("e"), ((y - sy / n) * n / (n - 1)).alias("b"))
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.sqrt(F.avg(F.col("e") * F.col("e"))), 6).alias("rmse"), F.round(1 - F.sum(F.col("e") * F.col("e")) / F.sum(F.col("b") * F.col("b")), 6).alias("skill"))


@query(f"WITH {WEIGHTED_SQL}, r AS (SELECT *, {FOLD_SQL} AS fold FROM w), {rest_sql('fold')} {errors_sql('fold')}")
def n22_natural_baseline(table):
    """The natural baseline: a line through the size of a video alone, on the sources of each fold held out."""
    r = weighted(table).withColumn("fold", fold())
    return errors(r, without_own(moments(r, "fold"), "fold"), "fold")


@query("WITH d AS (SELECT doc_id, len(" + WORDS_SQL + ") AS n FROM documents), p AS (SELECT doc_id, n, unnest(range(4))::INT AS part FROM d WHERE n >= 4) SELECT doc_id, part, round((part * n // 4) / 3.0 + 0.5, 6) AS start_s, round(((part + 1) * n // 4) / 3.0 + 0.5, 6) AS end_s FROM p")
def o9_response_windows(table):
    """Four components of even word counts, and the time in which each is answered: three words a second, half a second late."""
    d = table("documents").select("doc_id", F.size(words()).alias("n")).filter("n >= 4")
    p = d.select("doc_id", "n", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("part"))
    at = lambda c: F.round(F.floor(c * F.col("n") / 4) / 3.0 + 0.5, 6)
    return p.select("doc_id", "part", at(F.col("part")).alias("start_s"), at(F.col("part") + 1).alias("end_s"))


@query(f"WITH {LEXICON_SQL}, d AS (SELECT doc_id, {WORDS_SQL} AS own FROM documents), w AS (SELECT doc_id, unnest(own) AS word, unnest(range(len(own))) // 15 AS span FROM d) SELECT doc_id, family, count(DISTINCT span) AS spans, min(span)::BIGINT AS first_span FROM w JOIN lexicon USING (word) GROUP BY 1, 2")
def o13_tumbling_phrases(table):
    """Families of phrases in spans of five seconds (15 words), a family once for a span; the words are timed by their place."""
    w = table("documents").select("doc_id", F.posexplode(words()).alias("at", "word")).join(F.broadcast(lexicon(table)), "word")
    spans = w.select("doc_id", "family", F.floor(F.col("at") / 15).cast("long").alias("span")).distinct()
    return spans.groupBy("doc_id", "family").agg(F.count(F.lit(1)).alias("spans"), F.min("span").alias("first_span"))


@query(f"WITH {LONG_SQL}, d AS (SELECT metric, CASE WHEN value IS NULL THEN 'missing' WHEN value <= 0 THEN 'zero' WHEN target < 4 THEN 'low outcome' ELSE 'used' END AS reason, value FROM long) SELECT metric, reason, count(*) AS n, round(avg(value), 4) AS mean FROM d GROUP BY 1, 2")
def u4_metric_datasets(table):
    """The dataset of each metric by what becomes of its rows, the first reason against each."""
    why = F.when(F.col("value").isNull(), "missing").when(F.col("value") <= 0, "zero").when(F.col("target") < 4, "low outcome").otherwise("used")
    return metric_values(table).groupBy("metric", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query(f"WITH {VIDEOS_SQL}, r(metric, resolution) AS (VALUES " + ", ".join(f"('{m}', '{'video' if m in ('lines', 'quantity', 'price') else 'line'}')" for m in METRICS) + "), long AS (SELECT video_id, unnest(['lines', 'quantity', 'price', 'discount', 'tax', 'views']) AS metric FROM videos) SELECT metric, coalesce(resolution, 'unknown') AS resolution, count(*) AS n FROM long LEFT JOIN r USING (metric) GROUP BY 1, 2")
def u3_metric_resolution(table):
    """The resolution that the registry gives each stored metric; metrics that it lacks are unknown."""
    registry = table("region").sparkSession.createDataFrame([(m, "video" if m in ("lines", "quantity", "price") else "line") for m in METRICS], "metric string, resolution string")
    stored = videos(table).select("video_id", F.explode(F.array(*[F.lit(m) for m in [*METRICS, "views"]])).alias("metric"))
    return stored.groupBy("metric").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(registry), "metric", "left").select("metric", F.coalesce("resolution", F.lit("unknown")).alias("resolution"), "n")
