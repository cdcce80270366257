"""Work that goes round by round or block by block: components, neighbours, clusters, monotone fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from creatorlake.operators import clusters as K
from creatorlake.operators import components as C
from creatorlake.operators import isotonic as I
from creatorlake.operators import neighbours as N
from creatorlake.plans.curves import CURVES_SQL, curves
from creatorlake.plans.panel import VIDEOS_SQL, videos
from creatorlake.plans.registry import query

UNIT_SQL = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"


def nearest_sql(k: int, queries: str = "true") -> str:
    return f"""{UNIT_SQL}, s AS (SELECT a.vec_id AS id, b.vec_id AS other, round(list_inner_product(a.u, b.u), 9) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE {queries}),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM s) WHERE rank <= {k})"""


@query(f"WITH {nearest_sql(10, 'a.vec_id % 20 = 0')} SELECT id, other, round(score, 6) AS score, rank::INT AS rank FROM nn")
def f4_nearest_by_cosine(table):
    """The ten nearest of every row whose id is divisible by 20, against all rows."""
    return N.cosine_neighbours(table("embeddings"), 10, queries=F.pmod("vec_id", F.lit(20)) == 0).select("id", "other", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {nearest_sql(10)}, w AS (SELECT id, n_chars AS v, power(greatest(score, 0), 8) AS w FROM nn JOIN documents ON doc_id = other) SELECT id, round(sum(w * v) / sum(w), 4) AS mean, round(sum(w), 9) AS weight FROM w GROUP BY id HAVING sum(w) > 0")
def l2_neighbour_weighted_mean(table):
    """What the ten nearest rows' documents have in characters, weighted by cosine to the eighth."""
    values = table("documents").select(F.col("doc_id").alias("other"), F.col("n_chars").cast("double").alias("v"))
    out = N.cosine_weighted_mean(N.cosine_neighbours(table("embeddings"), 10), values, "v")
    return out.select("id", F.round("mean", 4).alias("mean"), F.round("weight", 9).alias("weight"))


@query(f"WITH {nearest_sql(1)} SELECT id, other, round(score, 6) AS support FROM nn")
def l33_leave_one_out_nearest(table):
    """How near the nearest other row is: the support that a row has in its domain."""
    return N.cosine_neighbours(table("embeddings"), 1).select("id", "other", F.round("score", 6).alias("support"))


MUTUAL, ALIKE = 20, 0.35
FAMILIES_SQL = f"""RECURSIVE {nearest_sql(MUTUAL)},
e AS (SELECT a.id AS a, a.other AS b FROM nn a JOIN nn b ON b.id = a.other AND b.other = a.id WHERE a.score >= {ALIKE}
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON trim(lower(a.text)) = trim(lower(b.text)) AND a.doc_id <> b.doc_id JOIN u x ON x.vec_id = a.doc_id JOIN u y ON y.vec_id = b.doc_id),
reach AS (SELECT vec_id AS node, vec_id AS seen FROM u UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen),
family AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""


def families(table):
    """Rows with equal texts, and rows that are among each other's nearest and alike, are one family."""
    e = table("embeddings")
    nearest = N.cosine_neighbours(e, MUTUAL)
    texts = table("documents").join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.sha2(F.trim(F.lower("text")), 256).alias("key"))
    edges = C.mutual_edges(nearest, ALIKE).union(C.exact_edges(texts, "doc_id", "key"))
    return C.connected_components(edges, e.select("vec_id"))


@query(f"WITH {FAMILIES_SQL} SELECT node, component, count(*) OVER (PARTITION BY component) AS size FROM family")
def g5_semantic_families(table):
    found = families(table)
    return found.join(found.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component").select("node", "component", "size")


@query(f"WITH {FAMILIES_SQL} SELECT vec_id, label FROM u JOIN family ON node = vec_id WHERE vec_id % 5 <> 0 AND component NOT IN (SELECT component FROM family WHERE node % 5 = 0)")
def c12_family_purge(table):
    """Training rows whose family has no row in the test split (every fifth id)."""
    e = table("embeddings").select("vec_id", "label")
    held = F.pmod("vec_id", F.lit(5)) == 0
    return C.purged(e.filter(~held), e.filter(held), families(table), "vec_id")


def kmeans_sql(k: int, rounds: int) -> str:
    """Rounds written out: r0, r1, ... are the centroids, z the rows with every cluster, nearest first; ties to the smaller cluster."""
    parts = [f"{UNIT_SQL}, r0 AS (SELECT row_number() OVER (ORDER BY sha256(vec_id::VARCHAR), vec_id) - 1 AS c, u AS m FROM u QUALIFY c < {k})"]
    for r in range(rounds + 1):
        name = "z" if r == rounds else f"a{r}"
        parts.append(f"{name} AS (SELECT vec_id, label, u, c, round(list_inner_product(u, m), 9) AS s, row_number() OVER (PARTITION BY vec_id ORDER BY round(list_inner_product(u, m), 9) DESC, c) AS n FROM u CROSS JOIN r{r})")
        if r < rounds:
            parts.append(f"d{r} AS (SELECT c, i, sum(u[i]) AS x FROM a{r}, (SELECT unnest(range(1, 65)) AS i) WHERE n = 1 GROUP BY c, i)")
            parts.append(f"m{r} AS (SELECT c, list(x / l ORDER BY i) AS m FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY c)) AS l FROM d{r}) GROUP BY c)")
            parts.append(f"r{r + 1} AS (SELECT r{r}.c, coalesce(m{r}.m, r{r}.m) AS m FROM r{r} LEFT JOIN m{r} ON m{r}.c = r{r}.c)")
    return ", ".join(parts)


@query(f"WITH {kmeans_sql(8, 3)} SELECT vec_id, c::INT AS cluster, round(s, 6) AS score FROM z WHERE n = 1")
def l12_spherical_kmeans(table):
    """Eight clusters after three rounds from fixed seeds."""
    found = K.spherical_kmeans(table("embeddings"), 8, 3).assigned
    return found.select(F.col("id").alias("vec_id"), "cluster", F.round("score", 6).alias("score"))


@query(
    " UNION ALL ".join(
        f"(WITH {kmeans_sql(k, 3)}, g AS (SELECT a.c, count(*) AS n, count(DISTINCT a.label) AS n_groups, avg(a.s) AS cohesion, avg(a.s - b.s) AS margin FROM z a JOIN z b ON a.vec_id = b.vec_id AND b.n = 2 WHERE a.n = 1 GROUP BY a.c) "
        f"SELECT {k} AS k, c::INT AS cluster, n, n_groups, round(cohesion, 6) AS cohesion, round(margin, 6) AS margin, n >= 30 AND n_groups >= 5 AND n <= 0.4 * (SELECT count(*) FROM u) AS kept FROM g)"
        for k in (3, 6, 9)
    )
)
def l31_candidate_clusters(table):
    """Clusters of three sizes of k with their size gates: 30 rows, five labels, 40 % of all rows at most."""
    e = table("embeddings")
    groups = e.select(F.col("vec_id").alias("id"), "label")
    out = None
    for k in (3, 6, 9):
        gates = K.gated_clusters(K.spherical_kmeans(e, k, 3).assigned, groups, "label", 30, 5, 0.4)
        one = gates.select(F.lit(k).alias("k"), "cluster", "n", "n_groups", F.round("cohesion", 6).alias("cohesion"), F.round("margin", 6).alias("margin"), "kept")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {CURVES_SQL}, p AS (SELECT user_id, i, v, sum(v) OVER (PARTITION BY user_id ORDER BY i) AS s FROM pts),
m AS (SELECT a.user_id, a.i AS a, b.i AS b, (b.s - a.s + a.v) / (b.i - a.i + 1) AS mean FROM p a JOIN p b ON a.user_id = b.user_id AND a.i <= b.i),
x AS (SELECT user_id, a, b AS i, max(mean) OVER (PARTITION BY user_id, a ORDER BY b DESC) AS up FROM m),
f AS (SELECT user_id, i, greatest(min(up), 0.0001) AS fit FROM x GROUP BY user_id, i),
g AS (SELECT user_id, i, v, fit / first_value(fit) OVER w AS survival, first_value(v) OVER w AS v0 FROM f JOIN pts USING (user_id, i) WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, i, round(survival, 6) AS survival, CASE WHEN v0 <> 0 THEN round(greatest(v / v0 - survival, 0), 6) END AS replay FROM g""")
def i8_survival_and_replay(table):
    """Each curve's falling fit over its first point, and the replays above it."""
    points = curves(table).select("user_id", F.posexplode("c").alias("i", "v"))
    out = I.survival_and_replay(points, "user_id", "i", "v")
    return out.select("user_id", "i", F.round("survival", 6).alias("survival"), F.round("replay", 6).alias("replay"))


@query(f"""WITH {VIDEOS_SQL}, d AS (SELECT quantity AS x, sum(log10(views + 1)) AS s, count(*) AS n FROM videos GROUP BY 1),
p AS (SELECT x, s, n, sum(s) OVER (ORDER BY x) AS ts, sum(n) OVER (ORDER BY x) AS tn FROM d),
m AS (SELECT a.x AS a, b.x AS b, (b.ts - a.ts + a.s) / (b.tn - a.tn + a.n) AS mean FROM p a JOIN p b ON a.x <= b.x),
y AS (SELECT a, b AS x, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m),
f AS (SELECT x, max(low) AS fit FROM y GROUP BY x)
SELECT min(x) AS low, max(x) AS high, round(any_value(fit), 6) AS level, sum(n)::BIGINT AS n FROM f JOIN d USING (x) GROUP BY round(fit, 9)""")
def n21_monotone_calibration(table):
    """The rising step function from quantity to log views."""
    v = videos(table).select(F.col("quantity").alias("x"), F.log10(F.col("views") + 1).alias("y"))
    return I.isotonic_levels(v, "x", "y").select("low", "high", F.round("level", 6).alias("level"), "n")


DISTANCES_SQL = """m AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
d AS (SELECT vec_id, e.label AS own_label, c.label, round(list_distance(embedding::DOUBLE[], c), 9) AS d FROM embeddings e, c)"""


@query(f"WITH {DISTANCES_SQL} SELECT vec_id, label AS nearest, round(d, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, label) = 1")
def l13_centroid_assignment(table):
    """Each vector's nearest label mean."""
    return K.centroid_distances(table("embeddings"), "label").select(F.col("id").alias("vec_id"), "nearest", F.round("distance", 6).alias("distance"))


@query(f"WITH {DISTANCES_SQL}, s AS (SELECT vec_id, own_label, min(d) FILTER (label = own_label) AS own, min(d) FILTER (label <> own_label) AS other FROM d GROUP BY 1, 2) SELECT own_label AS label, count(*) AS n, round(avg((other - own) / (greatest(other, own) + 1e-12)), 6) AS margin FROM s GROUP BY own_label")
def l26_centroid_margin(table):
    """How much nearer the own label's mean is than the nearest other one, as a share of the larger distance."""
    d = K.centroid_distances(table("embeddings"), "label")
    share = (F.col("other") - F.col("own")) / (F.greatest("other", "own") + 1e-12)
    return d.groupBy(F.col("own_group").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(share), 6).alias("margin"))
