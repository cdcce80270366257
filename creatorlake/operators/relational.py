"""Gates, joins and record linkage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.operators.nearest_text import two_nearest


def upserted(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """base with the non-null fields of changes, and the rows that only changes has."""
    names = [c for c in base.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"__{c}") if c in changes.columns else F.lit(None).alias(f"__{c}") for c in names])
    return base.join(new, key, "full").select(key, *[F.coalesce(f"__{c}", c).alias(c) for c in names])


def pooled(parts: dict[str, DataFrame], tag: str = "origin") -> DataFrame:
    """One table of all parts, each row tagged with its part; columns that a part lacks are null."""
    out = None
    for name, df in parts.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def population(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """How many keys are on both sides, on the left only and on the right only."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full").agg(F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both_sides"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def history(rows: DataFrame, source: str, published: str, observed: str, ident: str, family: str | None, measures: dict[str, Column]) -> DataFrame:
    """For each row, aggregates over the earlier rows of its source: those observed by the time it was published, of other families.

    measures are aggregates over columns prefixed p_. A source's rows meet only rows of their own source.
    """
    prior = rows.select(F.col(source).alias("__s"), *[F.col(c).alias(f"p_{c}") for c in rows.columns])
    when = (F.col(source) == F.col("__s")) & (F.col(f"p_{observed}") <= F.col(published)) & (F.col(f"p_{ident}") != F.col(ident))
    if family:
        when = when & ~F.col(f"p_{family}").eqNullSafe(F.col(family))
    return rows.join(prior, when, "left").groupBy(ident).agg(*[c.alias(n) for n, c in measures.items()])


def _two_best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows by source and time: the largest value before each asking row among those of other families; two values are all that is held."""
    now, best = object(), []
    for b in batches:
        out = []
        for source, asks, family, value in zip(*(b[c].to_pylist() for c in ("s", "asks", "family", "value")), strict=True):
            if source != now:
                now, best = source, []
            if asks:
                out.append(next((v for v, f in best if f != family), None))
            else:
                out.append(None)
                if value is not None:
                    # the best of a family, and the best of another
                    top = sorted([*best, (value, family)], key=lambda x: -x[0])
                    best = [top[0], *[x for x in top[1:] if x[1] != top[0][1]][:1]]
        yield pa.RecordBatch.from_arrays([b["ident"], b["asks"], pa.array(out, pa.float64())], names=["ident", "asks", "prior_max"])


def prior_outcomes(rows: DataFrame, source: str, published: str, observed: str, ident: str, family: str, value: str) -> DataFrame:
    """(ident, prior_n, prior_mean, prior_max) over the rows of the same source, of other families, observed by the time the row was published.

    Rows come once as asking and once as observed, in time order: running counts and sums of the source less those of the
    family, and the largest value by a pass that holds two. No row meets another, so a source with very many rows costs its rows, not
    their square. A null family is a family of its own, a row isn't among its own priors; null values count for nothing, rows with a null ident, source or time take no part.
    """
    kind = rows.schema[ident].dataType.simpleString()
    f, v = F.col(family).cast("string"), F.col(value).cast("double")
    fine = rows.filter(F.col(ident).isNotNull() & F.col(source).isNotNull() & F.col(published).isNotNull())
    asking = fine.select(F.col(source).alias("s"), F.col(ident).alias("ident"), F.col(published).cast("timestamp").alias("t"), F.lit(True).alias("asks"), f.alias("family"), F.lit(None).cast("double").alias("value"))
    seen = fine.filter(F.col(observed).isNotNull()).select(F.col(source).alias("s"), F.col(ident).alias("ident"), F.col(observed).cast("timestamp").alias("t"), F.lit(False).alias("asks"), f.alias("family"), v.alias("value"))
    both = asking.unionByName(seen)
    # what is observed at a time is known to what is published then
    before = lambda *by: Window.partitionBy(*by).orderBy("t", "asks", "ident").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    less = lambda x: F.coalesce(x.over(before("s")), F.lit(0)) - F.coalesce(x.over(before("s", "family")), F.lit(0))
    sums = both.select("ident", "asks", less(F.count("value")).alias("prior_n"), less(F.sum("value")).alias("total")).filter("asks")
    largest = both.repartition("s").sortWithinPartitions("s", "t", "asks", "ident").mapInArrow(_two_best, f"ident {kind}, asks boolean, prior_max double").filter("asks")
    out = sums.join(largest.select("ident", "prior_max"), "ident")
    return out.select(F.col("ident").alias(ident), "prior_n", F.when(F.col("prior_n") > 0, F.col("total") / F.col("prior_n")).alias("prior_mean"), "prior_max")


def purged(train: DataFrame, test: DataFrame, family: str) -> DataFrame:
    """train without families that test has."""
    return train.join(test.select(family).distinct(), family, "left_anti")


def time_split(rows: DataFrame, source: str, ts: str, ident: str, share: float = 0.7) -> DataFrame:
    """part: train for the first `share` of each source's rows in time, test for the rest."""
    over = Window.partitionBy(source)
    place = F.row_number().over(over.orderBy(ts, ident))
    return rows.withColumn("part", F.when(place <= F.floor(F.count(F.lit(1)).over(over) * share), "train").otherwise("test"))


def interval_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, width: float) -> DataFrame:
    """Points inside [start, end): both sides are dealt to buckets of `width` first, so only points near a span meet it."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return p.join(s, [key, "__b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__b")


def edit_similarity(a: Column, b: Column) -> Column:
    return F.when(F.greatest(F.length(a), F.length(b)) == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def best_match(left: DataFrame, right: DataFrame, block: str, left_id: str, right_id: str, left_text: str, right_text: str) -> DataFrame:
    """Each left row's most similar right row of the same block, and by how much it beats the second.

    Right idents are whole numbers. Rows without a text are like no others: they match the smallest ident, without a similarity.
    """
    l = left.select(F.col(block).alias("block"), F.col(left_id).alias("__left"), F.col(left_text).alias("text"))
    r = right.select(F.col(block).alias("block"), F.col(right_text).alias("text"), F.col(right_id).alias("other"))
    found = l.join(two_nearest(l, r), ["block", "text"]).select("__left", "other", "similarity")
    smallest = r.groupBy("block").agg(F.min("other").cast("long").alias("other"))
    unlike = l.join(smallest, "block").select("__left", "other", F.lit(None).cast("double").alias("similarity"))
    over = Window.partitionBy("__left").orderBy(F.desc("similarity"), "other")
    ranked = found.union(unlike).withColumn("__n", F.row_number().over(over)).withColumn("__next", F.lead("similarity").over(over)).filter("__n = 1")
    return ranked.select(F.col("__left").alias(left_id), F.col("other").cast(right.schema[right_id].dataType).alias(right_id), "similarity", (F.col("similarity") - F.coalesce("__next", F.lit(0.0))).alias("margin"))
