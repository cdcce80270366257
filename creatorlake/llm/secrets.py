"""Secret scan: patterns find candidates, and how the corpus owns their values tells live ones from copied examples.

A value that many owners or repositories hold is an example that people copy; one that a single owner holds, and that
looks drawn at random, is likely live. The counts are over all documents, by grouped aggregation of value hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from creatorlake.llm.common import each_text, looked_up, written

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
#: What else may be a key, if the corpus says so: a long run that mixes letters and digits.
OPEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
WORDS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "owned")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def entropy(value: str) -> float:
    """Bits per character."""
    return -sum((n := value.count(c) / len(value)) * log2(n) for c in set(value)) if value else 0.0


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, kind's place, kind, end, value) sorted by start, then kind; code points, end exclusive."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def open_spans(text: str) -> list[tuple[int, int, int, str]]:
    """Runs of 20 or more characters with digits and letters and at least 3 bits a character."""
    return [(m.start(), 3, m.end(), m[0]) for m in OPEN.finditer(text) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and entropy(m[0]) >= 3]


def apart(spans: list, base: list) -> list:
    """The spans that overlap none of base; both sorted by start, the end third in either."""
    out, i, reach = [], 0, 0
    for x in spans:
        while i < len(base) and base[i][0] < x[2]:
            reach = max(reach, base[i][2])
            i += 1
        if reach <= x[0]:
            out.append(x)
    return out


def secret_scan(df: DataFrame, owner: Column, repository: Column, text: str = "text", keep: tuple[str, ...] = ("doc_id",), shared_by: int = 3) -> DataFrame:
    """A row for each row of df: the columns in keep, base and spans (arrays of kind, start, end), n_live and n_shared.

    base: what the three patterns find. spans: those, and further key-like runs (kind owned) whose value lies with
    fewer than shared_by owners and as many repositories over the whole corpus. n_live counts the spans whose value
    does, n_shared the others. A null owner or repository counts as one of its own; a null or empty text has no span.
    """
    rows = df.select(*[df[c].alias(f"__k{i}") for i, c in enumerate(keep)], owner.cast("string").alias("__owner"), repository.cast("string").alias("__repo"), df[text].cast("string").alias("__text"))
    found = T.StructType(
        [T.StructField(f"__k{i}", df.schema[c].dataType) for i, c in enumerate(keep)]
        + [T.StructField(c, T.StringType()) for c in ("__owner", "__repo")]
        + [T.StructField("cands", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("end", T.LongType()), T.StructField("hash", T.LongType())])))]
    )
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("place", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())]))
        for b in batches:
            cands = []
            for t in each_text(b.column(n + 2)):
                base = base_spans(t) if t else []
                more = apart(open_spans(t), base) if t else []
                cands.append([{"start": s, "place": k, "end": e, "hash": xxh3_64_intdigest(v) - 2**63} for s, k, e, v in base + more])
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n + 2)] + [pa.array(cands, kind)], names=found.names)

    scanned = written(rows.mapInArrow(run, found).withColumn("__row", F.monotonically_increasing_id()), "secrets")
    each = scanned.filter(F.size("cands") > 0).select("__row", "__owner", "__repo", F.explode("cands").alias("c")).select("__row", "__owner", "__repo", "c.*")
    # one row for each owner and repository of a value first, so that a value held by a third of all rows is counted in pieces
    held = each.groupBy("hash", "__owner", "__repo").agg(F.count(F.lit(1)).alias("n"))
    spread = held.groupBy("hash").agg(F.countDistinct(F.coalesce("__owner", F.lit(""))).alias("owners"), F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("times"))
    # a value that very many rows hold is judged where those rows are
    judged = looked_up(each, written(spread, "spread"), "hash", "times", each.count()).withColumn("live", (F.col("owners") < shared_by) & (F.col("repositories") < shared_by))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    per_row = (
        judged.filter((F.col("place") < 3) | F.col("live"))
        .groupBy("__row")
        .agg(F.sort_array(F.collect_list(F.struct("start", "place", "end"))).alias("s"), F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_shared"))
    )
    spans = lambda c: F.transform(c, lambda x: F.struct(F.get(kinds, x["place"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return (
        scanned.join(per_row, "__row", "left")
        .withColumn("base", spans(F.filter("cands", lambda x: x["place"] < 3)))
        .withColumn("spans", F.coalesce(spans("s"), F.array().cast(T.ArrayType(SPAN))))
        .select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], "base", "spans", F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    )
