"""Prefix trie of conversations by fixed-length block hashing.

Conversations are cut into blocks of BLOCK turns, and a block's key is the digest of the block before it and of its own
turns: conversations with equal keys have equal turns up to the end of that block. They are grouped by these keys
first. Single turns are told apart only inside blocks where siblings diverge; where all that go on share the block, its
turns are nodes with the block's own members.

The smallest member of a node is that of the deeper nodes it is in as well, so the nodes of one smallest member are a
chain. Sums over a subtree come from its members: each brings the code points it shares with smaller ones (those above
its own chain) and whether its chain ends in a childless node. No step runs once for each depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.llm.common import looked_up, written

BLOCK, SEGMENT, CHUNK_BITS, KEY = 8, 256, 12, 16
ROOT = bytes(KEY)


def _key(kind: bytes, *parts: bytes) -> bytes:
    return hashlib.sha256(kind + b"".join(parts)).digest()[:KEY]


def numbered_turns(df: DataFrame, ident: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, digest, size): the turns of each conversation from 0, a digest of role and text, the text's code points.

    Null turns come first, equal ones by digest (repeated rows are turns of their own); a null role or text is empty; rows
    with a null ident take no part. Turns are numbered inside ranges of SEGMENT turn values, then ranges are put behind
    each other by their counts, so a conversation of very many turns is sorted by several tasks.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said), 256)), 1, KEY)
    rows = df.filter(F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("conv_id"), F.col(order).cast("long").alias("turn"), digest.alias("digest"), F.length(said).cast("long").alias("size")
    ).withColumn("part", F.coalesce(F.shiftright("turn", 8), F.lit(-(2**60))))
    inside = rows.withColumn("at", F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "digest")))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("k")).withColumn("start", F.coalesce(F.sum("k").over(before), F.lit(0))).drop("k")
    return inside.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("start") + F.col("at") - 1).alias("pos"), "digest", "size")


def with_shared_openings(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % every, then c's own after its first h; h = crc32(c) % most.

    Returns (turns, members); a member can be without turns.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("pos") < most - 1)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("head"))
    convs = turns.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % every).withColumn("h", h)
    opened = convs.join(heads.withColumnRenamed("conv_id", "base"), "base", "left").withColumn("opening", F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h"))))
    opened = written(opened.select("conv_id", "h", "opening", F.coalesce(F.size("opening"), F.lit(0)).alias("m")), "openings")
    given = opened.filter("m > 0").select("conv_id", F.explode("opening").alias("x")).select("conv_id", "x.pos", "x.digest", "x.size")
    own = turns.join(opened.select("conv_id", "h", "m"), "conv_id").filter("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("pos"), "digest", "size")
    return own.unionByName(given), opened.select("conv_id")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From full segments by conversation and number: key and code points where the next segment starts."""
    now, key, points = None, ROOT, 0
    for b in batches:
        out = []
        for conv, seg, digest, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if conv != now:
                now, key, points = conv, ROOT, 0
            key, points = _key(b"s", key, digest), points + size
            out.append((conv, seg + 1, key, points))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["conv_id", "seg", "key", "points"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of each segment: key before, own key, turns and code points before, digests and sizes of the turns."""
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
    for b in batches:
        out = []
        for conv, seg, digests, sizes, whole, start, points in zip(*(c.to_pylist() for c in b.columns), strict=True):
            key = start
            for i in range(0, len(digests), BLOCK):
                own, n = b"".join(digests[i : i + BLOCK]), sizes[i : i + BLOCK]
                # the last block of a segment has the key from which the next one starts
                after = _key(b"s", start, whole) if i + BLOCK == SEGMENT and whole is not None else _key(b"b", key, own)
                out.append((conv, key, after, seg * SEGMENT + i, points, own, n))
                key, points = after, points + sum(n)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["conv_id", "before", "after", "depth", "points", "digests", "sizes"])


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of each block as nodes: in a straight one named by the block, else by the turns up to there."""
    kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_())
    names = ["node", "parent", "depth", "size", "points", "conv_id", "n_convs", "block", "straight", "last"]
    for b in batches:
        out = []
        for after, before, depth, points, digests, sizes, conv, n, straight in zip(*(c.to_pylist() for c in b.columns), strict=True):
            parent = chain = before
            for j, size in enumerate(sizes):
                chain = _key(b"n", after, bytes([j])) if straight else _key(b"t", chain, digests[j * KEY : (j + 1) * KEY])
                node = after if j + 1 == BLOCK else chain
                points += size
                out.append((node, parent, depth + j + 1, size, points, conv, n, after, straight, j + 1 == len(sizes)))
                parent = node
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined chunks of each block, which come in order."""
    now, state, out = None, None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["block", "ends"])

    for b in batches:
        for block, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if block != now:
                if now is not None:
                    yield row()
                now, state = block, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if now is not None:
        yield row()


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(block, ends): from (block, conv_id) the digest of the ids in numeric order.

    Ids are joined by ranges of 2**CHUNK_BITS ids first, so where very many conversations end at one node its task reads
    short lists of text, one after the other; the digest itself can only be made in order.
    """
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids")
    chunks = written(ends.groupBy("block", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(ids), "ends")
    several = chunks.groupBy("block").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("block")
    one = chunks.join(several, "block", "left_anti").select("block", F.sha2(F.col("ids").cast("binary"), 256).alias("ends"))
    more = chunks.join(several, "block", "left_semi").repartition("block").sortWithinPartitions("block", "chunk").select("block", "ids")
    return one.unionByName(more.mapInArrow(_hashed, "block binary, ends string"))


def prefix_trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of conversations, the textless root included.

    turns: conv_id, pos (0, 1, ...), digest (KEY bytes), size; members: conv_id, each once, those without turns too. Returns
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; nothing for
    no members. Conversations of equal turns are members of the same nodes.
    """
    rows = turns.withColumn("seg", F.expr(f"pos div {SEGMENT}"))
    cut = rows.groupBy("conv_id", "seg").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "size"))).alias("x"))
    whole = F.unhex(F.sha2(F.array_join(F.transform("x", lambda t: F.hex(t["digest"])), "").cast("binary"), 256))
    cut = written(cut.select("conv_id", "seg", F.col("x.digest").alias("digests"), F.col("x.size").alias("sizes"), F.when(F.size("x") == SEGMENT, whole).alias("whole")), "segments")
    full = cut.filter("whole is not null").select("conv_id", "seg", "whole", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n).alias("size"))
    starts = full.repartition("conv_id").sortWithinPartitions("conv_id", "seg").mapInArrow(_chained, "conv_id long, seg long, start binary, points long")
    started = cut.join(starts, ["conv_id", "seg"], "left").select("conv_id", "seg", "digests", "sizes", "whole", F.coalesce("start", F.lit(ROOT)).alias("start"), F.coalesce("points", F.lit(0).cast("long")).alias("points"))
    blocks = written(started.mapInArrow(_blocks, "conv_id long, before binary, after binary, depth long, points long, digests binary, sizes array<long>"), "blocks")

    # blocks first, turns only where siblings diverge
    grouped = blocks.groupBy("after").agg(
        *(F.first(c).alias(c) for c in ("before", "depth", "points", "digests", "sizes")), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")
    )
    grouped = written(grouped, "groups")
    alone = grouped.groupBy("before").agg(F.count(F.lit(1)).alias("k"), F.first("after").alias("after")).filter("k = 1").select("after", F.lit(True).alias("straight"))
    marked = grouped.join(alone, "after", "left").select("after", "before", "depth", "points", "digests", "sizes", "conv_id", "n_convs", F.coalesce("straight", F.lit(False)).alias("straight"))
    steps = written(marked.mapInArrow(_steps, "node binary, parent binary, depth long, size long, points long, conv_id long, n_convs long, block binary, straight boolean, last boolean"), "steps")
    shape = ["node", "parent", "depth", "size", "points", "conv_id", "n_convs"]
    split = steps.filter("not straight").groupBy("node").agg(*(F.first(c).alias(c) for c in shape[1:5]), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"))
    nothing = F.lit(0).cast("long")
    root = members.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), nothing.alias("depth"), nothing.alias("size"), nothing.alias("points"), "conv_id", "n_convs"
    )
    bare = steps.filter("straight").select(*shape).unionByName(split).unionByName(root)
    children = steps.select("node", "parent").distinct().groupBy("parent").agg(F.count(F.lit(1)).alias("n_children")).withColumnRenamed("parent", "node")
    nodes = written(bare.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", nothing)), "trie")

    # one chain of nodes for each smallest member
    chains = nodes.groupBy("conv_id").agg(
        F.min(F.struct("depth", (F.col("points") - F.col("size")).alias("above"), "parent")).alias("top"), F.max(F.struct("depth", "n_children")).alias("tip")
    ).select("conv_id", F.col("top.depth").alias("top"), "top.above", F.col("top.parent").alias("node"), (F.col("tip.n_children") == 0).cast("long").alias("leaf"))
    chains = written(chains, "chains")
    tops = looked_up(chains.filter("node is not null").select("node", "conv_id"), nodes.filter("n_children > 0").select("node", F.col("conv_id").alias("parent_conv_id"), "n_children"), "node", "n_children", nodes.count())
    chains = chains.drop("node").join(tops.select("conv_id", "parent_conv_id"), "conv_id", "left")

    # what each member brings to the nodes that it is in
    total = F.col("points") + F.aggregate("sizes", nothing, lambda a, n: a + n)
    last = blocks.groupBy("conv_id").agg(F.max(F.struct("depth", "after", total.alias("total"))).alias("x")).select("conv_id", F.col("x.after").alias("block"), "x.total")
    value = members.join(last, "conv_id", "left").join(chains.select("conv_id", "above", "leaf"), "conv_id", "left")
    value = written(value.select("conv_id", F.coalesce("block", F.lit(ROOT)).alias("block"), F.coalesce("above", "total", nothing).alias("above"), F.coalesce("leaf", nothing).alias("leaf")), "values")
    brought = blocks.select("conv_id", "after").join(value.select("conv_id", "above", "leaf"), "conv_id").groupBy("after").agg(F.sum("above").alias("above"), F.sum("leaf").alias("leaf"))
    inside = steps.select("node", F.col("block").alias("after")).join(brought, "after").select("node", "above", "leaf").unionByName(value.select(F.lit(ROOT).alias("node"), "above", "leaf"))
    sums = inside.groupBy("node").agg(F.sum("above").alias("all_above"), F.sum("leaf").alias("n_leaves"))
    ends = ends_hashes(value.select("block", "conv_id"))
    at_root = ends.filter(F.col("block") == F.lit(ROOT)).select(F.lit(ROOT).alias("node"), "ends")
    ended = steps.filter("last").select("block", "node").join(ends, "block").select("node", "ends").unionByName(at_root)

    out = nodes.join(sums, "node").join(ended, "node", "left").join(chains.drop("leaf"), "conv_id")
    others = F.col("n_convs") - 1
    return out.select(
        "conv_id", "depth", F.when(F.col("depth") > F.col("top"), F.col("conv_id")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        (F.col("all_above") - F.col("above") - others * (F.col("points") - F.col("size"))).alias("saved_tokens"),
        F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )
