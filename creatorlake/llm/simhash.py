"""SimHash near-duplicates with a Gray-order hierarchical index.

The index has masked bit patterns as its upper nodes: fingerprints that agree in the bits of a mask meet in one node.
Inside a node they are sorted by Gray rank, where neighbours differ in few bits, and consecutive ones form a tree whose
nodes hold the bits that all below share. Two groups whose shared bits already differ in more than the limit are left
out whole; bits counted further up are not counted again. What is emitted links each fingerprint to the first of
its component inside the node, so the links are fewer than the rows, however many pairs are close.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creatorlake.llm.common import column_of, each_text, light, looked_up, sliced, staying, written
from creatorlake.llm.components import components
from creatorlake.llm.near_copies import one_of_each  # noqa: F401
from creatorlake.llm.shingles import shingle_hashes

LEAF, FANOUT, PAIRS = 32, 8, 2048
MIXERS = (0x0, 0x9E3779B97F4A7C15, 0x3C6EF372FE94F82A, 0xDAA66D2C7DDF743F)


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Further hashes from the first, by a 64-bit finaliser."""
    if not k:
        return h
    h = h + np.uint64(MIXERS[k])
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(text: str | None, words: int = 4, width: int = 1) -> list[int]:
    """`width` times 64 bits, as unsigned numbers; a bit is 1 if it is in more than half of the shingles' hashes."""
    hashes = shingle_hashes(text, words)
    out = []
    for k in range(width):
        counts = np.zeros(64, np.int64)
        for i in range(0, len(hashes), 65_280):
            part = _mixed(hashes[i : i + 65_280], k)
            padded = np.zeros(-(-len(part) // 255) * 255, ">u8")
            padded[: len(part)] = part
            bits = np.unpackbits(padded.view(np.uint8)).reshape(-1, 255, 64)
            counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        out.append(int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big"))
    return out


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def fingerprints(df: DataFrame, text: str, words: int, width: int, keep: list[str]) -> DataFrame:
    """The columns in keep and g0, g1, ...: the Gray rank of each 64 bits of the fingerprint, as a signed long."""
    inside = text in keep and df.schema[text].dataType == T.StringType()
    place = keep.index(text) if inside else len(keep)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(f"g{k}", T.LongType()) for k in range(width)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            prints = [fingerprint(t, words, width) for t in each_text(b.column(place))]
            ranks = gray_rank(np.array(prints, np.uint64).reshape(-1, width)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(ranks[:, k]) for k in range(width)], names=schema.names)

    return df.select(*keep, *([] if inside else [df[text].cast("string").alias("__text")])).mapInArrow(run, schema)


def exact_masks(limit: int, bits: int = 64, blocks: int | None = None) -> list[int]:
    """Masks one of which finds any two fingerprints with at most `limit` differing bits equal: those touch `limit` of `blocks` blocks at most."""
    blocks = blocks or limit + 2
    edges = [bits * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (e - s)) - 1) << s for s, e in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - limit)]


class _Groups:
    """Components among the n rows of a batch, joined pair by pair."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            differ = a != b
            if not differ.any():
                return
            a, b = a[differ], b[differ]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(self.root, high, low)
            while not np.array_equal(up := self.root[self.root], self.root):
                self.root = up


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def _link_tree(prints: np.ndarray, offset: int, limit: int, groups: _Groups) -> None:
    """Join all rows with at most `limit` differing bits; prints are sorted by Gray rank."""
    n = len(prints)
    levels = []  # from the leaves up: bits that all rows below share, and their values
    firsts = np.arange(0, n, LEAF)
    ones, anyone = np.bitwise_and.reduceat(prints, firsts), np.bitwise_or.reduceat(prints, firsts)
    while True:
        levels.append((~(ones ^ anyone), ones))
        if len(ones) == 1:
            break
        firsts = np.arange(0, len(ones), FANOUT)
        ones, anyone = np.bitwise_and.reduceat(ones, firsts), np.bitwise_or.reduceat(anyone, firsts)
    # pairs of nodes, the differences counted so far and the bits in which they were counted
    a = b = np.zeros(1, np.int64)
    so_far, counted = np.zeros(1, np.int32), np.zeros((1, prints.shape[1]), np.uint64)
    stack = [(len(levels) - 1, a, b, so_far, counted)]
    while stack:
        level, a, b, so_far, counted = stack.pop()
        mask, value = levels[level]
        fresh = mask[a] & mask[b] & ~counted
        so_far = so_far + np.bitwise_count((value[a] ^ value[b]) & fresh).sum(axis=1, dtype=np.int32)
        near = so_far <= limit
        a, b, so_far, counted = a[near], b[near], so_far[near], (counted | fresh)[near]
        if not len(a):
            continue
        if level:
            kids = np.arange(FANOUT)
            x = np.repeat(a[:, None] * FANOUT + kids, FANOUT, axis=1).ravel()
            y = np.tile(b[:, None] * FANOUT + kids, (1, FANOUT)).ravel()
            times = FANOUT * FANOUT
            below = len(levels[level - 1][0])
            ok = np.flatnonzero((x < below) & (y < below) & (x <= y))
            for i in range(0, len(ok), PAIRS * 8):
                part = ok[i : i + PAIRS * 8]
                stack.append((level - 1, x[part], y[part], so_far[part // times], counted[part // times]))
        else:
            inside = np.arange(LEAF)
            for i in range(0, len(a), PAIRS):
                x, y = (np.minimum(v[i : i + PAIRS, None] * LEAF + inside, n - 1) for v in (a, b))
                close = _distance(prints[x][:, :, None], prints[y][:, None, :]) <= limit
                p, r, c = np.nonzero(close)
                groups.join(offset + x[p, r], offset + y[p, c])


def _linked(keys: np.ndarray, prints: np.ndarray, limit: int) -> np.ndarray:
    """For each row the first row of its component; rows are sorted by key, then Gray rank, and only equal keys meet."""
    n = len(keys)
    groups = _Groups(n)
    firsts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(firsts, n))
    small = np.repeat(sizes <= 2 * LEAF, sizes)
    for d in range(1, min(2 * LEAF, int(sizes.max(initial=1)))):
        i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
        if not len(i):
            break
        i = i[_distance(prints[i], prints[i + d]) <= limit]
        groups.join(i, i + d)
    for first, size in zip(firsts[sizes > 2 * LEAF], sizes[sizes > 2 * LEAF], strict=True):
        _link_tree(prints[first : first + size], int(first), limit, groups)
    return groups.root


def links(rows: DataFrame, masks: list[int], limit: int, width: int) -> DataFrame:
    """(a, b): links between nodes whose fingerprints differ in at most `limit` bits, as many as connect what is connected.

    rows: node (long) and g0, g1, ... Each row goes to one index node for each mask.
    """

    def word(k: int) -> Column:
        """The bits themselves, back from their Gray rank."""
        return F.col(f"g{k}").bitwiseXOR(F.shiftrightunsigned(f"g{k}", 1))

    signed = lambda x: x - 2**64 if x >= 2**63 else x
    keys = F.array(*[F.xxhash64(F.lit(i), *[word(k).bitwiseAND(F.lit(signed(m >> (64 * k) & (2**64 - 1))).cast("long")) for k in range(width) if m >> (64 * k) & (2**64 - 1)]) for i, m in enumerate(masks)])
    names = [f"g{k}" for k in range(width)]
    # unsigned order of Gray ranks
    order = [F.col(g).bitwiseXOR(F.lit(-(2**63)).cast("long")) for g in names]
    spread = rows.select(F.explode(keys).alias("key"), "node", *names).repartition("key").sortWithinPartitions("key", *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last key, which may go on
        def emitted(table: np.ndarray) -> pa.RecordBatch:
            ranks = table[:, 2:].view(np.uint64)
            root = _linked(table[:, 0], ranks ^ (ranks >> np.uint64(1)), limit)
            i = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(table[i, 1]), pa.array(table[root[i], 1])], names=["a", "b"])

        for b in batches:
            table = np.column_stack([c.to_numpy() for c in b.columns])
            if not len(table):
                continue
            if held and held[-1][-1, 0] != table[0, 0]:
                yield emitted(np.concatenate(held))
                held = []
            last = int(np.searchsorted(table[:, 0], table[-1, 0]))
            if last:
                yield emitted(np.concatenate([*held, table[:last]]))
                held = []
            held.append(np.ascontiguousarray(table[last:]))
        if held:
            yield emitted(np.concatenate(held))

    return spread.mapInArrow(run, "a long, b long")


def near_duplicates(
    df: DataFrame, text: str = "text", ident: str = "doc_id", words: int = 4, width: int = 1, limit: int = 4, masks: list[int] | None = None
) -> DataFrame:
    """A row for each row of df: ident, fingerprint (16 hexadecimal digits for each 64 bits) and component_id.

    Fingerprints with at most `limit` differing bits are linked; component_id is the smallest ident reachable over
    links (null if all of them are null). Masks: exact_masks by default, so no link is lost. Null and
    empty texts have a fingerprint of zeros and are linked like any other. Equal fingerprints count as one
    node, so any number of copies costs one row in the index.
    """
    scanned = written(fingerprints(df.select(ident, text), text, words, width, [ident]), "prints")
    return grouped(scanned, ident, limit, masks or exact_masks(limit, 64 * width), width)


def grouped(scanned: DataFrame, ident: str, limit: int, masks: list[int], width: int) -> DataFrame:
    """near_duplicates from a table of ident, g0, g1, ... and further columns, which are kept."""
    names = [f"g{k}" for k in range(width)]
    node = F.monotonically_increasing_id().alias("node")
    nodes = written(scanned.groupBy(*names).agg(F.min(ident).alias("first_id"), F.count(F.lit(1)).alias("times")).select("*", node), "nodes")
    found = components(links(nodes.select("node", *names), masks, limit, width))
    member = written(nodes.join(found, "node").select("root", *names, "first_id"), "members")
    smallest = written(member.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("times")), "smallest")
    in_group = looked_up(member, smallest, "root", "times", member.count()).select(*names, "component_id")
    of_node = nodes.join(in_group, names, "left").select(*names, "times", F.coalesce("component_id", "first_id").alias("component_id"))
    hexed = F.concat(*[F.lower(F.lpad(F.hex(F.col(g).bitwiseXOR(F.shiftrightunsigned(g, 1))), 16, "0")) for g in names])
    rest = [c for c in scanned.columns if c not in names]
    return looked_up(scanned, written(of_node, "groups"), names, "times", scanned.count()).select(*rest, hexed.alias("fingerprint"), "component_id")


def first_of_each(df: DataFrame, text: str = "text", ident: str = "doc_id", words: int = 4, width: int = 1, limit: int = 4, masks: list[int] | None = None) -> DataFrame:
    """The rows of df that stay when of each component of near_duplicates only the one with the smallest ident does (of equal idents, any one row).

    A null ident is the largest. Rows are told apart by ident and text; of rows equal in both, one stays. df is read several times and must be the same each time.
    """
    text, ident = column_of(df, text), column_of(df, ident)
    digest = F.xxhash64(F.col(text).cast("string"))
    key = F.struct(F.col(ident).isNull().alias("none"), F.col(ident).alias("ident"), digest.alias("t"))
    with light(df.sparkSession):
        found = near_duplicates(df.select(key.alias("key"), F.col(text).alias("text")), "text", "key", words, width, limit, masks)
        stays = F.bool_or(F.when(F.col("key").eqNullSafe(F.col("component_id")), True)).alias("stays")
        decided = written(found.groupBy("key.ident", "key.t").agg(F.count(F.lit(1)).alias("times"), stays), "decided")
        return staying(df, ident, digest, decided)
