"""The two most similar texts by edit distance: blocks of texts meet trees of prefixes, branches that can't win are left out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Texts and characters of a chunk of a block, at most.
ASKED_TEXTS, TREE_TEXTS, CHUNK_CHARS = 1024, 65_536, 2**20
#: Chunks of a block are dealt to this many places on either side, places to this many tasks.
PLACES, TASKS = 4, 64
#: Branches that a first look follows for each text, and cells of distances that are held at once.
LOOK, CELLS = 8, 2**22


def _by_length(texts: list[str]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, code points) of texts of one length."""
    lengths = np.array([len(t) for t in texts])
    out = []
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        points = np.array([texts[i] for i in at], f"U{n}").view(np.uint32).reshape(len(at), n) if n else np.zeros((len(at), 0), np.uint32)
        out.append((int(n), at, points))
    return out


class _Tree:
    """Distinct texts of one length as a tree of their prefixes: a level holds the first row of each prefix."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, twice: np.ndarray):
        order = np.lexsort(points.T[::-1]) if points.shape[1] else np.arange(len(points))
        self.points, self.ids, self.twice = points[order], ids[order], twice[order]
        self.length = points.shape[1]
        new = np.zeros(len(points), bool)
        new[0] = True
        self.first, self.begin = [np.flatnonzero(new)], []
        for j in range(self.length):
            new = new.copy()
            new[1:] |= self.points[1:, j] != self.points[:-1, j]
            self.first.append(np.flatnonzero(new))
            self.begin.append(np.searchsorted(self.first[-1], np.append(self.first[-2], len(points))))
        self.least = [np.minimum.reduceat(self.ids, f) for f in self.first]


class _Asked:
    """Texts of one length with the two best rows of each so far: share of edits, ident, copy."""

    def __init__(self, at: np.ndarray, points: np.ndarray):
        self.at, self.points, self.length = at, np.ascontiguousarray(points.T), points.shape[1]
        self.share, self.ids = np.full((len(at), 2), np.inf), np.full((len(at), 2), np.iinfo(np.int64).max)
        self.copy = np.zeros((len(at), 2), np.int64)

    def may_win(self, q: np.ndarray, share: np.ndarray, least: np.ndarray) -> np.ndarray:
        return (share < self.share[q, 1]) | ((share == self.share[q, 0]) & (least < self.ids[q, 0]))

    def take(self, q: np.ndarray, share: np.ndarray, ids: np.ndarray, twice: np.ndarray) -> None:
        old = np.nonzero(self.share < np.inf)
        q, share, ids, copy = (np.concatenate(c) for c in ((old[0], q, q[twice]), (self.share[old], share, share[twice]), (self.ids[old], ids, ids[twice]), (self.copy[old], np.zeros(len(q), np.int64), np.ones(twice.sum(), np.int64))))
        order = np.lexsort((copy, ids, share, q))
        q, share, ids, copy = q[order], share[order], ids[order], copy[order]
        # a row that was seen before comes again
        new = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]) | (copy[1:] != copy[:-1]))[: len(q)]
        q, share, ids, copy = q[new], share[new], ids[new], copy[new]
        place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(self.at)))[q]
        kept = place < 2
        to = q[kept], place[kept]
        self.share[to], self.ids[to], self.copy[to] = share[kept], ids[kept], copy[kept]

    def search(self, tree: _Tree, look: int | None) -> None:
        """Every row of the tree that may be among the two best; with `look` so many branches of each text only, for a first bound."""
        n, end = self.length, tree.length
        longest = max(n, end, 1)
        kind = np.int16 if n + end < 30_000 else np.int32
        # what is left on both sides differs in length by so much at least
        q = np.arange(len(self.at))
        q = q[self.may_win(q, np.full(len(q), abs(n - end) / longest), np.full(len(q), tree.least[0][0]))]
        stack = [(0, q, np.zeros(len(q), np.int64), np.repeat(np.arange(n + 1, dtype=kind)[:, None], len(q), axis=1))]
        while stack:
            level, q, node, row = stack.pop()
            if not len(q):
                continue
            if level == end:
                at = tree.first[end][node]
                self.take(q, row[n] / longest, tree.ids[at], tree.twice[at])
                continue
            begin = tree.begin[level]
            count = begin[node + 1] - begin[node]
            total = int(count.sum())
            if len(q) > 1 and total * (n + 1) > CELLS:
                half = len(q) // 2
                stack += [(level, q[part], node[part], row[:, part]) for part in (slice(half, None), slice(half))]
                continue
            up = np.repeat(np.arange(len(q)), count)
            child = begin[node][up] + np.arange(total) - np.repeat(np.cumsum(count) - count, count)
            pieces = total * (n + 1) // CELLS + 1
            stack += [self.grown(tree, level, q[u], c, row[:, u], look) for u, c in zip(np.array_split(up, pieces), np.array_split(child, pieces), strict=True)]

    def grown(self, tree: _Tree, level: int, q: np.ndarray, child: np.ndarray, row: np.ndarray, look: int | None) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """The next level's branches that may win: by the edits so far and those that the rest needs at least."""
        n, left, one = self.length, tree.length - level - 1, row.dtype.type(1)
        sign = tree.points[tree.first[level + 1][child], level]
        now = np.empty_like(row)
        now[0] = level + 1
        least = now[0] + abs(n - left)
        for i in range(1, n + 1):
            now[i] = np.minimum(row[i - 1] + (self.points[i - 1][q] != sign), np.minimum(row[i], now[i - 1]) + one)
            least = np.minimum(least, now[i] + abs(n - i - left))
        share = least / max(n, tree.length, 1)
        kept = np.flatnonzero(self.may_win(q, share, tree.least[level + 1][child]))
        if look:
            kept = kept[np.lexsort((share[kept], q[kept]))]
            kept = kept[np.arange(len(kept)) - np.searchsorted(q[kept], q[kept]) < look]
        return level + 1, q[kept], child[kept], now[:, kept]


def _two_nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, trees = None, []
    for b in batches:
        for i in range(b.num_rows):
            if b["chunk"][i].as_py() != last:
                last, ids, twice = b["chunk"][i].as_py(), np.array(b["ids"][i].as_py()), np.array(b["twice"][i].as_py())
                trees = [_Tree(points, ids[at], twice[at]) for _, at, points in _by_length(b["texts"][i].as_py())]
            asked = b["asked"][i].as_py()
            for _, at, points in _by_length(asked):
                a = _Asked(at, points)
                for tree in sorted(trees, key=lambda t: abs(t.length - a.length)):
                    a.search(tree, LOOK)
                    a.search(tree, None)
                found = np.nonzero(a.share < np.inf)
                n = len(found[0])
                block = b["block"].slice(i, 1).take(pa.array(np.zeros(n, np.int64)))
                yield pa.RecordBatch.from_arrays([block, pa.array([asked[j] for j in at[found[0]]], pa.string()), pa.array(a.ids[found]), pa.array(1 - a.share[found])], names=["block", "text", "other", "similarity"])


def _chunks(rows: DataFrame, most: int) -> DataFrame:
    """(block, an array of each other column): texts of one block, in order, from ranges of blocks and texts."""
    names = rows.columns[1:]
    kinds = {c: t for c, t in rows.dtypes}

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, chars = None, [], 0

        def out() -> pa.RecordBatch:
            columns = [pa.array([held[0][0]], schema.field("block").type)]
            return pa.RecordBatch.from_arrays([*columns, *[pa.array([[r[i + 1] for r in held]], pa.list_(schema.field(c).type)) for i, c in enumerate(names)]], names=["block", *names])

        for b in batches:
            schema = b.schema
            for r in zip(*(b[c].to_pylist() for c in ("block", *names)), strict=True):
                if held and (held[0][0] != r[0] or len(held) >= most or chars >= CHUNK_CHARS):
                    yield out()
                    held, chars = [], 0
                held.append(r)
                chars += len(r[1])
        if held:
            yield out()

    ordered = rows.repartitionByRange("block", names[0]).sortWithinPartitions("block", names[0])
    return ordered.mapInArrow(packed, f"block {kinds['block']}, " + ", ".join(f"{c} array<{kinds[c]}>" for c in names))


def two_nearest(left: DataFrame, right: DataFrame) -> DataFrame:
    """(block, text, other, similarity): for each distinct text of left its two most similar rows of right in the same block, or more.

    left: block, text; right: block, text, other (a whole number). Similarity is one less the edits over the longer length; equal ones go
    to the smaller ident, a text that several rows have comes twice under its smallest. Null blocks and texts take no part. Chunks of a block meet chunks; each pair
    gives two rows for a text, so the two best of a block are among them.
    """
    l = left.filter("block is not null and text is not null").select("block", "text").distinct()
    r = right.filter("block is not null and text is not null").groupBy("block", "text").agg(F.min("other").cast("long").alias("ids"), (F.count(F.lit(1)) > 1).alias("twice"))
    number = F.monotonically_increasing_id()
    dealt, each = F.pmod(F.xxhash64("chunk"), F.lit(PLACES)), F.explode(F.sequence(F.lit(0), F.lit(PLACES - 1)).cast("array<long>"))
    asked = _chunks(l, ASKED_TEXTS).withColumnRenamed("text", "asked").withColumn("chunk", number).withColumn("a", dealt).drop("chunk").withColumn("t", each)
    trees = _chunks(r, TREE_TEXTS).withColumnRenamed("text", "texts").withColumn("chunk", number).withColumn("t", dealt).withColumn("a", each)
    key = ["block", "a", "t"]
    met = asked.repartition(TASKS, *key).join(trees.repartition(TASKS, *key), key).select("block", "asked", "texts", "ids", "twice", "chunk")
    return met.mapInArrow(_two_nearest, f"block {dict(l.dtypes)['block']}, text string, other long, similarity double")
