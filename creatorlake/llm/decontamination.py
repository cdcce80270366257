"""Benchmark decontamination by latent semantic retrieval.

Passages of documents and benchmark items are TF-IDF vectors over the benchmark's terms. A distributed randomised SVD
gives a small latent space: each task adds its passages into a few random signed sums, the sums of all tasks are added
up, and the singular vectors of those few rows span it. Windows of a document near an item by cosine there are
candidates; the longest common subsequence of words and the item's answer decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creatorlake.llm.common import chunks, column_of, free, sliced

BLOCK = 16  # words; a window is two blocks
SKETCH_ROWS, DIMENSIONS, TERM_SLOTS = 128, 64, 1 << 15
BLOCK_BYTES = 16_000_000  # of benchmark text handled at once
EDGES = r"^[^\pL\pN]+|[^\pL\pN]+$"
HIT = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("cosine", T.DoubleType()), T.StructField("shared", T.DoubleType())])


@dataclass
class Items:
    """One block of the benchmark: its terms, and words and answer words of each item as numbers of terms.

    A term's slot in the latent space is its number modulo TERM_SLOTS. Terms that share a slot blur the cosine a little;
    the words themselves are compared by their numbers.
    """

    ids: list[int]
    words: list[list[int]]
    answers: list[set[int]]
    terms: pa.Array
    short: int  # items of fewer words are held only where these stand in a row

    @property
    def n_slots(self) -> int:
        return max(1, min(len(self.terms), TERM_SLOTS))


@dataclass
class Space:
    """The latent space: a row for each slot, inverse frequency included, and the items in it, of unit length."""

    terms: np.ndarray
    items: np.ndarray


def words_in(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(offsets, distinct words, their numbers): the words of text i are those with numbers [offsets[i], offsets[i + 1]).

    Words are what stands between white space, in lower case, without what is neither letter nor digit at its ends;
    they may be empty. Null texts have no words.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    found = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64), pc.replace_substring_regex(found.dictionary, EDGES, ""), found.indices.to_numpy(zero_copy_only=False)


def words_of(texts: list[str | None]) -> list[list[str]]:
    offsets, distinct, number = words_in(pa.array(texts, pa.string()))
    flat = [*map(distinct.to_pylist().__getitem__, number.tolist())]
    return [[w for w in flat[a:b] if w] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def terms_in(texts: pa.Array, terms: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, number of each word's term): -1 for words that are no terms, -2 for empty ones."""
    offsets, distinct, number = words_in(texts)
    term = pc.fill_null(pc.index_in(distinct, value_set=terms), -1).to_numpy(zero_copy_only=False).astype(np.int32)
    term[pc.equal(distinct, "").to_numpy(zero_copy_only=False)] = -2
    return offsets, term[number] if len(number) else np.zeros(0, np.int32)


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, with one machine-word-like integer for the whole item."""
    where: dict[int, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        if hit := where.get(w):
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(item) - row.bit_count()


def items_of(benchmark: DataFrame, item: str, text: str, answer: str | None, block: int, blocks: int, min_words: int) -> Items:
    """The items of one block; those without an id or without words are in no text."""
    rows = benchmark.filter(F.pmod(F.xxhash64(item), F.lit(blocks)) == block).select(item, text, *([answer] if answer else [])).collect()
    rows = [r for r in rows if r[0] is not None]
    words, answers = words_of([r[1] for r in rows]), words_of([r[2] if answer else None for r in rows])
    kept = [(int(r[0]), w, a) for r, w, a in zip(rows, words, answers, strict=True) if w]
    terms = sorted({w for _, ws, a in kept for w in (*ws, *a)})
    number = {w: i for i, w in enumerate(terms)}
    return Items([k[0] for k in kept], [[number[w] for w in k[1]] for k in kept], [{number[w] for w in k[2]} for k in kept], pa.array(terms, pa.string()), min_words)


def fitted(docs: DataFrame, text: str, items: Items) -> Space:
    """The latent space of all passages of docs and of the items, those weighted to count as much as the documents.

    Every task sends at most SKETCH_ROWS + 1 numbers for each slot, added up before the shuffle; the driver gets that many in all.
    A term's weight is its squared inverse frequency, which tells windows that share an item's rare words from those that
    share the frequent ones; no weight is zero, so an item that very many documents hold is found like any other.
    """
    sent, n = docs.sparkSession.sparkContext.broadcast(items.terms), items.n_slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen, passages = np.zeros(SKETCH_ROWS * n, np.float32), np.zeros(n, np.int64), 0
        for texts in (b.column(0).slice(i, j - i) for b in sliced(batches) for i, j in chunks(b.column(0))):
            offsets, term = terms_in(texts, sent.value)
            size = np.diff(offsets)
            count = -(-size // (2 * BLOCK))
            first = np.cumsum(count) - count
            passages += int(count.sum())
            at = np.flatnonzero(term >= 0)
            if not len(at):
                continue
            doc = np.repeat(np.arange(len(size)), size)[at]
            inside = (at - offsets[doc]) // (2 * BLOCK)
            pair, times = np.unique((first[doc] + inside) * n + term[at] % n, return_counts=True)
            owner, slot = pair // n, pair % n
            seen += np.bincount(slot, minlength=n)
            # a row and a sign for each passage, from what it holds and where it stands
            nth = np.zeros(int(count.sum()), np.uint64)
            nth[first[doc] + inside] = inside
            key = np.bincount(owner, weights=(slot * 2654435761 % 1000003) * times, minlength=len(nth)).astype(np.uint64) + nth * np.uint64(7919)
            key = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            row, sign = (key % np.uint64(SKETCH_ROWS)).astype(np.int64), np.where(key >> np.uint64(31) & np.uint64(1), 1.0, -1.0)
            np.add.at(sums, row[owner] * n + slot, (sign[owner] * (1 + np.log(times))).astype(np.float32))
        cell = np.flatnonzero(sums)
        slot = np.flatnonzero(seen)
        cells = np.concatenate([cell, SKETCH_ROWS * n + slot, [(SKETCH_ROWS + 1) * n]])
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(np.concatenate([sums[cell], seen[slot], [passages]]).astype(np.float64))], names=["cell", "value"])

    total = np.zeros((SKETCH_ROWS + 1) * n + 1)
    table = docs.select(F.col(text).cast("string")).mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    total[table.column("cell").to_numpy()] = table.column("value").to_numpy()
    sums, seen, passages = total[:-1].reshape(-1, n)[:SKETCH_ROWS], total[:-1].reshape(-1, n)[SKETCH_ROWS], max(1.0, total[-1])
    rare = np.log(1 + passages / (seen + 1)) ** 2
    own = np.zeros((len(items.ids), n))
    for i, words in enumerate(items.words):
        slot, times = np.unique(np.array(words) % n, return_counts=True)
        own[i, slot] = 1 + np.log(times)
    own *= rare
    sums = sums * rare
    weight = np.linalg.norm(sums) / max(np.linalg.norm(own), 1e-9)
    signs = np.random.default_rng(7).choice([-1.0, 1.0], (SKETCH_ROWS, len(items.ids)))
    stacked = np.vstack([sums, weight * signs @ own / SKETCH_ROWS**0.5])
    values, left = np.linalg.eigh(stacked @ stacked.T)
    best = np.argsort(-values)[: min(DIMENSIONS, len(values))]
    best = best[values[best] > 1e-9 * max(values.max(initial=0), 1e-9)]
    axes = stacked.T @ left[:, best] / np.sqrt(values[best]) if len(best) else np.zeros((n, 1))
    at = own @ axes
    size = np.linalg.norm(at, axis=1, keepdims=True)
    return Space((rare[:, None] * axes).astype(np.float32), (at / np.where(size > 0, size, 1)).astype(np.float32))


def _windows(term: np.ndarray, space: Space) -> np.ndarray:
    """Unit vectors of the windows, which start at every block but the last; term: the number of each word's term."""
    at = np.flatnonzero(term >= 0)
    slot, blocks = term[at] % len(space.terms), -(-len(term) // BLOCK)
    sums = np.zeros((blocks, space.terms.shape[1]), np.float32)
    if len(slot):
        owner = at // BLOCK
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sums[owner[first]] = np.add.reduceat(space.terms[slot], first, axis=0)
    if blocks > 1:
        sums = sums[:-1] + sums[1:]
    size = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(size > 0, size, 1)


class Search:
    """Finds the items of one block in texts.

    Before any window is made, words alone tell which items a text can hold: it needs one of so many of an item's
    rarest words that without all of those `likely` of it can't be there, and it needs `likely` of the item's words at all.
    """

    def __init__(self, items: Items, space: Space, near: float, sure: float, likely: float):
        self.items, self.space, self.near, self.sure = items, space, near, sure
        self.longest = max(map(len, items.words), default=0)
        self.likely = [1.0 if len(w) < items.short else likely for w in items.words]
        weight = np.linalg.norm(space.terms, axis=1)
        self.distinct, self.times, self.by_term = [], [], {}
        for k, words in enumerate(items.words):
            term, times = np.unique(words, return_counts=True)
            self.distinct.append(term)
            self.times.append(times)
            missing = 0
            for i in np.argsort(-weight[term % len(weight)], kind="stable").tolist():
                if missing > (1 - self.likely[k]) * len(words):
                    break
                self.by_term.setdefault(int(term[i]), []).append(k)
                missing += int(times[i])
        self.rare = np.zeros(len(items.terms) + 2, bool)
        self.rare[list(self.by_term)] = True
        self.present = np.zeros(len(items.terms) + 2, bool)

    def possible(self, term: np.ndarray) -> list[int]:
        """The items that a text with these terms can hold."""
        seen = np.unique(term[self.rare[term]]).tolist()
        if not seen:
            return []
        self.present[term] = True
        self.present[-2:] = False  # where no term is
        out = [k for k in sorted({k for t in seen for k in self.by_term[t]}) if self.times[k][self.present[self.distinct[k]]].sum() >= self.likely[k] * len(self.items.words[k])]
        self.present[term] = False
        return out

    def held(self, term: np.ndarray) -> list[tuple[int, float, float]]:
        """(item, cosine, share of its words found in order) of the items that a text with these terms holds."""
        some = self.possible(term)
        if not some:
            return []
        items, best = self.items, {}
        for k in [k for k in some if len(items.words[k]) < items.short]:
            words, plain = items.words[k], term[term != -2]
            row = np.ones(max(0, len(plain) - len(words) + 1), bool)
            for i, w in enumerate(words):
                row &= plain[i : i + len(row)] == w
            if row.any():
                best[k] = (1.0, 1.0)
        some = [k for k in some if len(items.words[k]) >= items.short]
        vectors = _windows(term, self.space) if some else np.zeros((0, 1), np.float32)
        for i in range(0, len(vectors), 4096):
            cosine = vectors[i : i + 4096] @ self.space.items[some].T
            for w, j in zip(*(x.tolist() for x in np.nonzero(cosine >= self.near)), strict=True):
                k = some[j]
                words = items.words[k]
                if best.get(k, (0, 0))[1] == 1:
                    continue
                start = (i + w) * BLOCK
                region = term[max(0, start - len(words)) : start + 2 * BLOCK + len(words)]
                self.present[region] = True
                self.present[-2:] = False
                enough = self.times[k][self.present[self.distinct[k]]].sum() >= self.likely[k] * len(words)
                self.present[region] = False
                if not enough:
                    continue
                own = region.tolist()
                share = common_subsequence(words, own) / len(words)
                answered = len(items.answers[k] & set(own)) * 2 >= len(items.answers[k])
                if share >= self.sure or share >= self.likely[k] and answered:
                    best[k] = max(best.get(k, (0.0, 0.0)), (float(cosine[w, j]), share), key=lambda x: x[::-1])
        return [(items.ids[k], c, s) for k, (c, s) in sorted(best.items())]


def contamination(
    df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", answer: str | None = None,
    hits: str = "benchmark_hits", near: float = 0.38, sure: float = 0.85, likely: float = 0.7, min_words: int = 5, keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """df (or its columns in keep) with the benchmark items that each text holds: item_id, cosine and the share of the item's words found in order.

    An item is held if a window of the text is within `near` of it and at least `sure` of its words come in order
    around there, or `likely` of them and half of its answer's words (where no answer is known, `likely` alone). An item of fewer than
    min_words words is held where they stand in a row. Null and empty texts and items hold nothing; items that share an id
    each give a hit. The benchmark is handled in blocks of about BLOCK_BYTES of text, so what is sent to the tasks is bounded. Rows aren't moved.
    """
    text, item, item_text = column_of(df, text), column_of(benchmark, item), column_of(benchmark, item_text)
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    blocks = ceil(size / BLOCK_BYTES) or 1
    out = df.select(*(df.columns if keep is None else keep)) if text in (df.columns if keep is None else keep) else df.select(*keep, text)
    out = out.drop(hits)
    source = free(out, "__found")[0]
    out = out.withColumn(source, F.array().cast(T.ArrayType(HIT)))
    for block in range(blocks):
        items = items_of(benchmark, item, item_text, answer, block, blocks, min_words)
        out = _scan(out, text, source, items, fitted(df, text, items), near, sure, likely)
    if keep is not None and text not in keep:
        out = out.drop(text)
    return out.withColumnRenamed(source, hits)


def _scan(df: DataFrame, text: str, found: str, items: Items, space: Space, near: float, sure: float, likely: float) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast((items, space))
    schema, place = df.schema, df.columns.index(text)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("cosine", pa.float64()), ("shared", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(*sent.value, near, sure, likely)
        for b in sliced(batches):
            new = []
            for i, j in chunks(b.column(place)):
                offsets, term = terms_in(b.column(place).slice(i, j - i).cast(pa.string()), search.items.terms)
                new += [search.held(term[x:y]) for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            found = [x + [dict(zip(("item_id", "cosine", "shared"), h, strict=True)) for h in y] for x, y in zip(b.column(len(schema) - 1).to_pylist(), new, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found, kind)], names=schema.names)

    return df.mapInArrow(run, schema)
