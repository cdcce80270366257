"""Word-piece token counts by a longest-match automaton that never builds the pieces.

The vocabulary becomes a trie. Every node v holds a failure link (where matching goes on once the longest pieces
inside v's string are popped) and how many pieces that pops, so a word of n characters takes O(n) steps.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from creatorlake.llm.common import each_text

WORD = re.compile(r"\w+|[^\w\s]")
CACHED_WORDS, CACHED_LENGTH = 400_000, 48


class LongestMatch:
    """Counts the pieces that greedy longest-match-first splits a word into; None if some character has no piece.

    initial: pieces that may start a word; inner: pieces that may continue one.
    """

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        self.child: list[dict[str, int]] = [{}, {}]
        self.first, self.rest = 0, 1
        ends: set[int] = set()
        for root, pieces in ((self.first, initial), (self.rest, inner)):
            for piece in pieces:
                v = root
                for c in piece:
                    nxt = self.child[v].get(c)
                    if nxt is None:
                        nxt = self.child[v][c] = len(self.child)
                        self.child.append({})
                    v = nxt
                if piece:
                    ends.add(v)
        n = len(self.child)
        self.link, self.pops = [-1] * n, [0] * n
        queue = deque([self.first, self.rest])
        while queue:
            v = queue.popleft()
            for c, u in self.child[v].items():
                if u in ends:
                    self.link[u], self.pops[u] = self.rest, 1
                else:
                    z, popped = self.link[v], self.pops[v]
                    while z >= 0 and c not in self.child[z]:
                        popped += self.pops[z]
                        z = self.link[z]
                    if z >= 0:
                        self.link[u], self.pops[u] = self.child[z][c], popped
                queue.append(u)

    def count(self, word: str) -> int | None:
        child, link, pops = self.child, self.link, self.pops
        v, n = self.first, 0
        for c in word:
            nxt = child[v].get(c)
            while nxt is None:
                n += pops[v]
                v = link[v]
                if v < 0:
                    return None
                nxt = child[v].get(c)
            v = nxt
        while v > self.rest:
            n += pops[v]
            v = link[v]
        return n if v == self.rest else None


def split_vocabulary(pieces: Iterable[str], word_start: str = "▁") -> tuple[list[str], list[str]]:
    """(initial, inner): pieces marked with word_start may start a word, the others continue one."""
    initial, inner = [], []
    for p in pieces:
        (initial if p.startswith(word_start) else inner).append(p.removeprefix(word_start))
    return [p for p in initial if p], [p for p in inner if p]


@lru_cache(maxsize=2)
def _automaton(initial: tuple[str, ...], inner: tuple[str, ...]) -> LongestMatch:
    return LongestMatch(initial, inner)


class _Counts(dict):
    """word -> (pieces, unknown words); long words are counted anew each time, so the memory stays bounded."""

    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, int]:
        n = self.automaton.count(word)
        out = (1, 1) if n is None else (n, 0)
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = out
        return out


def token_counts(df: DataFrame, initial: Iterable[str], inner: Iterable[str], text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of df: the columns in keep, n_words, n_tokens and n_unknown (all long).

    Words are runs of word characters or single other characters that aren't white space. A word with a character
    that no piece covers counts as one unknown token, as word-piece tokenizers do. A null or empty text has 0 of each.
    The vocabulary is sent to the tasks; its size does not depend on the data.
    """
    pieces = df.sparkSession.sparkContext.broadcast((tuple(initial), tuple(inner)))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in ("n_words", "n_tokens", "n_unknown")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Counts(_automaton(*pieces.value))
        for b in batches:
            words_, tokens, unknown = [], [], []
            for t in each_text(b.column("__text")):
                words = WORD.findall(t or "")
                both = [known[w] for w in words]
                words_.append(len(words))
                tokens.append(sum(x for x, _ in both))
                unknown.append(sum(y for _, y in both))
            yield pa.RecordBatch.from_arrays([b.column(f"__k{i}") for i in range(len(keep))] + [pa.array(x, pa.int64()) for x in (words_, tokens, unknown)], names=schema.names)

    return df.select(*[df[c].alias(f"__k{i}") for i, c in enumerate(keep)], df[text].cast("string").alias("__text")).mapInArrow(run, schema)
