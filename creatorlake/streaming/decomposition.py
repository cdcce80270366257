"""Causal decomposition of a growing sequence of tokens into components, as a stream or over a table.

A key's tokens come with the probability of a boundary before them, under a frozen model. As soon as a window of `window`
tokens is full, it is cut at its most likely boundary behind the first `ahead` tokens, and what lies before the cut is
decoded: the partition of highest likelihood whose components have at most `longest` tokens and one word at least.
Nothing that comes later changes what has been sent out, and a key's state is never more than a window and tokens that
have come before their turn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEAST = 1e-6


def decoded(odds: list[float], word: list[bool], longest: int) -> list[tuple[int, int]]:
    """[start, end) of the components of a block: odds are probabilities of a boundary before each token, the first one's aside.

    The likeliest partition with a word in each component and at most `longest` tokens, a component's end as early as
    possible among equal ones; where no partition has both, lengths give way first. A block without words is one component.
    """
    n = len(odds)
    if not any(word):
        return [(0, n)] if n else []
    yes = [log(min(max(p, LEAST), 1 - LEAST)) for p in odds]
    no = [log(1 - min(max(p, LEAST), 1 - LEAST)) for p in odds]
    for most in (longest, n):
        best: list[float | None] = [0.0, *[None] * n]
        came = [0] * (n + 1)
        for end in range(1, n + 1):
            inside, words = 0.0, False
            for start in range(end - 1, max(-1, end - most - 1), -1):
                words |= word[start]
                if best[start] is not None and words:
                    score = best[start] + inside + (yes[start] if start else 0.0)
                    if best[end] is None or score >= best[end]:
                        best[end], came[end] = score, start
                inside += no[start]
        if best[n] is not None:
            break
    out, at = [], n
    while at:
        out.append((came[at], at))
        at = came[at]
    return out[::-1]


@dataclass
class Decomposer:
    """The state of one key: the window from `cursor` on, and tokens that came before their turn."""

    window: int
    ahead: int
    longest: int
    cursor: int = 0
    odds: list[float] = field(default_factory=list)
    words: list[bool] = field(default_factory=list)
    early: dict[int, tuple[float, bool]] = field(default_factory=dict)

    def push(self, pos: int, boundary: float, word: bool) -> Iterator[tuple[int, int, int]]:
        """(start, end, words) of the components that this token closes. A token that has come already counts for nothing."""
        if pos < self.cursor + len(self.odds) or pos in self.early:
            return
        self.early[pos] = (boundary, word)
        while (then := self.early.pop(self.cursor + len(self.odds), None)) is not None:
            self.odds.append(then[0])
            self.words.append(then[1])
            if len(self.odds) == self.window:
                yield from self._commit(self._cut())

    def finish(self) -> Iterator[tuple[int, int, int]]:
        """All that is left, places without a token left out."""
        for pos in sorted(self.early):
            if pos > self.cursor + len(self.odds):
                yield from self._commit(len(self.odds))
                self.cursor = pos
            self.odds.append(self.early[pos][0])
            self.words.append(self.early[pos][1])
            if len(self.odds) == self.window:
                yield from self._commit(self._cut())
        self.early.clear()
        yield from self._commit(len(self.odds))

    def _cut(self) -> int:
        """The place of the likeliest boundary behind `ahead` tokens with a word on both sides, the latest of equal ones; else the whole window."""
        fits = [i for i in range(max(1, self.ahead), len(self.odds)) if any(self.words[:i]) and any(self.words[i:])]
        return max(fits, key=lambda i: (self.odds[i], i), default=len(self.odds))

    def _commit(self, n: int) -> Iterator[tuple[int, int, int]]:
        for start, end in decoded(self.odds[:n], self.words[:n], self.longest):
            yield self.cursor + start, self.cursor + end, sum(self.words[start:end])
        self.cursor, self.odds, self.words = self.cursor + n, self.odds[n:], self.words[n:]


def decomposed(df: DataFrame, key: str, window: int, ahead: int, longest: int) -> DataFrame:
    """(key, first, last, n_words) of the components of each key's tokens.

    df: key, pos (0, 1, ...), boundary, word. A task reads its keys' tokens in order and holds a window of one key; rows
    with a null in any of the columns are left out, of repeated places the one with the smallest boundary counts.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, F.col("pos").cast("long").alias("pos"), F.col("boundary").cast("double").alias("boundary"), F.col("word").cast("boolean").alias("word")).dropna()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = (schema.types[0], pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[key, "first", "last", "n_words"])

        schema = None
        for b in batches:
            schema, out = b.schema, []
            for k, pos, boundary, word in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if state is None or k != now:
                    out += [(now, s, e - 1, w) for s, e, w in state.finish()] if state else []
                    now, state = k, Decomposer(window, ahead, longest)
                out += [(k, s, e - 1, w) for s, e, w in state.push(pos, boundary, word)]
            yield batch(out)
        if state:
            yield batch([(now, s, e - 1, w) for s, e, w in state.finish()])

    ordered = rows.repartition(key).sortWithinPartitions(key, "pos", "boundary")
    return ordered.mapInArrow(run, f"`{key}` {kind}, first long, last long, n_words long")


def decomposed_stream(stream: DataFrame, key: str, at: str, window: int, ahead: int, longest: int, late: str = "1 hour") -> DataFrame:
    """decomposed over a stream: components are sent out as soon as they are closed, the rest of a key once the watermark, `late`, has passed its last token.

    Tokens may come in any order within that time. A key that comes again afterwards starts anew at its next place.
    """

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple[int, int, int]] = []
        if state.exists:
            cursor, odds, words, places, early_odds, early_words = state.get
            now = Decomposer(window, ahead, longest, cursor, list(odds), list(words), dict(zip(places, zip(early_odds, early_words, strict=True), strict=True)))
        else:
            now = Decomposer(window, ahead, longest)
        if state.hasTimedOut:
            out += now.finish()
            state.remove()
        else:
            latest = 0
            for b in batches:
                for pos, boundary, word, ms in sorted(zip(b["pos"], b["boundary"], b["word"], b["ms"], strict=True)):
                    out += now.push(int(pos), float(boundary), bool(word))
                    latest = max(latest, int(ms))
            places = sorted(now.early)
            state.update((now.cursor, now.odds, now.words, places, [now.early[p][0] for p in places], [now.early[p][1] for p in places]))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "first": [o[0] for o in out], "last": [o[1] - 1 for o in out], "n_words": [o[2] for o in out]})

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withWatermark(at, late).select(key, at, F.unix_millis(F.col(at)).alias("ms"), F.col("pos").cast("long").alias("pos"), F.col("boundary").cast("double").alias("boundary"), F.col("word").cast("boolean").alias("word")).dropna()
    shape = "cursor long, odds array<double>, words array<boolean>, places array<long>, early_odds array<double>, early_words array<boolean>"
    return rows.groupBy(key).applyInPandasWithState(update, f"`{key}` {kind}, first long, last long, n_words long", shape, "append", GroupStateTimeout.EventTimeTimeout)
