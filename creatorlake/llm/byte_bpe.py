"""Byte-level BPE: encoding and decoding of whole texts.

Pre-tokenisation uses no regular expression. Each code point becomes a symbol (letter, number, white space, ...); a
symbol is a function from states to states, and composing functions is associative. So a batch is cut into short
lanes, all lanes compose their functions side by side, a prefix scan over the lanes gives each its first state, and a
second pass marks where tokens start. The slices go through a cache of merged pieces.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from creatorlake.llm.common import chunks, free, sliced

LANE = 256
CACHED_PIECES, CACHED_LENGTH, SHORT = 75_000, 64, 100
NO_PAIR = np.int32(2**31 - 1)
SEPARATOR = "\ud800"  # stands between the texts of a batch; valid UTF-8 never holds it

# Symbols: letter, number, other, apostrophe before one letter or two letters of a contraction, space or other white
# space that is followed by a character that isn't white space, the same otherwise, end of a text.
L, N, O, C1, C2, SP_LAST, SP, WS_LAST, WS, END = range(10)
# States: anything starts a token; in letters; in numbers; in others; after white space; after a space that belongs to
# the next token; one or two characters of a contraction to come.
FRESH, IN_L, IN_N, IN_O, IN_WS, AFTER_SP, TAIL1, TAIL2 = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(next state, token starts here) by symbol and state."""
    nxt, start = np.zeros((10, 8), np.uint8), np.zeros((10, 8), bool)
    for symbol, inside in ((L, IN_L), (N, IN_N), (O, IN_O)):
        nxt[symbol] = inside
        start[symbol] = True
        start[symbol, [inside, AFTER_SP]] = False
    for symbol, tail in ((C1, TAIL1), (C2, TAIL2)):
        nxt[symbol], start[symbol] = tail, True
        nxt[symbol, [IN_O, AFTER_SP]], start[symbol, [IN_O, AFTER_SP]] = IN_O, False
    for symbol, after in ((SP_LAST, AFTER_SP), (WS_LAST, IN_WS), (SP, IN_WS), (WS, IN_WS)):
        nxt[symbol], start[symbol] = after, True
    start[[SP, WS], IN_WS] = False
    nxt[END], start[END] = FRESH, False
    nxt[:, TAIL1], start[:, TAIL1] = FRESH, False
    nxt[:, TAIL2], start[:, TAIL2] = TAIL1, False
    return nxt, start


NEXT, STARTS = _tables()


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Symbol of each code point, white space as WS."""
    out = np.full(sys.maxunicode + 1, O, np.uint8)
    for cp in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = L
        elif kind == "N":
            out[cp] = N
        elif kind == "Z":
            out[cp] = WS
    out[[9, 10, 11, 12, 13, 0x85]] = WS
    out[ord(SEPARATOR)] = END
    return out


def token_starts(text: str) -> np.ndarray:
    """Where tokens start in text, which may hold several texts, each followed by SEPARATOR; those positions count too."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.int64)
    sym = _classes()[cp]
    solid = np.append((sym[1:] != WS) & (sym[1:] != END), False)
    space = sym == WS
    sym[space & (cp == 32)] = SP
    sym[space & solid] = np.where(cp[space & solid] == 32, SP_LAST, WS_LAST)
    at = np.flatnonzero(cp == 39)
    if len(at):
        padded = np.append(cp, [0, 0])
        one, two = padded[at + 1], padded[at + 2]
        sym[at[np.isin(one, [ord(c) for c in "stmd"])]] = C1
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        sym[at[pair]] = C2
    n = len(sym)
    lanes = -(-n // LANE)
    grid = np.full(lanes * LANE, END, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T)
    # each lane as a function of states
    flat = NEXT.ravel()
    does = np.broadcast_to(np.arange(8, dtype=np.uint8), (lanes, 8)).copy()
    for row in grid:
        does = flat[(row.astype(np.uint16) * 8)[:, None] + does]
    # prefix scan: compose with the lane 1, 2, 4, ... to the left
    step = 1
    while step < lanes:
        does[step:] = np.take_along_axis(does[step:], does[:-step].copy(), axis=1)
        step *= 2
    state = np.concatenate([[FRESH], does[:-1, FRESH]]).astype(np.uint16)
    out = np.empty((LANE, lanes), bool)
    starts = STARTS.ravel()
    for j, row in enumerate(grid):
        key = row.astype(np.uint16) * 8 + state
        out[j] = starts[key]
        state = flat[key].astype(np.uint16)
    flags = out.T.ravel()[:n]
    return np.flatnonzero(flags | (sym == END))


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the adjacent pair of lowest rank, leftmost first, is joined until none is left."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:  # a plain search for the minimum beats the heap here
        get, none = ranks.get, len(ranks) + 2**32
        parts = [piece[i : i + 1] for i in range(n)]
        pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or end[j] != stop:
            continue
        alive[j], end[i], right[i] = False, stop, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(piece[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class _Pairs:
    """Rank of the token that two adjacent tokens join to, by their ids; for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], np.int64)
        self.single, self.size, self.whole = single, size, bool((single >= 0).all())
        found = [(a * size + b, r) for piece, r in ranks.items() for i in range(1, len(piece)) if (a := ranks.get(piece[:i])) is not None and (b := ranks.get(piece[i:])) is not None]
        table = np.array(found, np.int64).reshape(-1, 2)
        self.bits = max(4, int(4 * len(table)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1), np.full(1 << self.bits, NO_PAIR, np.int32)
        slot = self._slot(table[:, 0])
        while len(table):  # of those that want one free slot one gets it; the others try the next
            free_slot = self.keys[slot] == -1
            self.keys[slot[free_slot]] = table[free_slot, 0]
            placed = self.keys[slot] == table[:, 0]
            self.values[slot[placed]] = table[placed, 1]
            table, slot = table[~placed], (slot[~placed] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = a * self.size + b
        slot = self._slot(keys)
        out = np.full(len(keys), NO_PAIR, np.int32)
        open_at = np.arange(len(keys))
        while len(open_at):
            held = self.keys[slot]
            hit = held == keys
            out[open_at[hit]] = self.values[slot[hit]]
            more = ~hit & (held != -1)
            open_at, keys, slot = open_at[more], keys[more], (slot[more] + 1) & (len(self.keys) - 1)
        return out


def merged_together(pieces: list[bytes], pairs: _Pairs) -> list[bytes]:
    """What `merged` gives for each piece, as the bytes of int32 numbers: all pieces join their pair of lowest rank, leftmost first, side by side."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    out: list[bytes] = [b""] * len(pieces)
    order = np.argsort(size, kind="stable")
    for part in np.array_split(order, max(1, -(-int(size.sum()) // 65_536))):
        if not len(part):
            continue
        n, width = size[part], int(size[part].max())
        rows = np.arange(len(part))
        ids = np.zeros((len(part), width), np.int64)
        inside = np.arange(width) < n[:, None]
        ids[inside] = pairs.single[np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)]
        rank = np.full((len(part), width), NO_PAIR, np.int32)
        both = np.arange(1, width + 1) < n[:, None]
        r, c = np.nonzero(both)
        rank[r, c] = pairs(ids[r, c], ids[r, c + 1])
        length = n.copy()
        active = rows
        while len(active):
            at = rank[active].argmin(axis=1)
            low = rank[active, at]
            some = low != NO_PAIR
            active, at, low = active[some], at[some], low[some]
            if not len(active):
                break
            # the two become one: what follows moves up by one
            take = np.arange(width - 1) + (np.arange(width - 1) > at[:, None])
            ids[active, :-1] = np.take_along_axis(ids[active], take, axis=1)
            ids[active, at] = low
            # rank k stands for the pair (k, k + 1): that of the joined pair goes
            rank[active, :-1] = np.take_along_axis(rank[active], take + (take == at[:, None]), axis=1)
            rank[active, -1] = NO_PAIR
            length[active] -= 1
            right = at + 1 < length[active]
            rank[active, at] = NO_PAIR
            x, k = active[right], at[right]
            rank[x, k] = pairs(ids[x, k], ids[x, k + 1])
            left = at > 0
            x, k = active[left], at[left]
            rank[x, k - 1] = pairs(ids[x, k - 1], ids[x, k])
        flat = ids[np.arange(width) < length[:, None]].astype(np.int32).tobytes()
        ends = (4 * np.cumsum(length)).tolist()
        for i, s, e in zip(part.tolist(), [0, *ends[:-1]], ends, strict=True):
            out[i] = flat[s:e]
    return out


class _Pieces(dict):
    """piece -> its ids, as the bytes of int32 numbers. What a full cache held is kept beside the next one and taken over when asked for, so memory is bounded and common pieces stay."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.pairs, self.before = ranks, _Pairs(ranks), {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = np.array(merged(piece.encode(), self.ranks), np.int32).tobytes()
        if len(piece) <= CACHED_LENGTH:
            self[piece] = ids
        return ids

    def learn(self, pieces: list[str]) -> None:
        """Take in all short pieces at once; asked one by one, each costs more."""
        if len(self) >= CACHED_PIECES:
            self.before = dict(self)
            self.clear()
        before = self.before.get
        new = []
        for p in set(pieces).difference(self):
            ids = before(p)
            if ids is not None:
                self[p] = ids
            elif len(p) <= CACHED_LENGTH:
                new.append(p)
        if new and self.pairs.whole:
            coded = [p.encode() for p in new]
            known = list(map(self.ranks.get, coded))
            self.update((p, np.int32(r).tobytes()) for p, r in zip(new, known, strict=True) if r is not None)
            rest = [i for i, r in enumerate(known) if r is None]
            self.update(zip([new[i] for i in rest], merged_together([coded[i] for i in rest], self.pairs), strict=True))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Token bytes and ranks, sent to the tasks. The size is that of the file and does not depend on the data."""

    _pieces: dict[str, _Pieces] = {}

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.sent = path, spark.sparkContext.broadcast(load_ranks(path))

    def pieces(self) -> _Pieces:
        """The cache of this Python process; it lives on from task to task."""
        if self.path not in self._pieces:
            self._pieces.clear()
            self._pieces[self.path] = _Pieces(self.sent.value)
        return self._pieces[self.path]


def _joined(values: np.ndarray, ends: np.ndarray, tokens: dict[int, bytes]) -> pa.Array:
    """The bytes of the ids between each two of `ends`."""
    return pa.array([b"".join(map(tokens.__getitem__, values[s:e].tolist())) for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", offsets: str | None = "offsets", keep: tuple[str, ...] | None = None, decoded: str | None = None) -> DataFrame:
    """df (or its columns in keep) with each text's token ids, array<int>, and, unless offsets is None, each token's first byte in the UTF-8 text, array<long>.

    decoded: a name for what `decode` makes of the ids, made in the same pass.
    A null or empty text has empty arrays. Existing columns named like the new ones are replaced.
    """
    added = [T.StructField(ids, T.ArrayType(T.IntegerType()))]
    added += [T.StructField(name, kind) for name, kind in ((offsets, T.ArrayType(T.LongType())), (decoded, T.BinaryType())) if name]
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in [f.name.lower() for f in added]]
    schema = T.StructType([df.schema[c] for c in kept] + added)
    source = free(df, "__source")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.pieces()
        spelled = {i: k for k, i in known.ranks.items()} if decoded else {}
        lengths = np.zeros(max(known.ranks.values()) + 1, np.int64)
        lengths[list(known.ranks.values())] = [len(k) for k in known.ranks]
        for b in sliced(batches, 4096):
            for first, last in chunks(b.column(len(kept))):
                own = [t or "" for t in b.column(len(kept)).slice(first, last - first).to_pylist()]
                at = token_starts("".join(x for t in own for x in (t, SEPARATOR)))
                ends = np.cumsum([len(t) + 1 for t in own])
                cuts = np.searchsorted(at, ends - 1)
                pieces, counts, done = [], [], 0
                for t, end, cut in zip(own, ends.tolist(), cuts.tolist(), strict=True):
                    starts = (at[done:cut] - (end - 1 - len(t))).tolist()
                    pieces += [t[x:y] for x, y in pairwise([*starts, len(t)])]
                    counts.append(len(pieces))
                    done = cut + 1
                known.learn(pieces)
                coded = list(map(known.__getitem__, pieces))
                all_ids = np.frombuffer(b"".join(coded), np.int32)
                tokens = np.append(0, np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)) // 4))
                borders = np.append(0, tokens[counts]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(borders, all_ids)]
                if offsets:
                    place = np.append(0, np.cumsum(lengths[all_ids]))
                    lists.append(pa.ListArray.from_arrays(borders, place[:-1] - np.repeat(place[borders[:-1]], np.diff(borders))))
                if decoded:
                    lists.append(_joined(all_ids, borders, spelled))
                rows = b.slice(first, last - first)
                yield pa.RecordBatch.from_arrays([rows.column(i) for i in range(len(kept))] + lists, names=schema.names)

    return df.select(*[df[c] for c in kept], df[text].cast("string").alias(source)).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded", keep: tuple[str, ...] | None = None) -> DataFrame:
    """df (or its columns in keep) with the bytes that the ids stand for, binary; a null list gives no bytes, an id that isn't in the vocabulary is an error."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() != decoded.lower()]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(decoded, T.BinaryType())])
    source = free(df, "__source")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: k for k, i in vocabulary.sent.value.items()}
        for b in sliced(batches):
            lists = b.column(len(kept))
            values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [_joined(values, ends, tokens)], names=schema.names)

    return df.select(*[df[c] for c in kept], df[ids].alias(source)).mapInArrow(run, schema)


def span(decoded: bytes, offsets: list[int], first: int, last: int) -> bytes:
    """The bytes of tokens first to last - 1, found by their offsets."""
    ends = [*offsets, len(decoded)]
    return decoded[ends[first] : ends[last]]
