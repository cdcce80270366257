"""One of each group of near copies: an exact join of shingle sets by their prefixes, then connected components.

Each text is its set of distinct shingles. All shingles stand in one order, rare ones first. Two sets alike to `alike` or more
share one of the first n - ceil(alike * n) + 1 shingles of each, so none of those pairs is missed. Pairs with the leader of
a shingle come first, and after them only pairs that are not connected yet, so a large family of near copies costs
about one pair a text. A pair must pass up to four tests, each exact in that it never turns away a pair that is alike:
what can still follow the shared shingle; how many of ODD * 64 counters, odd or even for each set, differ, as each of those
takes a shingle that only one of the two has; what the sets cut to 16 bits a shingle share at most; and the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from creatorlake.llm.common import column_of, each_text, light, sliced, staying, written
from creatorlake.llm.components import components
from creatorlake.llm.shingles import shingle_hashes

BUCKETS = 1 << 20
SAMPLE = 16_000  # texts, about, that the order of the shingles is learned from; the order changes the cost, never the result
PAIRS = 1 << 20
ODD = 8  # longs of a set's parity bits
FEW = 1  # pairs of a set that are tried before all of them
FREQUENT, SALTS, GROUP = 64, 16, 50_000  # a shingle of one in FREQUENT texts is dealt to SALTS groups, or to more, so that one of FREQUENT has GROUP texts at most


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _frequencies(rows: DataFrame, words: int) -> tuple[np.ndarray, int]:
    """How often shingles of each bucket are in a sample of the texts, and from how many on a shingle is frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(BUCKETS, np.int32)
        for b in sliced(batches):
            for t in each_text(b.column(0)):
                np.add.at(n, _bucket(shingle_set(t, words)), 1)
        at = np.flatnonzero(n)
        for i in range(0, len(at), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 100_000]), pa.array(n[at[i : i + 100_000]].astype(np.int64))], names=["b", "n"])

    share = min(1.0, SAMPLE / max(1, rows.count()))
    some = rows.select("text") if share == 1 else rows.select("text").sample(share, seed=7)
    out = np.zeros(BUCKETS, np.uint16)
    found = some.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).filter("n > 3").toArrow()
    out[found.column("b").to_numpy()] = np.minimum(found.column("n").to_numpy(), 65_535)
    return out, max(64, SAMPLE // FREQUENT)


def _sketches(rows: DataFrame, frequencies: tuple[np.ndarray, int], words: int, alike: Fraction, salts: int) -> DataFrame:
    """(ident, t, sign, n, prefix, salt, cut, odd): digest, size, prefix, 16 bits of each shingle and parity bits of each text's set.

    Only the first text of a set in each task has prefix, salt, cut and odd, so copies are few before anything is moved.
    """
    sent = rows.sparkSession.sparkContext.broadcast(frequencies)
    kinds = {"sign": pa.binary(), "n": pa.int64(), "prefix": pa.list_(pa.int64()), "salt": pa.list_(pa.int32()), "cut": pa.binary(), "odd": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, frequent = sent.value
        seen: set[bytes] = set()
        for b in sliced(batches):
            out: dict[str, list] = {k: [] for k in kinds}
            for t in each_text(b.column(2)):
                own = shingle_set(t, words)
                sign = xxh3_128_digest(own.tobytes())
                prefix = salt = cut = odd = None
                if sign not in seen:
                    if len(seen) < 1_000_000:
                        seen.add(sign)
                    most = len(own) - -(-alike.numerator * len(own) // alike.denominator) + 1 if len(own) else 0
                    times = often[_bucket(own)]
                    first = np.argsort(times, kind="stable")[:most]
                    prefix, salt = own[first].view(np.int64), np.where(times[first] >= frequent, 1 + int.from_bytes(sign[:4], "big") % salts, 0).astype(np.int32)
                    cut = np.sort((own & np.uint64(0xFFFF)).astype(np.uint16)).tobytes()
                    odd = np.packbits(np.bincount((own >> np.uint64(16)).astype(np.int64) % (64 * ODD), minlength=64 * ODD).astype(np.uint8) & 1).view(np.int64)
                for k, v in zip(kinds, (sign, len(own), prefix, salt, cut, odd), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(out[k], kind) for k, kind in kinds.items())], names=["ident", "t", *kinds])

    ident = rows.schema["ident"].dataType.simpleString()
    return rows.select("ident", "t", "text").mapInArrow(run, f"ident {ident}, t long, sign binary, n long, prefix array<bigint>, salt array<int>, cut binary, odd array<bigint>")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[np.ndarray, list[int], list[int]]]:
    """(rows, starts, ends) of whole groups of rows equal in the first columns, as many as a batch has; the rows come sorted."""
    held: list[np.ndarray] = []

    def bounds(t: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        firsts = np.flatnonzero(np.append(True, (t[1:, :keys] != t[:-1, :keys]).any(axis=1)))
        return t, firsts.tolist(), [*firsts[1:].tolist(), len(t)]

    for b in batches:
        table = np.column_stack([c.to_numpy() for c in b.columns])
        if not len(table):
            continue
        if held and (held[-1][-1, :keys] != table[0, :keys]).any():
            yield bounds(np.concatenate(held))
            held = []
        differ = np.flatnonzero((table[:, :keys] != table[-1, :keys]).any(axis=1))
        last = int(differ[-1]) + 1 if len(differ) else 0
        if last:
            yield bounds(np.concatenate([*held, table[:last]]))
            held = []
        held.append(np.ascontiguousarray(table[last:]))
    if held:
        yield bounds(np.concatenate(held))


def _can_be_alike(x: np.ndarray, y: np.ndarray, n: np.ndarray, at: np.ndarray, alike: Fraction) -> np.ndarray:
    """Whether rows x and y can be alike if the shingle they share, at `at` in each, is their first in common."""
    follow = 1 + np.minimum(n[x] - at[x] - 1, n[y] - at[y] - 1)
    return follow * (alike.numerator + alike.denominator) >= alike.numerator * (n[x] + n[y])


def _led(posted: DataFrame, alike: Fraction) -> DataFrame:
    """The postings of shingles that several sets have, with the leader of each: the first set of a range of sizes that can be alike.

    lead is -1 where leader and set can't be alike by what follows the shingle.
    """
    up, down = alike.numerator, alike.denominator
    dealt = posted.select("h", F.col("salt").cast("long").alias("salt"), "n", "node", "at").repartition("h", "salt").sortWithinPartitions("h", "salt", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in _groups(batches, 2):
            n, node, at = t[:, 2], t[:, 3], t[:, 4]
            fresh = np.append(True, (t[1:, :4] != t[:-1, :4]).any(axis=1))  # a set comes once from each task
            lead = np.full(len(t), -1)
            for s, e in zip(starts, ends, strict=True):
                if node[s] == node[e - 1] and not t[s, 1]:  # one set; of a frequent shingle the other groups may have more
                    continue
                while s < e:
                    end = s + int(np.searchsorted(n[s:e], down * n[s] // up, side="right"))
                    lead[s:end] = s
                    s = end
            i = np.flatnonzero((lead >= 0) & fresh)
            leader = np.where(_can_be_alike(i, lead[i], n, at, alike), node[lead[i]], -1) if len(i) else i
            yield pa.RecordBatch.from_arrays([*(pa.array(t[i, k]) for k in range(5)), pa.array(leader.astype(np.int64)), pa.array(node[lead[i]] == node[i])], names=["h", "salt", "n", "node", "at", "lead", "leads"])

    return dealt.mapInArrow(run, "h long, salt long, n long, node long, at long, lead long, leads boolean")


def _rest(posted: DataFrame, scanned: DataFrame, alike: Fraction, most: int | None, salts: int) -> DataFrame:
    """(a, b), a < b: pairs of a shingle that can be alike and whose roots differ; of each set `most` in a group, or all.

    Groups of a frequent shingle meet two by two. Those of `most` have the smallest hashes, so the groups of a family choose the same ones.
    """
    up, down = alike.numerator, alike.denominator
    several = posted.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("h")
    bits = scanned.filter("odd is not null").select(F.xxhash64("sign").alias("node"), *[F.get("odd", F.lit(k)).alias(f"o{k}") for k in range(ODD)]).dropDuplicates(["node"])
    names = [f"o{k}" for k in range(ODD)]
    posted = posted.join(several, "h").join(bits, "node")
    other = F.explode(F.when(F.col("salt") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.lit(salts).cast("long"))))
    met = posted.select("h", other.alias("other"), "salt", "n", "node", "at", "root", *names).select("h", F.least("salt", "other").alias("lo"), F.greatest("salt", "other").alias("hi"), "n", "node", "at", "root", "salt", *names)
    dealt = met.repartition("h", "lo", "hi").sortWithinPartitions("h", "lo", "hi", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            k = (root[i] != root[j]) & (node[i] != node[j]) & ((salt[i] != salt[j]) | (lo[i] == hi[i])) & _can_be_alike(i, j, n, at, alike)
            i, j = i[k], j[k]
            differ = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
            k = differ * (up + down) <= (down - up) * (n[i] + n[j])
            i, j = i[k], j[k]
            if most is not None and len(i):
                order = np.lexsort((node[j] * np.int64(0x1E3779B97F4A7C15), i))
                i, j = i[order], j[order]
                firsts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                k = np.arange(len(i)) - np.repeat(firsts, np.diff(np.append(firsts, len(i)))) < most
                i, j = i[k], j[k]
            x, y = node[i], node[j]
            both = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)]), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

        for t, starts, ends in _groups(batches, 3):
            lo, hi, n, node, at, root, salt = t.T[1:8]
            odd = np.ascontiguousarray(t[:, 8:]).view(np.uint64)  # of signed numbers numpy would count the bits of the magnitude
            x, y, held = [], [], 0
            for s, e in zip(starts, ends, strict=True):
                stop = s + np.searchsorted(n[s:e], down * n[s:e] // up, side="right")
                for i, to in zip(range(s, e), stop.tolist(), strict=True):
                    if to > i + 1:
                        x.append(np.full(to - i - 1, i))
                        y.append(np.arange(i + 1, to))
                        held += to - i - 1
                        if held >= PAIRS:
                            yield made(np.concatenate(x), np.concatenate(y))
                            x, y, held = [], [], 0
            if x:
                yield made(np.concatenate(x), np.concatenate(y))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _alike(pairs: DataFrame, scanned: DataFrame, nodes: DataFrame, rows: DataFrame, words: int, alike: Fraction) -> DataFrame:
    """(a, b): the pairs, as signs, whose whole sets are alike to the limit. Two sets with one node number both take part."""
    up, down = alike.numerator, alike.denominator
    some = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    cuts = scanned.filter("cut is not null").select(F.xxhash64("sign").alias("node"), "sign", "cut").join(some, "node", "left_semi")
    cuts = written(cuts.groupBy("node", "sign").agg(F.first("cut").alias("cut")), "cuts")
    both = pairs.join(cuts.toDF("b", "sign_b", "cut_b"), "b").join(cuts.toDF("a", "sign_a", "cut_a"), "a").select("sign_a", "sign_b", "cut_a", "cut_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 256):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint16), np.frombuffer(y, np.uint16)
                shared = np.minimum(np.bincount(x, minlength=65_536), np.bincount(y, minlength=65_536)).sum()
                keep.append(bool(shared * (up + down) >= up * (len(x) + len(y))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    likely = written(both.mapInArrow(run, "a binary, b binary"), "likely")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            own = [shingle_set(t, words) for t in each_text(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([xxh3_128_digest(s.tobytes()) for s in own], pa.binary()), pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))], names=["sign", "own"])

    held = likely.select(F.explode(F.array("a", "b")).alias("sign")).distinct()
    first = nodes.join(held, "sign", "left_semi").select(F.col("first.ident").alias("i"), F.col("first.t").alias("u"))
    texts = rows.join(first, F.col("ident").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left_semi").select("text")
    sets = written(texts.mapInArrow(sets_of, "sign binary, own array<bigint>").groupBy("sign").agg(F.first("own").alias("own")), "sets")
    met = likely.join(sets.toDF("b", "y"), "b").join(sets.toDF("a", "x"), "a")
    common = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("all"))
    return written(common.filter(F.col("common") * F.lit(up + down).cast("long") >= F.col("all") * F.lit(up).cast("long")).select("a", "b"), "alike")


def one_of_each(df: DataFrame, text: str = "text", ident: str = "doc_id", words: int = 5, alike: str = "0.8") -> DataFrame:
    """The rows of df that stay when of each group of near copies only the one with the smallest ident does (of equal idents, any one row).

    Near copies have sets of distinct shingles of `words` words whose Jaccard likeness is `alike` or more; groups are what
    such pairs connect. Texts without words, null ones too, are copies of each other. A null ident is the largest. Rows
    are told apart by ident and text; of rows equal in both, one stays. df is read several times and must be the same each time.
    """
    with light(df.sparkSession):
        return _kept(df, text, ident, words, alike)


def _kept(df: DataFrame, text: str, ident: str, words: int, alike: str) -> DataFrame:
    limit = Fraction(alike)
    text, ident = column_of(df, text), column_of(df, ident)
    digest = F.xxhash64(F.col(text).cast("string"))
    rows = df.select(F.col(ident).alias("ident"), digest.alias("t"), F.col(text).cast("string").alias("text"))
    total = df.count()
    salts = max(SALTS, -(-total // (FREQUENT * GROUP)))
    scanned = written(_sketches(rows, _frequencies(rows, words), words, limit, salts), "sketches")
    # equal sets are one node, and stand for their first row
    first = F.min(F.struct(F.col("ident").isNull().alias("none"), "ident", "t")).alias("first")
    nodes = written(scanned.groupBy("sign").agg(first), "nodes")
    posted = scanned.filter("prefix is not null").select(F.posexplode(F.arrays_zip("prefix", "salt")).alias("at", "p"), "n", F.xxhash64("sign").alias("node"))
    posted = written(_led(posted.select(F.col("p.prefix").alias("h"), F.col("p.salt").alias("salt"), "n", "node", F.col("at").cast("long").alias("at")), limit), "posted")
    # of a frequent shingle the leaders of its groups meet
    leaders = _led(posted.filter("salt > 0 and leads").withColumn("salt", F.lit(0)), limit)
    led = posted.select("node", "lead").union(leaders.select("node", "lead")).filter("lead <> -1 and lead <> node")
    tried = written(led.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(), "pairs")
    found = _alike(tried, scanned, nodes, rows, words, limit)
    # a few pairs of each set join most of what is alike; then all pairs that are not joined yet
    for most in (FEW, None):
        joined = components(found).select(F.xxhash64("node").alias("node"), F.xxhash64("root").alias("root")).groupBy("node").agg(F.min("root").alias("root"))
        rooted = posted.join(written(joined, "joined"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        more = written(_rest(rooted, scanned, limit, most, salts).join(tried, ["a", "b"], "left_anti"), "pairs")
        found, tried = found.union(_alike(more, scanned, nodes, rows, words, limit)), tried.union(more)
    groups = written(components(found), "components")
    of_set = nodes.join(groups, nodes["sign"] == groups["node"], "left").groupBy(F.coalesce("root", "sign").alias("root")).agg(F.min("first").alias("first"))
    stay = of_set.select(F.col("first.ident").alias("i"), F.col("first.t").alias("u"), F.lit(True).alias("stays"))
    pairs = scanned.groupBy("ident", "t").agg(F.count(F.lit(1)).alias("times"))
    pairs = written(pairs.join(stay, F.col("ident").eqNullSafe(F.col("i")) & (F.col("t") == F.col("u")), "left").select("ident", "t", "times", "stays"), "decided")
    return staying(df, ident, digest, pairs)
