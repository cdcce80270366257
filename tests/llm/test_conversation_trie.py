"""The conversation trie against a trie of Python dictionaries."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from creatorlake.llm.conversation_trie import numbered_turns, prefix_trie, with_shared_openings

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[conv].append(((turn is not None, turn or 0), digest, role, text))
    convs = {c: [(role, text) for _, _, role, text in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
    members, kids = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[x] for x in kids[path]) or 1
        saved[path] = (len(members[path]) - 1) * (len(path[-1][1]) if path else 0) + sum(saved[x] for x in kids[path])
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if len(rebuilt[c]) == len(p)).encode()).hexdigest())
        for p, m in members.items()
    )


def nodes(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("pos", F.lit("x")).withColumn("Digest", F.lit(1)).repartition(3)
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in prefix_trie(*with_shared_openings(numbered_turns(df))).collect())


def shaped(kind):
    rng = random.Random(kind)
    if kind == "random":  # shared beginnings, repeated rows, ties, nulls
        rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "é😀", "", None])) for c in range(95, 135) for t in range(rng.randint(1, 12))]
        return rows + rows[:20] + [(101, None, "user", "first"), (101, None, "user", "second"), (None, 0, "user", "x"), (-205, 0, None, None), (-200, 3, "user", "b")]
    if kind == "long":  # more turns than a segment, at its border, diverging late
        long = [(c, t, "user", f"turn {t}" if t < cut else f"own {c} {t}") for c, n, cut in ((7, 700, 700), (8, 700, 600), (9, 512, 512), (11, 256, 256), (12, 257, 256), (13, 264, 255)) for t in range(n)]
        return long + [(20, None, "user", f"untimed {i}") for i in range(300)]
    if kind == "copies":  # one conversation very often, with ids over several ranges
        return [(c, t, "user", "same" if t < 6 else f"end {c % 3}") for c in range(0, 40_000, 40) for t in range(9)]
    return [(c, 0, "user", "only") for c in (1, 2, 150)]  # turnless once rebuilt: no base, every turn replaced


@pytest.mark.parametrize("kind", ["random", "long", "copies", "turnless"])
def test_trie_equals_brute_force(spark, kind):
    rows = shaped(kind)
    assert nodes(spark, rows) == brute(rows)


def test_empty(spark):
    assert nodes(spark, []) == []
    assert nodes(spark, [(None, 0, "user", "x")]) == []


def test_turnless_member_is_in_the_root_only(spark):
    turns = spark.createDataFrame([(5, 0, bytes(range(16)), 3)], "conv_id long, pos long, digest binary, size long")
    got = prefix_trie(turns, spark.createDataFrame([(2,), (5,)], "conv_id long")).orderBy("depth").collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(2, 0, None, 2, 1, 1, 0), (5, 1, 2, 1, 0, 1, 0)]
    assert got[0].ends_sha256 == hashlib.sha256(b"2").hexdigest()
