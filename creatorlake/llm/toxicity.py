"""Toxicity by a weighted finite-state pattern grammar.

Word transducers map a word to symbols (insult, threat, target, negation, reported speech); a clause transducer reads
the symbols of a clause and writes weighted matches: an insult weighs more beside a target, less under a negation or
inside reported speech. A text's score comes from its matched clauses, not from lone words. The insults' stems and all
weights are learned from labelled texts; short lists of common words give them a start.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creatorlake.llm.common import each_text, sliced, written

TOKEN = re.compile(r"[^\W\d_]+|[.?;:\n]")
INSULT, THREAT, TARGET, NEGATION, REPORT = "insult", "threat", "target", "negation", "report"
SEED = {
    INSULT: "idiot moron stupid loser scum trash worthless pathetic disgusting clown dumb imbécile crétin débile dummkopf abschaum idiota imbécil estúpido basura",
    THREAT: "kill hurt destroy shoot stab strangle murder tuer frapper töten umbringen schlagen matar golpear",
    TARGET: "you your yours yourself u he she they them him her people tu toi vous il elle ils eux du dich dir ihr sie er tú usted ustedes él ella ellos",
    NEGATION: "not no never neither nor without isn aren wasn don doesn didn pas jamais sans nicht kein keine nie ohne nunca sin ni",
    REPORT: "said says say called quoted wrote claimed reported told dit disait appelé écrit sagte sagt nannte schrieb dijo dice llamó escribió",
}
#: The clause transducer's outputs, with the weights it starts from.
MATCHES = {"insult": 1.5, "targeted": 2.0, "negated": 0.3, "reported": 0.5, "threat": 1.0, "threat_targeted": 2.5}
START, SPREAD = -4.0, 2.0
REACH = 3  # words over which a negation holds
STEMS = (4, 5, 6, 8, 64)
MIN_WORD = 3
RARER, PRICE = 5, 3.0  # a stem's share of the toxic texts is that many times its share of the clean ones; what a clean text takes off its worth


@dataclass
class Grammar:
    """stems: weight of each insult stem (a word matches by its longest stem); words: the other transducers; weights: intercept, then MATCHES."""

    stems: dict[str, float]
    words: dict[str, str]
    weights: list[float] = field(default_factory=lambda: [START, *MATCHES.values()])

    def symbol(self, word: str) -> tuple[str, float] | None:
        if word in self.words:
            return self.words[word], 1.0
        for n in sorted(set(STEMS), reverse=True):
            if len(word) >= n or n == STEMS[-1]:
                weight = self.stems.get(word if n == STEMS[-1] else word[:n])
                if weight is not None:
                    return INSULT, weight
        return None


def start_grammar() -> Grammar:
    return Grammar({w: 1.0 for w in SEED[INSULT].split()}, {w: kind for kind in (THREAT, TARGET, NEGATION, REPORT) for w in SEED[kind].split()})


class Machine:
    """The composed transducers, with a bounded cache of words."""

    def __init__(self, grammar: Grammar):
        self.grammar, self.known = grammar, {}

    def symbol(self, word: str) -> tuple[str, float] | None:
        if word not in self.known:
            if len(self.known) >= 300_000:
                self.known.clear()
            self.known[word] = self.grammar.symbol(word)
        return self.known[word]

    def clause(self, symbols: list[tuple[str, float] | None], out: dict[str, float]) -> None:
        """Run over one clause; states are: words left under a negation, inside reported speech, a target seen."""
        negated, reported, targeted, held = 0, False, any(s and s[0] == TARGET for s in symbols), []
        for s in symbols:
            kind = s[0] if s else None
            if kind == NEGATION:
                negated = REACH + 1
            elif kind == REPORT:
                reported = True
            elif kind in (INSULT, THREAT):
                held.append((kind, s[1], negated > 0, reported))
            negated -= negated > 0
        for kind, weight, no, told in held:
            if no:
                out["negated"] += weight
            elif told:
                out["reported"] += weight
            elif kind == THREAT:
                out["threat_targeted" if targeted else "threat"] += weight
            else:
                out["targeted" if targeted else "insult"] += weight

    def features(self, text: str | None) -> list[float]:
        """log(1 + summed weight) of each kind of match."""
        out = dict.fromkeys(MATCHES, 0.0)
        tokens = TOKEN.findall((text or "").lower())
        symbols = [self.symbol(t) for t in tokens]
        if any(s and s[0] in (INSULT, THREAT) for s in symbols):
            first = 0
            for i, t in enumerate([*tokens, "."]):
                if t in ".?;:\n":
                    if i > first:
                        self.clause(symbols[first:i], out)
                    first = i + 1
        return [log(1 + x) for x in out.values()]

    def score(self, text: str | None) -> float:
        z = self.grammar.weights[0] + float(np.dot(self.grammar.weights[1:], self.features(text)))
        return 1 / (1 + np.exp(-z))


def _stems_of(text: str) -> set[str]:
    words = {w for w in TOKEN.findall(text.lower()) if len(w) >= MIN_WORD}
    return words | {w[:n] for w in words for n in STEMS if len(w) > n}


def held_out(ident: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(ident.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sampled(docs: DataFrame, labels: DataFrame, ident: str, text: str, label: str, most: int) -> DataFrame:
    """(text, y) of at most about `most` labelled rows of each label, by hash of their ident; equal texts count once.

    The labels are thinned out first, so at most about 2 * most of them are sent to the documents and no text is
    moved but theirs. The sample is a written table.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull())
    keep = F.lit(False)
    for k, n in known.groupBy(label).count().collect():
        keep = keep | ((F.col(label) == k) & (F.pmod(F.xxhash64(ident, F.lit(7)), F.lit(10**6)) < int(10**6 * min(1.0, most / n))))
    chosen = known.filter(keep).groupBy(ident).agg(F.max(label).cast("int").alias("y"))
    rows = docs.select(ident, F.col(text).cast("string").alias("text")).filter("text is not null").join(F.broadcast(chosen), ident)
    return written(rows.select("text", "y").dropDuplicates(), "labelled")


def _cover(found: dict[str, np.ndarray], cost: dict[str, float], n: int, least: float, times: int, most: int) -> list[str]:
    """Stems that cover the n toxic texts up to `times` times, the one that adds most first; a stem that adds fewer than `least` texts is left out."""
    need, chosen = np.full(n, times), []
    rest = dict(found)
    while rest and len(chosen) < most:
        gain = {s: float((need[at] > 0).sum()) - cost[s] for s, at in rest.items()}
        best = max(gain, key=lambda s: (gain[s], len(s), s))
        if gain[best] < least:
            break
        chosen.append(best)
        need[rest.pop(best)] -= 1
        rest = {s: at for s, at in rest.items() if gain[s] >= least and not s.startswith(best) and not best.startswith(s)}
    return chosen


def learn(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = 4_000, most_stems: int = 400) -> Grammar:
    """A grammar from labelled documents: at most about most_rows rows of each label are used, so what the driver gets is bounded.

    Stems are word beginnings and whole words that toxic texts share and others hardly have; equal texts count once.
    Weights are those of a logistic regression held near the starting weights.
    """
    grammar = start_grammar()
    sample = sampled(docs, labels, ident, text, label, most_rows)
    texts = [r[0] for r in sample.filter("y = 1").select("text").collect()]
    if texts:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for b in batches:
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    counts[y].update(_stems_of(t))
            both = sorted(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.string())] + [pa.array([counts[y][s] for s in both], pa.int64()) for y in (0, 1)], names=["stem", "n0", "n1"])

        clean = sample.filter("y = 0").count()
        least = max(3.0, 0.02 * len(texts))
        counted = sample.mapInArrow(run, "stem string, n0 long, n1 long").groupBy("stem").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        rate = F.col("n0") / max(1, clean) * len(texts)  # clean texts with the stem, if there were as many as toxic ones
        good = counted.filter((F.col("n1") >= least) & (F.col("n1") >= RARER * rate)).orderBy(F.desc(F.col("n1") - rate), "stem").limit(5_000).collect()
        sets = [_stems_of(t) for t in texts]
        found = {r.stem: np.array([i for i, s in enumerate(sets) if r.stem in s]) for r in good}
        cost = {r.stem: PRICE * r.n0 / max(1, clean) * len(texts) for r in good}
        chosen = _cover(found, cost, len(texts), least, 3, most_stems)
        ratio = {r.stem: log((r.n1 + 0.5) / (len(texts) + 1)) - log((r.n0 + 0.5) / (clean + 1)) for r in good}
        grammar.stems |= {s: max(0.2, ratio[s] / 4) for s in chosen}
        sent = docs.sparkSession.sparkContext.broadcast(grammar)

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = Machine(sent.value)
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array([machine.features(t) for t in b.column(0).to_pylist()], pa.list_(pa.float64()))], names=["y", "x"])

        table = sample.mapInArrow(rows, "y int, x array<double>").toPandas()
        grammar.weights = _fitted(np.array(table["x"].tolist()), table["y"].to_numpy(float), np.array([START, *MATCHES.values()]))
    return grammar


def _fitted(x: np.ndarray, y: np.ndarray, prior: np.ndarray, steps: int = 50) -> list[float]:
    """Logistic regression by Newton's method; weights are normal around prior with deviation SPREAD."""
    x, w = np.column_stack([np.ones(len(x)), x]), prior.astype(float)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + (w - prior) / SPREAD**2
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) / SPREAD**2
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [float(w[0]), *np.maximum(w[1:], 0).tolist()]


def toxicity(df: DataFrame, grammar: Grammar, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of df: the columns in keep, score (0 to 1, higher: more toxic) and the weight of each kind of match.

    A null or empty text matches nothing and gets the grammar's base score. Rows aren't moved.
    """
    sent = df.sparkSession.sparkContext.broadcast(grammar)
    names = [f"m_{k}" for k in MATCHES]
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in ("score", *names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, w = Machine(sent.value), np.array(sent.value.weights)
        for b in sliced(batches):
            x = np.array([machine.features(t) for t in each_text(b.column(len(keep)))]).reshape(-1, len(MATCHES))
            score = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(keep))] + [pa.array(score), *(pa.array(c) for c in x.T.copy())], names=schema.names)

    return df.select(*[df[c].alias(f"__k{i}") for i, c in enumerate(keep)], df[text].cast("string").alias("__text")).mapInArrow(run, schema)
