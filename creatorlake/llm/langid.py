"""Language identification by Bayesian evidence fusion.

Four kinds of evidence about a text are added up as logarithms: the likelihood of its character n-grams under each
language's model, the language its markup declares, the suffix and path of its address, and the prior of its host.
The priors come from grouped aggregation over the whole table: a host with few texts leans on its domain, that on its
suffix, and that on the whole corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from creatorlake.llm.common import each_text, looked_up, sliced, written

BUCKETS = 1 << 18
OPEN = re.compile(r"(?i)<(script|style)\b")
CLOSE = {name: re.compile(rf"(?i)</{name}\s*>") for name in ("script", "style")}
MOST_OF_A_TEXT = 4
PIECE = 1_000_000  # characters of a very long text that are looked at together
#: Country suffixes and the language most written there.
SUFFIXES = {"at": "de", "li": "de", "uk": "en", "us": "en", "au": "en", "nz": "en", "ie": "en", "mx": "es", "ar": "es", "cl": "es", "pe": "es", "uy": "es", "mc": "fr", "br": "pt", "cz": "cs", "dk": "da", "gr": "el", "jp": "ja", "kr": "ko", "cn": "zh", "se": "sv", "ua": "uk"}
SEEN = 2_000  # n-grams after which further ones don't make the text's evidence weigh more


def without_markup(html: str) -> str:
    """html with a space for each script or style with all it holds, each comment and each tag, in one pass.

    A script, style or comment that isn't closed counts as a tag; what has been looked for in vain up to the end isn't looked for again.
    """
    out, at, pos, never = [], 0, 0, set()
    while (start := html.find("<", pos)) >= 0:
        end = -1
        if (m := OPEN.match(html, start)) and (name := m[1].lower()) not in never:
            close = CLOSE[name].search(html, m.end())
            end = close.end() if close else never.add(name) or -1
        if end < 0 and "-->" not in never and html.startswith("<!--", start):
            close = html.find("-->", start + 4)
            end = close + 3 if close >= 0 else never.add("-->") or -1
        if end < 0:
            end = html.find(">", start) + 1
            if not end:
                break
        out += [html[at:start], " "]
        at = pos = end
    return "".join([*out, html[at:]])


@dataclass
class Model:
    """Log-probabilities of hashed character n-grams: one row for each language, one column for each bucket."""

    languages: list[str]
    logs: np.ndarray
    usual: np.ndarray  # median of the mean log-probability of each language's own training texts
    spread: np.ndarray  # and its deviation over them, from the lowest tenth


def symbols(text: str) -> np.ndarray:
    """The lower-cased letters, with one mark for whatever stands between two of them or at the ends."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((cp >= 97) & (cp <= 122)) | (cp >= 170) & (cp != 215) & (cp != 247)
    cp = np.where(letter, cp, 32).astype(np.uint64)
    return cp[np.append(True, (cp[1:] != 32) | (cp[:-1] != 32))] if len(cp) else cp


def grams_by_piece(text: str) -> Iterator[np.ndarray]:
    """Buckets of the pairs, triples and quadruples of the symbols, a mark before and after all, each piece of the text after the other."""
    before = np.array([32], np.uint64)
    for i in range(0, len(text), PIECE):
        cp = symbols(text[i : i + PIECE])
        if len(cp) and cp[0] == 32 == before[-1]:
            cp = cp[1:]
        if i + PIECE >= len(text) and (cp if len(cp) else before)[-1] != 32:
            cp = np.append(cp, np.uint64(32))
        cp, old = np.concatenate([before, cp]), len(before)
        out, h = [], cp
        for n in (2, 3, 4):
            h = (h[:-1] * np.uint64(0x100000001B3)) ^ cp[n - 1 :]
            out.append((h[max(0, old - n + 1) :] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46))
        before = cp[-3:]
        yield np.concatenate(out).astype(np.int32)


def grams(text: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int32), *grams_by_piece(text)])


def fit(labelled: DataFrame, text: str, language: str, most_rows: int = 4_000, smoothing: float = 0.5) -> Model:
    """Train on at most most_rows distinct texts of each language, the ones with the smallest hashes.

    The bound keeps training cheap and the counts small; more rows hardly change the model. Copies count as one text.
    Languages are those of the labels that have a text with letters. Each task sends one count for each language and bucket. Without
    any the only language is und.
    """
    named = labelled.filter(F.col(language).isNotNull() & (F.length(text) > 0)).select(F.col(language).cast("string").alias("l"), F.col(text).cast("string").alias("t"), F.xxhash64(text).alias("h"))
    sizes = {r[0]: r[1] for r in named.select("l", "h").distinct().groupBy("l").count().collect()}
    if not sizes:  # nothing to learn from: one language of which nothing is known
        return Model(["und"], np.zeros((1, BUCKETS), np.float32), np.zeros(1), np.ones(1))
    names = sorted(sizes)
    # somewhat more than most_rows hashes by a limit, then the smallest of those by rank
    low = F.lit(False)
    for name in names:
        limit = -(2**63) + int(2**64 * min(1.0, (most_rows + 6 * most_rows**0.5) / sizes[name]))
        low = low | ((F.col("l") == name) & (F.col("h") <= F.lit(min(limit, 2**63 - 1)).cast("long")))
    ranked = named.filter(low).select("l", "h").distinct().withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h")))
    chosen = ranked.filter(F.col("n") <= most_rows).select("l", "h")
    sample = written(named.filter(low).join(chosen, ["l", "h"]).groupBy("l", "h").agg(F.first("t").alias("t")).select("l", "t"), "sample")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in set(b.column(0).to_pylist()):
                ids = [grams(t) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if k == name]
                n = np.zeros(BUCKETS, np.int64)
                for g in ids:  # a text counts MOST_OF_A_TEXT times for an n-gram at most, so that one odd text can't teach much
                    at, times = np.unique(g, return_counts=True)
                    n[at] += np.minimum(times, MOST_OF_A_TEXT)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["l", "g", "n"])

    counts = np.zeros((len(names), BUCKETS))
    found = sample.mapInArrow(run, "l string, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toArrow()
    at = pc.index_in(found.column("l"), value_set=pa.array(names, pa.string())).to_numpy()
    counts[at, found.column("g").to_numpy()] = found.column("n").to_numpy()
    taught = counts.sum(axis=1) > 0
    if not taught.any():
        return Model(["und"], np.zeros((1, BUCKETS), np.float32), np.zeros(1), np.ones(1))
    # a language without n-grams would be flat, above the others for what none of them knows
    names, counts = [n for n, x in zip(names, taught, strict=True) if x], counts[taught]
    sample = sample.filter(F.col("l").isin(names))
    logs = np.log(counts + smoothing) - np.log(counts.sum(axis=1, keepdims=True) + smoothing * BUCKETS)
    model = Model(names, logs.astype(np.float32), np.zeros(len(names)), np.ones(len(names)))
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [grams(t) for t in b.column(1).to_pylist()]
            score = [float(sent.value.logs[sent.value.languages.index(k), g].mean()) if len(g) else None for k, g in zip(b.column(0).to_pylist(), ids, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=["l", "s"])

    for r in sample.filter(F.length("t") >= 200).mapInArrow(own, "l string, s double").groupBy("l").agg(F.percentile("s", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect():
        model.usual[names.index(r.l)], model.spread[names.index(r.l)] = r.q[1], max((r.q[1] - r.q[0]) / 1.2816, 0.05)
    return model


def plain(html: str) -> str:
    """Text between tags, without scripts, styles and comments, entities resolved."""
    return unescape(without_markup(html))


def text_evidence(df: DataFrame, model: Model, text: Column, markup: bool, keep: dict[str, Column], text_in: str | None = None) -> DataFrame:
    """The columns in keep, likely (array<double>: log-likelihood for each language, of SEEN n-grams at most by mean), n_grams and fit.

    text_in: the column of keep that is the text, if one is, so that it isn't sent twice. fit tells how far the text's mean lies from what its best language is used to, in deviations.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(*[c.alias(k) for k, c in keep.items()], *([] if text_in else [text.cast("string").alias("__text")]))
    place = list(keep).index(text_in) if text_in else len(keep)
    schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("likely", T.ArrayType(T.DoubleType())), T.StructField("n_grams", T.LongType()), T.StructField("fit", T.DoubleType())])

    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        table = np.ascontiguousarray(m.logs.T)
        for b in sliced(batches):
            likely, sizes, fits = [], [], []
            for t in each_text(b.column(place)):
                t = plain(t) if markup and t else t or ""
                total, n = np.zeros(len(m.languages)), 0
                for g in grams_by_piece(t):
                    total += table[g].sum(axis=0, dtype=np.float64)
                    n += len(g)
                mean = total / max(1, n)
                best = int(mean.argmax())
                likely.append(mean * min(n, SEEN))
                sizes.append(n)
                fits.append(float((mean[best] - m.usual[best]) / m.spread[best]) if n else None)
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n_kept)] + [pa.array(likely, pa.list_(pa.float64())), pa.array(sizes, pa.int64()), pa.array(fits, pa.float64())], names=schema.names)

    return rows.mapInArrow(run, schema)


def declared_language(html: Column) -> Column:
    """The main language that the markup's lang attribute declares, or null."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})", 1))
    return F.when(found != "", found)


def host_of(url: Column) -> Column:
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return F.when(found != "", found)


def address_language(url: Column, languages: list[str], suffixes: dict[str, str] | None = None) -> Column:
    """The language that the first part of the path or the host's suffix (a language's own or that of a country in suffixes) names, or null."""
    suffix = F.regexp_extract(host_of(url), r"\.([a-z]{2,})$", 1)
    table = SUFFIXES if suffixes is None else suffixes
    suffix = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), suffix), suffix) if table else suffix
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", 1))
    return F.when(path.isin(languages), path).when(suffix.isin(languages), suffix)


def normalised(logs: Column) -> Column:
    """Probabilities from logarithms."""
    top = F.array_max(logs)
    raw = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda a, y: a + y))


def host_priors(evidence: DataFrame, languages: list[str], weight: float = 4.0) -> DataFrame:
    """(host, prior): smoothed shares of the languages over each host's texts, from grouped counts of what the texts look like.

    Each level adds `weight` texts dealt out like the level above it: host, registered domain (two labels), suffix, all.
    """
    looks = evidence.select("host", normalised(F.col("likely")).alias("p"), "n_grams").filter("n_grams > 0")
    parts = [F.sum(F.get("p", F.lit(i))).alias(f"c{i}") for i in range(len(languages))]
    names = [f"c{i}" for i in range(len(languages))]
    hosts = written(looks.groupBy("host").agg(*parts), "hosts")
    hosts = hosts.withColumn("domain", F.regexp_extract(F.coalesce("host", F.lit("")), r"([^.]*\.)?[^.]*$", 0)).withColumn("suffix", F.regexp_extract("domain", r"[^.]*$", 0))
    sums = lambda df, *by: df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in names])
    domains = sums(hosts, "domain", "suffix")
    suffixes = sums(domains, "suffix")
    total = sums(suffixes).withColumn("prior", F.array(*[(F.coalesce(F.col(c), F.lit(0.0)) + 1.0) for c in names]))
    share = lambda xs: F.transform(xs, lambda x: x / F.aggregate(xs, F.lit(0.0), lambda a, y: a + y))

    def below(level: DataFrame, above: DataFrame, on: list[str], keep: list[str]) -> DataFrame:
        both = level.crossJoin(F.broadcast(above.select(F.col("prior").alias("up")))) if not on else level.join(above.select(*on, F.col("prior").alias("up")), on)
        return both.select(*keep, share(F.array(*[F.col(c) + weight * F.get("up", F.lit(i)) for i, c in enumerate(names)])).alias("prior"))

    top = total.select(share(F.col("prior")).alias("prior"))
    at_suffix = below(suffixes, top, [], ["suffix"])
    at_domain = below(domains, at_suffix, ["suffix"], ["domain"])
    return below(hosts, at_domain, ["domain"], ["host"])


def fused(evidence: DataFrame, languages: list[str], trust: float = 0.9, least: float = 0.5, odd: float = 20.0, few: int = 12) -> DataFrame:
    """evidence with language, confidence and accepted.

    evidence: host, declared, address, likely, n_grams and fit; the others stay, but for those six and columns of the new names.
    trust: the chance that a declared language, or half that of an address, is right. A row is accepted if its best
    language (of equal ones the first in alphabetical order) has a posterior of `least` or more and its text has letters, and, with n >= `few` n-grams, isn't
    odd * (1 + 10 / sqrt(n)) deviations below what its language is used to: text in another script or language, or noise. Null and empty texts are not accepted; their language is that of
    the other evidence.
    """
    evidence = written(evidence.withColumn("host", F.coalesce("host", F.lit(""))), "evidence")
    priors = host_priors(evidence, languages)
    # a host with very many texts gets its prior where those texts are
    counts = evidence.groupBy("host").agg(F.count(F.lit(1)).alias("times"))
    joined = looked_up(evidence, written(counts.join(priors, "host", "left"), "priors"), "host", "times", evidence.count())
    other = (1 - trust) / max(1, len(languages) - 1)

    def said(c: str, i: int, right: float, wrong: float) -> Column:
        return F.when(F.col(c).isin(languages), F.when(F.col(c) == languages[i], F.log(F.lit(right))).otherwise(F.log(F.lit(wrong)))).otherwise(0.0)

    half = trust / 2 + 0.5 / len(languages)
    logs = F.array(*[
        F.get("likely", F.lit(i)) + F.log(F.coalesce(F.get("prior", F.lit(i)), F.lit(1.0 / len(languages)))) + said("declared", i, trust, other) + said("address", i, half, (1 - half) / max(1, len(languages) - 1))
        for i in range(len(languages))
    ])
    post = joined.withColumn("__post", normalised(logs)).withColumn("confidence", F.array_max("__post"))
    best = F.get(F.array(*[F.lit(x) for x in languages]), (F.array_position("__post", F.col("confidence")) - 1).cast("int"))
    accepted = (F.col("confidence") >= least) & (F.col("n_grams") > 0) & ((F.col("n_grams") < few) | (F.col("fit") >= -odd * (1 + 10 / F.sqrt("n_grams"))))
    return post.withColumn("language", best).withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("__post", "prior", "host", "declared", "address", "likely", "n_grams", "fit")


def identified(df: DataFrame, model: Model, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of df, of all columns, whose language is accepted; the host's prior comes from df itself."""
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.toDF(*names)
    place = {c.lower(): n for c, n in zip(df.columns, names, strict=True)}
    nothing = F.lit(None).cast("string")
    keep = {n: F.col(n) for n in names} | {"host": F.col(place[host.lower()]).cast("string"), "declared": nothing, "address": nothing}
    found = fused(text_evidence(rows, model, F.col(place[text.lower()]), False, keep, place[text.lower()]), model.languages)
    return found.filter("accepted").select(*[F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)])
