"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. Rows are sorted by label, nearest reference and the angle to
it, and packed into cells, which keep the least and largest angle to each reference and the least and largest norm. By
the triangle inequality the angle between an anchor and a row of a cell lies between the difference and the sum of their
angles to any reference; the cosine interval times the norms bounds the scores. Only cells whose bounds overlap a score
window that an anchor asks for are scored, and in a cell only the rows whose own angle overlaps it.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creatorlake.llm.common import written
from creatorlake.llm.vectors import inner_products, int_matrix, quantised

CELL_ROWS, BLOCK_ROWS, PAGE_CELLS, REFERENCES, SAMPLE_ROWS = 1024, 2048, 512, 16, 4_096
#: An arc cosine of a value that is off by 1e-15 is off by less than 1e-7.
ANGLE_SLACK, LEAST, MOST = 1e-7, -(2**63), 2**63 - 1


def reference_directions(sample: np.ndarray, most: int = REFERENCES) -> np.ndarray:
    """Unit vectors of a sample, each the one farthest from those before; any directions give right bounds."""
    norms = np.linalg.norm(sample, axis=1)
    unit = sample[norms > 0] / norms[norms > 0, None]
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen, nearest = [0], unit @ unit[0]
    while len(chosen) < min(most, len(unit)) and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, unit @ unit[chosen[-1]])
    return unit[chosen]


def angles_to(points: np.ndarray, references: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(norms, angles to each reference); a zero vector has angle 0 to all."""
    points = points.astype(np.float64)
    norms = np.sqrt((points * points).sum(axis=1))
    return norms, np.where(norms[:, None] > 0, np.arccos(np.clip(points @ references.T / np.where(norms, norms, 1)[:, None], -1, 1)), 0.0)


def score_bounds(norm: np.ndarray, angle: np.ndarray, norms: tuple[np.ndarray, np.ndarray], angles: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(lowest, highest) score that a row of each cell can have with each anchor, rounded outwards."""
    shape = (len(norm), len(norms[0]))
    near, far = np.zeros(shape), np.full(shape, np.pi)
    for m in range(angle.shape[1]):
        a, low, high = angle[:, m, None], angles[0][None, :, m], angles[1][None, :, m]
        near = np.maximum(near, np.maximum(a - high, low - a))
        far = np.minimum(far, np.minimum(a + high, 2 * np.pi - a - low))
    least, most = np.cos(np.minimum(far + ANGLE_SLACK, np.pi)), np.cos(np.maximum(near - ANGLE_SLACK, 0))
    small, large = norm[:, None] * norms[0], norm[:, None] * norms[1]
    slack = 1e-9 * large + 1
    return np.where(least >= 0, small * least, large * least) - slack, np.where(most >= 0, large * most, small * most) + slack


def row_window(norm: np.ndarray, angle: np.ndarray, low: np.ndarray, high: np.ndarray, norms: tuple[float, float], sorted_angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[start, end) of the rows, sorted by their angle to one reference, that can score from low to high with each anchor."""
    small, large = norm * norms[0], norm * norms[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        # a score of at least `low` needs an angle of at most `widest`, one of at most `high` an angle of at least `least`
        widest = np.arccos(np.clip((low - 1) / np.where(low > 1, large, small), -1, 1))
        least = np.arccos(np.clip((high + 1) / np.where(high > -1, small, large), -1, 1))
    widest, least = np.where(np.isnan(widest), np.pi, widest) + ANGLE_SLACK, np.where(np.isnan(least), 0, least) - ANGLE_SLACK
    start = np.searchsorted(sorted_angles, np.maximum(angle - widest, least - angle), "left")
    end = np.searchsorted(sorted_angles, np.minimum(angle + widest, 2 * np.pi - least - angle), "right")
    return start, np.maximum(start, end)


def _bytes(x: np.ndarray, kind=np.float64) -> bytes:
    return np.ascontiguousarray(x, kind).tobytes()


def _read(x: bytes, kind=np.float64, width: int = 0) -> np.ndarray:
    out = np.frombuffer(x, kind)
    return out.reshape(-1, width) if width else out


CELL = "label_low string, label_high string, ids binary, labels array<string>, v binary, norms binary, own binary, reference int, low binary, high binary, norm_low double, norm_high double"
BLOCK = "uids binary, ids binary, labels array<string>, v binary, norms binary, angles binary, lows binary, highs binary"
FOUND = "uid long, ask int, score long, vec_id long"


def _packed(batches: Iterator[pa.RecordBatch], dim: int, width: int, cell_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by label, reference and angle as cells of cell_rows rows, fewer where label or reference change."""
    ids, labels, refs, points, norms, angles = [], [], [], [], [], []

    def cells() -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        at = [np.concatenate(x) for x in (ids, refs, points, norms, angles)]
        cut, start, n = [], 0, len(at[0])
        for i in range(1, n + 1):
            if i == n or i - start == cell_rows or (i - start >= cell_rows // 8 and (labels[i] != labels[i - 1] or at[1][i] != at[1][i - 1])):
                cut.append((start, i))
                start = i
        rows = []
        for s, e in cut:
            ref = int(at[1][s]) if (at[1][s:e] == at[1][s]).all() else -1
            # rows by angle inside the cell; where its rows have several nearest references, all are scored
            own = at[4][s:e, ref] if ref >= 0 else np.zeros(e - s)
            o = np.argsort(own, kind="stable")
            rows.append((
                min(labels[s:e]), max(labels[s:e]), _bytes(at[0][s:e][o], np.int64), [labels[s + i] for i in o], _bytes(at[2][s:e][o], np.int64), _bytes(at[3][s:e][o]), _bytes(own[o]), ref,
                _bytes(at[4][s:e].min(axis=0)), _bytes(at[4][s:e].max(axis=0)), float(at[3][s:e].min()), float(at[3][s:e].max()),
            ))
        kinds = (pa.string(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
        names = [x.split()[0] for x in CELL.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for b in batches:
        ids.append(b["vec_id"].to_numpy())
        labels += b["label"].to_pylist()
        refs.append(b["reference"].to_numpy())
        points.append(int_matrix(b["v"], dim))
        norms.append(b["norm"].to_numpy())
        angles.append(np.concatenate([_read(x)[None] for x in b["angles"].to_pylist()]).reshape(-1, width))
        if sum(map(len, ids)) >= 16 * cell_rows:
            yield from cells()
            for x in (ids, labels, refs, points, norms, angles):
                x.clear()
    yield from cells()


def _blocked(batches: Iterator[pa.RecordBatch], dim: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    """Anchors as blocks of at most block_rows."""
    kinds = (pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = [x.split()[0] for x in BLOCK.split(", ")]
    for whole in batches:
        for i in range(0, whole.num_rows, block_rows):
            b = whole.slice(i, block_rows)
            row = (
                _bytes(b["uid"].to_numpy(), np.int64), _bytes(b["vec_id"].to_numpy(), np.int64), b["label"].to_pylist(), _bytes(int_matrix(b["v"], dim), np.int64), _bytes(b["norm"].to_numpy()),
                b"".join(b["angles"].to_pylist()), _bytes(np.array(b["lows"].to_pylist(), np.int64), np.int64), _bytes(np.array(b["highs"].to_pylist(), np.int64), np.int64),
            )
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)


def _reached(batches: Iterator[pa.RecordBatch], asks: int, width: int, same: bool, only_first: bool) -> Iterator[pa.RecordBatch]:
    """(block, cell) of the pairs of an anchor block and a page of cell bounds where some anchor's window overlaps a cell's bounds."""
    for b in batches:
        blocks, cells = [], []
        for r in b.to_pylist():
            norm, angle = _read(r["norms"]), _read(r["angles"], width=width).reshape(-1, width)
            lows, highs = _read(r["lows"], np.int64, asks), _read(r["highs"], np.int64, asks)
            labels = np.array(r["labels"], object)
            bounds = r["bounds"]
            box = [np.concatenate([_read(x[k]) for x in bounds]).reshape(len(bounds), width) for k in ("low", "high")]
            norms = [np.array([x[k] for x in bounds]) for k in ("norm_low", "norm_high")]
            least, most = score_bounds(norm, angle, norms, box)
            first, last = (np.array([x[k] for x in bounds], object)[None, :] for k in ("label_low", "label_high"))
            fits = (labels[:, None] >= first) & (labels[:, None] <= last) if same else ~((labels[:, None] == first) & (first == last))
            overlap = np.zeros(fits.shape, bool)
            for a in range(asks):
                overlap |= (most >= lows[:, a, None]) & (least <= highs[:, a, None]) & (lows[:, a, None] <= highs[:, a, None])
            overlap &= fits
            if only_first:
                best = np.where(overlap, most, -np.inf).argmax(axis=1)
                overlap &= best[:, None] == np.arange(len(bounds))
            hit = np.flatnonzero(overlap.any(axis=0))
            blocks += [r["block"]] * len(hit)
            cells += [bounds[i]["cell"] for i in hit]
        yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(cells, pa.int64())], names=["block", "cell"])


def _firsts(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest of each row of scores, which is used up; columns come by id, so the first of equal ones has the smallest."""
    best, at = np.full((len(scores), k), LEAST), np.zeros((len(scores), k), np.int64)
    for n in range(min(k, scores.shape[1])):
        column = scores.argmax(axis=1)
        best[:, n], at[:, n] = scores[np.arange(len(scores)), column], ids[column]
        scores[np.arange(len(scores)), column] = LEAST
    return best, at


class _Block:
    """The anchors of one block and the best rows found for each of their windows so far."""

    def __init__(self, r: dict, asks: int, k: int, dim: int, width: int):
        self.uids, self.ids, self.labels = _read(r["uids"], np.int64), _read(r["ids"], np.int64), r["labels"]
        self.v, self.norm, self.angle = _read(r["v"], np.int64).reshape(-1, dim), _read(r["norms"]), _read(r["angles"]).reshape(-1, width)
        self.lows, self.highs, self.k = _read(r["lows"], np.int64, asks), _read(r["highs"], np.int64, asks), k
        asked = self.lows <= self.highs
        self.low, self.high = np.where(asked, self.lows, MOST).min(axis=1), np.where(asked, self.highs, LEAST).max(axis=1)
        self.best = np.full((len(self.uids), asks, k), LEAST)
        self.at = np.zeros_like(self.best)

    def score(self, c: dict, same: bool) -> None:
        ids, points, norms, own = _read(c["ids"], np.int64), _read(c["v"], np.int64).reshape(-1, self.v.shape[1]), _read(c["norms"]), _read(c["own"])
        names = {x: n for n, x in enumerate(dict.fromkeys(c["labels"]))}
        label, mine = np.array([names[x] for x in c["labels"]]), np.array([names.get(x, -1) for x in self.labels])
        fits = self.low <= self.high
        fits &= (mine >= 0) if same else (mine < 0) | (len(names) > 1)
        start, end = np.zeros(len(mine), np.int64), np.full(len(mine), len(ids))
        if c["reference"] >= 0:
            start, end = row_window(self.norm, self.angle[:, c["reference"]], self.low.astype(np.float64), self.high.astype(np.float64), (norms.min(), norms.max()), own)
        chosen = np.flatnonzero(fits & (start < end))
        if not len(chosen):
            return
        s, e = start[chosen].min(), end[chosen].max()
        order = s + np.argsort(ids[s:e], kind="stable")
        scores = inner_products(self.v[chosen], points[order])
        fine = ((mine[chosen, None] == label[order]) == same) & (self.ids[chosen, None] != ids[order])
        for a in range(self.lows.shape[1]):
            inside = fine & (scores >= self.lows[chosen, a, None]) & (scores <= self.highs[chosen, a, None])
            some = inside.any(axis=1)
            if some.any():
                best, at = _firsts(np.where(inside[some], scores[some], LEAST), ids[order], self.k)
                rows = chosen[some]
                best, at = np.concatenate([self.best[rows, a], best], axis=1), np.concatenate([self.at[rows, a], at], axis=1)
                first = np.lexsort((at, ~best), axis=-1)[:, : self.k]
                self.best[rows, a], self.at[rows, a] = np.take_along_axis(best, first, 1), np.take_along_axis(at, first, 1)

    def found(self) -> pa.RecordBatch:
        row, ask, n = np.nonzero(self.best > LEAST)
        return pa.RecordBatch.from_arrays([pa.array(self.uids[row]), pa.array(ask.astype(np.int32)), pa.array(self.best[row, ask, n]), pa.array(self.at[row, ask, n])], names=["uid", "ask", "score", "vec_id"])


class Cells:
    """The rows of a table, packed into cells with their bounds."""

    def __init__(self, rows: DataFrame):
        """rows: uid, vec_id, label, v, and q where a row is an anchor; none null."""
        spark = rows.sparkSession
        cell_rows = CELL_ROWS
        self.dim = dim = int(rows.agg(F.max(F.size("v"))).first()[0] or 0)
        total = rows.count()
        picked = rows.filter(F.pmod(F.xxhash64("uid"), F.lit(10**6)) < int(min(1.0, SAMPLE_ROWS / max(1, total)) * 10**6)).select("v").limit(SAMPLE_ROWS).toArrow()
        sample = int_matrix(picked.column(0).combine_chunks(), dim) if picked.num_rows else np.zeros((0, dim))
        sent = spark.sparkContext.broadcast(reference_directions(sample.astype(np.float64)))
        self.width = width = len(sent.value)

        def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                norms, angles = angles_to(int_matrix(b["v"], dim), sent.value)
                near = angles.argmin(axis=1) if width else np.zeros(len(norms), np.int64)
                own = angles[np.arange(len(norms)), near] if width else norms
                more = [pa.array(norms), pa.array([x.tobytes() for x in angles], pa.binary()), pa.array(near.astype(np.int32) - (0 if width else 1)), pa.array(own)]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "norm", "angles", "reference", "own"])

        placed = rows.select("uid", "vec_id", "label", "v", "q")
        self.rows = written(placed.mapInArrow(located, "uid long, vec_id long, label string, v array<long>, q boolean, norm double, angles binary, reference int, own double"), "located")
        by = ["label", "reference", "own", "uid"]
        packed = self.rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(lambda x: _packed(x, dim, width, cell_rows), CELL)
        self.cells = written(packed.withColumn("cell", F.monotonically_increasing_id()), "cells")
        self.pages = max(1, ceil(self.cells.count() / PAGE_CELLS))

    def best(self, anchors: DataFrame, asks: int, k: int, same: bool, only_first: bool = False) -> DataFrame:
        """(uid, ask, score, vec_id): the k best rows of the same label, or of others, in each window of each anchor.

        anchors: uid, lows and highs, two arrays of `asks` numbers. Anchors go in blocks to the cells that their bounds
        reach; each group of cells gives k rows at most for a window. only_first: of each page of cells just the one with
        the highest bound for an anchor, which gives a first score to beat.
        """
        dim, width, block_rows = self.dim, self.width, BLOCK_ROWS
        by = ["label", "reference", "own", "uid"]
        asking = self.rows.join(anchors, "uid").select("uid", "vec_id", "label", "v", "norm", "angles", "lows", "highs", "reference", "own")
        blocks = asking.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(lambda x: _blocked(x, dim, block_rows), BLOCK)
        blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
        bounds = self.cells.select(F.pmod(F.xxhash64("cell"), F.lit(self.pages)).alias("page"), F.struct("cell", "label_low", "label_high", "low", "high", "norm_low", "norm_high").alias("x"))
        pages = bounds.groupBy("page").agg(F.collect_list("x").alias("bounds"))
        asked = blocks.select("block", "labels", "norms", "angles", "lows", "highs", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.pages - 1).cast("long"))).alias("page"))
        pairs = asked.join(pages, "page").mapInArrow(lambda x: _reached(x, asks, width, same, only_first), "block long, cell long").withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(16)))
        pairs = written(pairs, "pairs")
        block = F.struct(*(x.split()[0] for x in BLOCK.split(", ")))
        cell = F.struct("ids", "labels", "v", "norms", "own", "reference")
        a = pairs.select("block", "part").distinct().join(blocks.select("block", block.alias("a")), "block").select("block", "part", F.lit(0).alias("kind"), "a")
        c = pairs.join(self.cells.select("cell", cell.alias("c")), "cell").select("block", "part", F.lit(1).alias("kind"), "c")
        units = a.unionByName(c, allowMissingColumns=True).repartition("block", "part").sortWithinPartitions("block", "part", "kind")

        def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None
            for b in batches:
                for i, kind in enumerate(b["kind"].to_pylist()):
                    if kind == 0:
                        if now:
                            yield now.found()
                        now = _Block(b["a"][i].as_py(), asks, k, dim, width)
                    else:
                        now.score(b["c"][i].as_py(), same)
            if now:
                yield now.found()

        return units.mapInArrow(visited, FOUND)


def _share(percent: int, score: Column) -> Column:
    """floor(percent * score / 100) without a product that could overflow."""
    rest = F.pmod(score, F.lit(100))
    return F.lit(percent) * F.expr("(positive_score - pmod(positive_score, 100)) div 100") + F.floor(F.lit(percent) * rest / 100)


def hard_negatives(
    df: DataFrame, is_anchor: Column, ident: str = "vec_id", vector: str = "embedding", label: Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), scores by inner product of floor(scale * x).

    An anchor's positives are its best `positives` rows of the same label; for each of them come the best `negatives` rows
    of other labels that score from least to most percent of the positive's score. Ties go to the smaller ident. Rows with
    a null ident, label or vector or a null or non-finite component take no part; a shorter vector counts as padded with
    zeros. Rows of the anchor's own ident are never its positives or negatives; rows that share an ident are candidates, and
    anchors, of their own. An anchor without another row of its label, or without rows in a window, gives none for it.
    Scores are exact at any size; one beyond a long is an error.
    """
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("string").alias("label"), is_anchor.alias("q"), quantised(F.col(vector), scale).alias("v"))
    rows = written(rows.filter("vec_id is not null and label is not null and v is not null").withColumn("q", F.coalesce("q", F.lit(False))).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    cells = Cells(rows)
    anchors = rows.filter("q").select("uid")
    number = lambda x: F.array(F.lit(x).cast("long"))
    first = cells.best(anchors.select("uid", number(LEAST + 1).alias("lows"), number(MOST).alias("highs")), 1, positives, True, only_first=True)
    by_score = Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")
    best = written(first.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") == positives).select("uid", "score"), "first")
    bound = anchors.join(best, "uid", "left").select("uid", F.array(F.coalesce("score", F.lit(LEAST + 1))).alias("lows"), number(MOST).alias("highs"))
    found = cells.best(bound, 1, positives, True).withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= positives)
    chosen = written(found.select("uid", (F.col("n") - 1).alias("ask"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    low, high = -_share(-least, F.col("positive_score")), _share(most, F.col("positive_score"))
    window = chosen.select("uid", F.struct("ask", low.alias("low"), high.alias("high")).alias("x")).groupBy("uid").agg(F.sort_array(F.collect_list("x")).alias("x"))
    padded = lambda side, default: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.get(f"x.{side}", i), F.lit(default).cast("long")))
    asks = window.select("uid", padded("low", 1).alias("lows"), padded("high", 0).alias("highs"))
    by_ask = Window.partitionBy("uid", "ask").orderBy(F.desc("score"), "vec_id")
    mined = cells.best(asks, positives, negatives, False).withColumn("rank", F.row_number().over(by_ask)).filter(F.col("rank") <= negatives)
    out = mined.join(chosen, ["uid", "ask"]).join(rows.filter("q").select("uid", F.col("vec_id").alias("anchor_id")), "uid")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
