"""Document quality by histogram gradient-boosted trees over text statistics.

The statistics of every whole text come from byte histograms and word and line counts. Trees are grown
level by level on BINS quantile bins of a bounded sample of the labelled rows (FIT_ROWS), with numpy
histograms, and kept as level-order arrays; scoring walks all trees of a batch at once in numpy.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import map_batches
from matchloom.llm.toxicity import sample_rows

FIT_ROWS = 20_000
BINS = 64
TREES = 80
DEPTH = 4
RATE = 0.15
RIDGE = 1.0
LEAST_HESSIAN = 1.0
FOLDS, HELD_OUT = 3, 1

MARKS = b".,;:!?|#$%&*\"'()[]{}<>/=+-_@~^"
STATISTICS = 20 + len(MARKS)


def statistics(text: str | None) -> np.ndarray:
    """Length, byte classes, mark shares, word and line shape of one text; zeros where there is nothing to measure."""
    data = (text or "").encode("utf-8")
    out = np.zeros(STATISTICS)
    if not data:
        return out
    codes = np.frombuffer(data, np.uint8)
    n, by = len(data), np.bincount(codes, minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    counts = Counter(words)
    space = np.isin(codes, (9, 10, 11, 12, 13, 32))
    lengths = np.diff(np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)) != 0))[::2] if words else np.zeros(1)
    line_lengths = np.array([len(x) for x in lines] or [0])
    total = max(len(words), 1)
    upper, lower = by[65:91].sum(), by[97:123].sum()
    shape = [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), upper / n, lower / n, by[48:58].sum() / n, by[128:].sum() / n,
        space.sum() / n, upper / max(upper + lower, 1), lengths.mean(), lengths.std(), np.log1p(lengths.max()), (lengths <= 3).mean(),
        len(counts) / total, max(counts.values(), default=0) / total, sum(c for c in counts.values() if c == 1) / total,
        len(set(lines)) / max(len(lines), 1), line_lengths.mean(), line_lengths.std(), by[:32].sum() / n,
    ]
    out[:20] = shape
    out[20:] = by[np.frombuffer(MARKS, np.uint8)] / total
    return out


@dataclass
class Forest:
    """Trees in level order: node i of a tree has children 2i+1 and 2i+2; x <= limit goes left."""

    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = len(self.feature)
        if not trees or not len(x):
            return 1 / (1 + np.exp(-np.full(len(x), self.base)))
        node, row, tree = np.zeros((len(x), trees), np.int64), np.arange(len(x))[:, None], np.arange(trees)[None]
        depth = int(np.log2(self.feature.shape[1] + 1))
        for _ in range(depth):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        return 1 / (1 + np.exp(-(self.base + self.value[tree, node - self.feature.shape[1]].sum(1))))


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Forest:
    """Boost the log-loss: gradients and Hessians are summed by (node, bin); each node takes its best split."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(width)], axis=1)
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    inner = 2**depth - 1
    feature, limit, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            best = np.full(nodes, 1e-6)
            for f in range(width):
                slot = (node - first) * BINS + binned[:, f]
                g = np.bincount(slot, gradient, nodes * BINS).reshape(nodes, BINS).cumsum(1)
                h = np.bincount(slot, hessian, nodes * BINS).reshape(nodes, BINS).cumsum(1)
                g_all, h_all = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (g_all - g) ** 2 / (h_all - h + RIDGE) - g_all**2 / (h_all + RIDGE)
                gain[(h < LEAST_HESSIAN) | (h_all - h < LEAST_HESSIAN)] = 0
                gain = gain[:, : len(cuts[f])]
                if not gain.shape[1]:
                    continue
                at = gain.argmax(1)
                better = gain[np.arange(nodes), at] > best
                best = np.where(better, gain[np.arange(nodes), at], best)
                feature[t, first : first + nodes][better] = f
                limit[t, first : first + nodes][better] = cuts[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > limit[t, node])
        leaf = node - inner
        value[t] = RATE * np.bincount(leaf, gradient, inner + 1) / (np.bincount(leaf, hessian, inner + 1) + RIDGE)
        margin += value[t][leaf]
    return Forest(feature, limit, value, base)


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo FOLDS. Null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """Fit on a bounded sample outside the held-out fold; with labels of one kind every score is their rate."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [statistics(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], ["label", "packed"])

    sample, _ = sample_rows(docs, labels, "quality", fit_rows, ~held_out())
    found = sorted((r["label"], bytes(r["packed"])) for r in sample.select("label", "text").transform(map_batches, measured, "label int, packed binary").collect())
    if not found:
        return Forest(np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)), 0.0)
    return fit_forest(np.stack([np.frombuffer(b) for _, b in found]), np.array([y for y, _ in found], float))


def score(docs: DataFrame, forest: Forest, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, score (likelihood of label 1), predicted (score >= 0.5). Null texts count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([statistics(t.as_py()) for t in batch.column(1)]) if batch.num_rows else np.zeros((0, STATISTICS))
            s = np.concatenate([shared.value.score(x[i : i + 512]) for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.transform(map_batches, scored, f"id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int").withColumnRenamed("id", id_col)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts count as empty and get the score of zero statistics; null and repeated ids are rows
    like any other, and equal texts get equal scores; texts of any length are read whole; an empty table gives
    no rows, and without labels every score is 0.5; other columns are not looked at, whatever their names.
    """
    return score(docs, train(docs, labels)).select("doc_id", held_out().alias("held_out"), "score", "predicted")
