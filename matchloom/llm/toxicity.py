"""Severity of toxic language by cumulative-link ordinal regression on sparse text features.

P(grade >= g) = sigmoid(s - threshold_g): one weight vector gives s for every threshold. Features are
the distinct words of a text and their prefixes (PREFIXES characters), hashed to 2**HASH_BITS. Weights
and thresholds are fitted by proximal gradient steps with an L1 penalty, so that most weights are 0, on
a bounded sample of the labelled rows (FIT_ROWS, at most half of each label; the thresholds are then
moved to the labels' true shares) and on the FIT_FEATURES features that tell the labels apart best, so
that the driver's share is bounded in rows and bytes; every whole text is scored in Arrow batches.

The labels say toxic or not, so the grade of a toxic row is set by how many different words of it carry
a feature that marks toxic rows: GRADE_WORDS are the least numbers of such words in grades 2 and 3; any
toxic row has grade 1. Other words do not count, so a text's length alone changes no grade, and a text
that is repeated keeps its score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import batch_predicate, map_batches, materialize

HASH_BITS = 18
PREFIXES = (3, 4, 5, 6, 7)
FIT_ROWS = 8000
FIT_FEATURES = 2048
GRADES = 4
GRADE_WORDS = (3, 6)
MARK_ODDS = 3.0
L1 = 1e-4
STEPS = 600
STRETCH = 2
MIN_ROWS = 4
REJECT_AT = 0.25
WORD_CACHE = 1 << 17
CHUNK = 1 << 20

_words = re.compile(r"[^\W\d_]+").findall


def distinct_words(text: str | None) -> set[str]:
    return set(_words((text or "").lower()))


def word_features(word: str) -> list[int]:
    """Hashed features of one word: itself and its prefixes."""
    mask = (1 << HASH_BITS) - 1
    parts = [f"={word}", *[f"^{word[:n]}" for n in PREFIXES if len(word) >= n]]
    return [zlib.crc32(p.encode("utf-8")) & mask for p in parts]


@dataclass
class OrdinalModel:
    """Weights by feature, increasing thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= g) for g = 1, 2, ...: one column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None], -50, 50)))


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, grades_n: int = GRADES, l1: float = L1, steps: int = STEPS) -> OrdinalModel:
    """Fit on a 0/1-count matrix given as (row, column) pairs; grades: one per row. Maximises the cumulative-link likelihood."""
    n, width = len(grades), 1 << HASH_BITS

    def summed(key: np.ndarray, values: np.ndarray, of: np.ndarray, size: int) -> np.ndarray:
        """Sums of values[of] by key, a chunk of entries at a time so that temporary arrays stay small."""
        out = np.zeros(size)
        for i in range(0, len(key), CHUNK):
            out += np.bincount(key[i : i + CHUNK], weights=values[of[i : i + CHUNK]], minlength=size)
        return out

    thresholds = np.log(np.array([(max((grades < g).sum(), 0.5)) / max((grades >= g).sum(), 0.5) for g in range(1, grades_n)], float))
    thresholds += np.arange(grades_n - 1) * 1e-3
    used = np.flatnonzero(np.bincount(columns, minlength=width))
    place = np.zeros(width, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    at = place[columns]
    # a coordinate's curvature is at most (its rows' lengths) / 4; rows rarely reach it, so steps are STRETCH times as long
    lengths = np.bincount(rows, minlength=n)
    curvature = summed(at, lengths.astype(float), rows, len(used)) / (4 * n * STRETCH) + 1e-8
    weights, previous, momentum = np.zeros(len(used)), np.zeros(len(used)), 1.0
    for _ in range(steps):
        scores = summed(rows, weights, at, n)
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        upper = 1 / (1 + np.exp(-np.clip(scores - edges[grades], -50, 50)))
        lower = 1 / (1 + np.exp(-np.clip(scores - edges[grades + 1], -50, 50)))
        pull = (1 - upper - lower) / n
        share = np.maximum(upper - lower, 1e-9)
        rise = np.zeros(grades_n + 1)
        np.add.at(rise, grades, -upper * (1 - upper) / share)
        np.add.at(rise, grades + 1, lower * (1 - lower) / share)
        thresholds = np.maximum.accumulate(thresholds + 1.0 * rise[1:-1] / n + np.r_[0, np.full(grades_n - 2, 1e-6)])
        moved = weights + summed(at, pull, rows, len(used)) / curvature
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - l1 / curvature, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        weights, previous, momentum = shrunk + (momentum - 1) / following * (shrunk - previous), shrunk, following
    full = np.zeros(width)
    full[used] = previous
    return OrdinalModel(full, thresholds)


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, extra=None, balanced: bool = False) -> tuple[DataFrame, dict[int, int]]:
    """About `rows` labelled documents (doc_id, text, label), chosen by the hash of the id, and the number of ids of each label.

    Every labelled id if there are fewer; balanced: at most half of them of each label. A repeated id takes its
    largest label and, where its rows differ, the text with the least hash, so that it comes once; labels
    other than 0 and 1 and null ids are left out.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    if extra is not None:
        known = known.where(extra)
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    wanted = {y: (rows / 2 / n if balanced else rows / sum(totals.values())) for y, n in totals.items()}
    share = F.lit(0)
    for y, part in wanted.items():
        share = F.when(F.col("label") == y, int(min(1.0, part) * 1_000_000)).otherwise(share)
    known = materialize(known.where(F.pmod(F.xxhash64(F.lit(label), "doc_id"), F.lit(1_000_000)) < share), "sample")
    # at most about `rows` ids, so their broadcast is bounded
    held = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    one = held.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    return one.select("doc_id", "first.text", "label"), totals


def telling_features(sample: DataFrame, features: int) -> DataFrame:
    """The features that differ most between the labels, by chi-squared: feature, and whether it marks toxic rows.

    Counted in arrays of fixed size in every task, then added up in Spark.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, (1 << HASH_BITS) + 1), np.int64)  # the last column counts rows
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = {i for w in distinct_words(text.as_py()) for i in word_features(w)}
                seen[label, np.array([*own, 1 << HASH_BITS])] += 1
        used = np.flatnonzero(seen.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(seen[0, used]), pa.array(seen[1, used])], ["feature", "clean", "toxic"])

    counts = materialize(sample.select("label", "text").transform(map_batches, counted, "feature int, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "feature-counts")
    rows = counts.where(F.col("feature") == 1 << HASH_BITS).select(F.col("clean").alias("all_clean"), F.col("toxic").alias("all_toxic"))
    a, b, n, m = (F.col(c).cast("double") for c in ("toxic", "clean", "all_toxic", "all_clean"))
    apart = (n + m) * F.pow(a * (m - b) - b * (n - a), 2) / F.greatest((a + b) * (n + m - a - b) * n * m, F.lit(1.0))
    odds = F.log((a + 0.5) / (n + 1)) - F.log((b + 0.5) / (m + 1))
    told = counts.where((F.col("feature") < 1 << HASH_BITS) & (F.col("clean") + F.col("toxic") >= MIN_ROWS)).crossJoin(F.broadcast(rows))
    marks = ((odds > MARK_ODDS) & (a >= MIN_ROWS)).alias("marks")
    return told.select("feature", marks, apart.alias("apart")).orderBy(F.desc("apart"), "feature").limit(features)


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, features: int = FIT_FEATURES) -> OrdinalModel:
    """Fit on a bounded sample. Without labelled rows of both kinds every text gets grade 0."""
    sample, totals = sample_rows(docs, labels, "toxic", fit_rows, balanced=True)
    if len(totals) < 2:
        return OrdinalModel(np.zeros(1 << HASH_BITS), np.full(GRADES - 1, 50.0))
    told = telling_features(sample, features).collect()
    shared = sample.sparkSession.sparkContext.broadcast(({r["feature"] for r in told}, {r["feature"] for r in told if r["marks"]}))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, marks = shared.value
        for batch in batches:
            packed, hits = [], []
            for text in batch.column("text"):
                words = [word_features(w) for w in distinct_words(text.as_py())]
                packed.append(np.array(sorted(i for own in words for i in own if i in used), np.int32).tobytes())
                hits.append(sum(not marks.isdisjoint(own) for own in words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(hits, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "label", "hits", "packed"])

    sample = sample.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = sorted(sample.transform(map_batches, featured, "doc_id string, label int, hits int, packed binary").collect(), key=lambda r: (r["doc_id"], bytes(r["packed"])))
    toxic, hits = (np.array([r[c] for r in found], np.int64) for c in ("label", "hits"))
    if len(set(toxic.tolist())) < 2:
        return OrdinalModel(np.zeros(1 << HASH_BITS), np.full(GRADES - 1, 50.0))
    grades = np.where(toxic == 1, 1 + sum((hits >= least).astype(int) for least in GRADE_WORDS), 0).astype(np.int64)
    lists = [np.frombuffer(r["packed"], np.int32) for r in found]
    model = fit_ordinal(np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists]), np.concatenate(lists), grades)
    model.thresholds += np.log((toxic == 1).sum() / (toxic == 0).sum()) - np.log(totals[1] / totals[0])
    return model


class Scorer:
    """Sums of the weights of texts' words; the sums of words are remembered."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.known = weights, {}

    def sums(self, texts: pa.Array) -> np.ndarray:
        known, out = self.known, []
        for text in texts:
            words = distinct_words(text.as_py())
            for w in [w for w in words if w not in known]:
                known[w] = float(self.weights[word_features(w)].sum())
            out.append(sum(sorted(map(known.__getitem__, words))))
            if len(known) > WORD_CACHE:
                known.clear()
        return np.array(out, float)


def score(docs: DataFrame, model: OrdinalModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, expected_severity (0 to 3), grade (the likeliest), p_toxic, toxic (p_toxic >= REJECT_AT).

    Null and empty texts have no features and get the model's base rate; null and repeated ids are rows like
    any other, and equal texts get equal scores; texts of any length are read whole; an empty table gives no
    rows; other columns are not looked at, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value.weights)
        for batch in batches:
            at_least = shared.value.at_least(scorer.sums(batch.column(1)))
            grade = np.argmax(np.c_[1 - at_least[:, 0], at_least[:, :-1] - at_least[:, 1:], at_least[:, -1]], axis=1)
            columns = [batch.column(0), pa.array(at_least.sum(1)), pa.array(grade, pa.int32()), pa.array(at_least[:, 0]), pa.array(at_least[:, 0] >= REJECT_AT)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "expected_severity", "grade", "p_toxic", "toxic"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = f"id {docs.schema[id_col].dataType.simpleString()}, expected_severity double, grade int, p_toxic double, toxic boolean"
    return rows.transform(map_batches, scored, out).withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """The documents that are not rejected, with their own columns, whatever their names; the same rule as in score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer, limit = Scorer(shared.value.weights), shared.value.thresholds[0] + np.log(REJECT_AT / (1 - REJECT_AT))
        for texts in columns:
            yield pa.array(scorer.sums(texts) < limit)

    return docs.where(batch_predicate(docs.sparkSession, kept)("text"))
