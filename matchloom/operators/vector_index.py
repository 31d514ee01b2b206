"""Approximate nearest profiles by an inverted-file index: coarse cells, residual codes, exact scores for the best.

The model (cell centroids, and codebooks for parts of what a vector differs from its centroid) is fitted on
a bounded sample; every profile is indexed. Cells are put together to shards of bounded size. A search reads, in every
shard, the codes of the cells nearest to an opening, ranks them by the vectors that the codes stand for, and computes the
cosine only for the best of these. As a shard does not grow with the table, neither does the number of worse profiles that
codes may put before a near one. How many cells are read is a knob; by default it is the least number at which the sample's
own nearest neighbours lie in the cells read, as often as TARGET says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.retrieval import DIGITS, first_of_each, least_best, meeting, places, sliced, top_k
from matchloom.sources.tables import written

#: Rows and values of the sample that is fitted on the driver.
SAMPLE_ROWS, SAMPLE_VALUES = 16_384, 1 << 22
MOST_CELLS, ENTRIES, PART_SIZE, STEPS = 4096, 256, 4, 12
#: Profiles of a shard, openings of a block, and pairs whose cosine is worked out at a time.
CODE_BLOCK, QUERY_BLOCK, PAIRS = 16_384, 512, 1 << 16
#: Sample rows that stand for openings when the number of cells is set, and the share of their neighbours that must be met.
TRIALS, TARGET = 256, 0.96
RESCORED = 8


@dataclass
class VectorIndex:
    """centroids: (cells, dim); books: (parts, entries, part size), of residuals; probes: cells that a search reads."""

    centroids: np.ndarray
    books: np.ndarray
    probes: int

    def residual_codes(self, vectors: np.ndarray, cells: np.ndarray) -> np.ndarray:
        rest = self.cut(vectors - self.centroids[cells])
        return np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.books)], axis=1).astype(np.uint8)

    def cut(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors in parts, the last filled up with zeros."""
        parts, _, size = self.books.shape
        full = np.zeros((len(vectors), parts * size))
        full[:, : vectors.shape[1]] = vectors
        return full.reshape(len(vectors), parts, size)


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squares, parts = (centres**2).sum(1)[None], range(0, max(len(rows), 1), 4096)
    return np.concatenate([(squares - 2 * (rows[i : i + 4096] @ centres.T)).argmin(1) for i in parts])


def k_means(rows: np.ndarray, count: int, seed: int, steps: int = STEPS) -> np.ndarray:
    """Centres of rows by seeded Lloyd steps; empty ones keep their place."""
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:count]].copy()
    for _ in range(steps):
        own = nearest(rows, centres)
        held = np.bincount(own, minlength=len(centres))
        sums = np.stack([np.bincount(own, rows[:, d], len(centres)) for d in range(rows.shape[1])], axis=1)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def usable(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).select(key, "embedding")


def fit_index(resumes: DataFrame, k: int, *, cells: int | None = None, probes: int | None = None, seed: int = 7) -> VectorIndex:
    """Fit on the profiles (resume_id, embedding, of one length) with the least hashes. cells: by default the root of their number."""
    rows = usable(resumes, "resume_id")
    count, dim = rows.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not count:
        raise ValueError("no profile has a vector")
    most = max(1, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    picked = rows.orderBy(F.xxhash64(F.lit(seed), "resume_id"), "resume_id").limit(most).select("embedding").collect()
    sample = np.array([r[0] for r in picked], float)
    cells = min(len(sample), cells or min(MOST_CELLS, max(1, round(count**0.5))))
    centroids = k_means(sample, cells, seed)
    own = nearest(sample, centroids)
    parts = -(-dim // PART_SIZE)
    index = VectorIndex(centroids, np.zeros((parts, 1, PART_SIZE)), cells)
    rest = index.cut(sample - centroids[own])
    index.books = np.stack([k_means(rest[:, p], min(ENTRIES, len(sample)), seed + p) for p in range(parts)])
    if probes is None:
        if count > len(sample) and len(sample) > 2 * cells:  # rows outside the sample are farther from the centroids: so judge by rows that these have not seen
            sample, seen = sample[: len(sample) // 2], sample[len(sample) // 2 :]
            centroids = k_means(seen, cells, seed)
            own = nearest(sample, centroids)
        asked = sample[:TRIALS]
        scores = asked @ sample.T
        scores[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
        best = np.argsort(-scores, axis=1)[:, : min(k, len(sample) - 1)]
        place = np.argsort(np.argsort(-(asked @ centroids.T), axis=1), axis=1)  # of each cell in an opening's order
        met = np.take_along_axis(place, own[best], axis=1)
        probes = int(np.quantile(met, TARGET)) + 1 if met.size else cells
    index.probes = min(probes, cells)
    return index


def write_index(resumes: DataFrame, index: VectorIndex, path: str) -> None:
    """Write the codes and vectors of all profiles: one row a shard (shard, cells, ids, codes, vectors), by cell and id.

    A shard holds whole cells, about CODE_BLOCK profiles; a cell of more is dealt over shards of its own by the hash of the id.
    """
    spark = resumes.sparkSession
    shared = spark.sparkContext.broadcast(index)
    kind, vector = resumes.schema["resume_id"].dataType.simpleString(), resumes.schema["embedding"].dataType.simpleString()
    number = np.float32 if vector == "array<float>" else np.float64

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = matrix(batch.column(1))
            cells = nearest(vectors, shared.value.centroids)
            codes = shared.value.residual_codes(vectors, cells)
            cells_, codes_, vectors_ = pa.array(cells.astype(np.int32)), *[pa.array([x.tobytes() for x in a], pa.binary()) for a in (codes, vectors.astype(number))]
            yield pa.RecordBatch.from_arrays([cells_, batch.column(0), codes_, vectors_], ["cell", "id", "code", "vector"])

    rows = written(usable(resumes, "resume_id").mapInArrow(coded, f"cell int, id {kind}, code binary, vector binary"), "codes")
    sizes = {r["cell"]: r["n"] for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a cell
    places, shard, held = [], 0, 0
    for cell, n in sorted(sizes.items()):
        parts = -(-n // CODE_BLOCK)
        if held and held + n > CODE_BLOCK:
            shard, held = shard + 1, 0
        places.append((cell, shard, parts))
        shard, held = (shard + parts, 0) if parts > 1 else (shard, held + n)
    placed = rows.join(F.broadcast(spark.createDataFrame(places, "cell int, first int, parts int")), "cell")
    numbered = placed.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int").alias("shard"), F.struct("cell", "id", "code", "vector").alias("row"))
    packed = numbered.groupBy("shard").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, cell in zip(*batch.columns, strict=True):
                inner = cell.values
                whole = [pa.array([b"".join(inner.field(c).to_pylist())], pa.binary()) for c in ("code", "vector")]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(inner)], pa.int32()), inner.field(c)) for c in ("cell", "id")]
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int32()), *lists, *whole], ["shard", "cells", "ids", "codes", "vectors"])

    packed.mapInArrow(joined, f"shard int, cells array<int>, ids array<{kind}>, codes binary, vectors binary").write.mode("overwrite").parquet(path)


def search_index(jobs: DataFrame, resumes: DataFrame, index: VectorIndex, path: str, k: int, *, rescored: int | None = None) -> DataFrame:
    """The k best profiles of every opening among those of its cells: job_id, resume_id, embedding_cosine, retrieval_rank.

    jobs: job_id, embedding; resumes: the profiles of the index. rescored: how many profiles of a shard get an exact score (RESCORED * k by default).
    Every opening gets k rows if the cells read hold them: where those nearest hold fewer than rescored profiles, more cells are read.
    Openings travel to the shards; a task keeps one shard while they come by.
    """
    spark, rescored = jobs.sparkSession, rescored or RESCORED * k
    kinds = (jobs.schema["job_id"].dataType.simpleString(), resumes.schema["resume_id"].dataType.simpleString())
    shards = spark.read.parquet(path)
    number = np.float32 if resumes.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    # one row a cell; the numbers of its profiles let an opening read on until it has enough
    sizes = {r["cell"]: r["n"] for r in shards.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("n")).collect()}
    shared = spark.sparkContext.broadcast((index, np.array([sizes.get(c, 0) for c in range(len(index.centroids))])))

    def probed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """reach: the score of the last centroid whose cell an opening reads."""
        index, held = shared.value
        for batch in batches:
            scores = matrix(batch.column(1)) @ index.centroids.T
            order = np.argsort(-scores, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            read = (np.arange(order.shape[1])[None] < index.probes) | (before < rescored)
            last = np.take_along_axis(order, read.sum(1)[:, None] - 1, axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.take_along_axis(scores, last, axis=1)[:, 0])], ["job_id", "embedding", "reach"])

    asked, vector = usable(jobs, "job_id"), jobs.schema["embedding"].dataType.simpleString()
    blocks, others = max(1, -(-asked.count() // QUERY_BLOCK)), shards.count()
    reads = asked.mapInArrow(probed, f"job_id {kinds[0]}, embedding {vector}, reach double")
    grouped = reads.groupBy(F.pmod(F.xxhash64("job_id"), F.lit(blocks)).cast("int").alias("q")).agg(F.collect_list(F.struct("job_id", "embedding", "reach")).alias("asked"))
    held, slices = sliced(shards, others, blocks)
    # shards are numbered from 0; those that a cell's hashes left empty have no row
    coming = grouped.crossJoin(F.broadcast(shards.agg(F.collect_list("shard").alias("shards")))).select(F.explode("shards").alias("shard"), (F.col("q") % slices).alias("slice"), "asked")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value[0]
        for batch in batches:
            for cells, ids, codes, vectors, asked in zip(*[batch.column(c) for c in ("cells", "ids", "codes", "vectors", "asked")], strict=True):
                if cells.is_valid:
                    cell, names = cells.values.to_numpy(), ids.values.to_numpy(zero_copy_only=False).copy()
                    code = np.frombuffer(codes.as_py(), np.uint8).reshape(len(cell), -1)
                    rest = np.concatenate([index.books[p][code[:, p]] for p in range(code.shape[1])], axis=1)[:, : index.centroids.shape[1]]
                    stands = (index.centroids[cell] + rest).astype(np.float32)
                    exact = np.frombuffer(vectors.as_py(), number).reshape(len(cell), -1)
                    own, starts = np.unique(cell, return_index=True)
                    edges = np.r_[starts, len(cell)]
                    continue
                queries, reach = matrix(asked.values.field("embedding")), asked.values.field("reach").to_numpy()
                near = ~(queries @ index.centroids[own].T < reach[:, None] - 1e-9)
                guesses, short = np.full((len(queries), len(cell)), -np.inf, np.float32), queries.astype(np.float32)
                for c in np.flatnonzero(near.any(0)):
                    reading, a, b = np.flatnonzero(near[:, c]), edges[c], edges[c + 1]
                    guesses[reading, a:b] = short[reading] @ stands[a:b].T
                # equal codes may differ by a little, so those about as good as the last are met too
                lowest = np.finfo(np.float32).min / 4
                least = np.nan_to_num(least_best(guesses, rescored), nan=lowest, neginf=lowest)
                row, column = places(~(guesses < (least - 1e-6 * (1 + np.abs(least)))[:, None]))
                parts = [slice(i, i + PAIRS) for i in range(0, len(row), PAIRS)]
                scores = np.round(np.concatenate([np.empty(0), *[(queries[row[p]] * exact[column[p]]).sum(1) for p in parts]]), DIGITS)
                best = first_of_each(row, names[column], scores, k)
                yield pa.RecordBatch.from_arrays([asked.values.field("job_id").take(pa.array(row[best])), pa.array(names[column[best]]), pa.array(scores[best])], ["job_id", "resume_id", "embedding_cosine"])

    met = meeting(held, coming, ["shard", "slice"]).select("cells", "ids", "codes", "vectors", "asked")
    return top_k(met.mapInArrow(searched, f"job_id {kinds[0]}, resume_id {kinds[1]}, embedding_cosine double"), k, "embedding_cosine")


def index_report(found: DataFrame, exact: DataFrame, index: VectorIndex, path: str, rescored: int) -> DataFrame:
    """One row: openings, rows, recall of found against exact, and the shares of profiles whose vectors (rescored of a shard) and (about) whose codes were read."""
    both = exact.join(found.select("job_id", "resume_id", F.lit(1).alias("hit")), ["job_id", "resume_id"], "left")
    recall = both.agg(F.count_distinct("job_id").alias("openings"), (F.count("hit") / F.count("*")).alias("recall"))
    profiles = found.sparkSession.read.parquet(path).agg(F.sum(F.size("ids")).alias("profiles"), F.sum(F.least(F.lit(rescored), F.size("ids"))).alias("scored"))
    rows = found.agg(F.count("*").alias("rows"))
    shares = [(F.col("scored") / F.col("profiles")).alias("vectors_read"), F.lit(index.probes / len(index.centroids)).alias("codes_read")]
    return recall.crossJoin(F.broadcast(profiles)).crossJoin(F.broadcast(rows)).select("openings", "rows", "recall", *shares)
