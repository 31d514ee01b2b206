"""Exact top-k inner-product search by pivot-table elimination.

With d(q, x) the Euclidean distance, <q, x> = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and for every pivot p
d(q, x) >= |d(q, p) - d(x, p)|. The largest of these lower bounds over the pivots gives an upper bound of
the score. Candidates are scored in the order of that bound, in growing steps, until the k-th best
score exceeds the bound of all that are left; equal bounds are scored too, so ties are exact.

The distances to the pivots are computed once for every vector and every query, when these are packed
into blocks; each task then scores one query block against one vector block and keeps k rows a query at
most, which a window merges. A query's k-th best score in a sample of the vectors is known before any
block is searched, so that every block eliminates from its first candidate on. Pivots and sample (SAMPLE
vectors, and no more than SAMPLE_VALUES components) are all that passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.llm.common import map_batches, materialize

TOP_K = 5
PIVOTS = 48
VECTOR_BLOCK = 4096
QUERY_BLOCK = 4096
#: Components in a block, which then has fewer rows: 8 MB as whole numbers.
BLOCK_VALUES = 1 << 20
SCALE = 256
QUERY_STEP = 50
FIRST_STEP = 64
SAMPLE, SAMPLE_VALUES = 1024, 1 << 21
#: Lengths of vectors that get pivots, the commonest; for others every candidate is scored.
LENGTHS = 16


def quantised(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component in double arithmetic; null where a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(whole & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows to pivots."""
    squares = (x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(squares, 0))


def sample_floor(x: np.ndarray, own: np.ndarray, sample: tuple[np.ndarray, np.ndarray], k: int) -> np.ndarray:
    """Each query's k-th best score in the sample (ids, vectors), its own row left out: no worse row can be among its k best."""
    ids, vectors = sample
    if len(ids) < k:
        return np.full(len(x), -np.inf)
    scores = x @ vectors.T.astype(np.float64)
    scores[own[:, None] == ids[None]] = -np.inf
    floor = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
    return floor - 1e-9 * np.abs(floor) - 0.5  # whole numbers beyond 2**53 are rounded


def pack(rows: DataFrame, block: Column, chosen: dict[int, tuple[np.ndarray, np.ndarray]], pivots: int, k: int) -> DataFrame:
    """One row per block and dimension: block, dim, ids, data (int64), table (float64 distances, a row for each pivot), floor (float64)."""
    shared = rows.sparkSession.sparkContext.broadcast(chosen)

    def packed(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id", kind="stable")
        ids, values = frame["id"].to_numpy(np.int64), np.array(frame["v"].tolist(), np.int64)
        sample = shared.value.get(key[1], (np.empty(0, np.int64), np.empty((0, key[1]), np.int64)))
        x = values.astype(np.float64)
        table = distances(x, sample[1][:pivots].astype(np.float64)).T
        floor = np.concatenate([sample_floor(x[i : i + 512], ids[i : i + 512], sample, k) for i in range(0, len(x), 512)])
        return pd.DataFrame({"block": [key[0]], "dim": [key[1]], "ids": [ids.tobytes()], "data": [values.tobytes()], "table": [table.tobytes()], "floor": [floor.tobytes()]})

    keyed = rows.select("id", "v", block.alias("block"), F.size("v").alias("dim"))
    return keyed.groupBy("block", "dim").applyInPandas(packed, "block long, dim int, ids binary, data binary, table binary, floor binary")


def search_block(
    queries: np.ndarray, to_pivots: np.ndarray, floor: np.ndarray, own: np.ndarray, vectors: np.ndarray, table: np.ndarray, ids: np.ndarray, k: int
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each query the row numbers and scores of its k best vectors, ties to the smaller id, but for those below its floor.

    to_pivots, table: distances of queries and vectors, a row for each pivot; own: ids to leave out.
    """
    exact = max(np.abs(queries).max(), np.abs(vectors).max()) ** 2 * vectors.shape[1] < 2.0**52
    fq, fv = queries.astype(np.float64), vectors.astype(np.float64)
    norms, q_norms = (fv**2).sum(1), (fq**2).sum(1)
    found_rows, found_scores = [], []
    for i in range(len(queries)):
        low = np.zeros(len(vectors))
        for p in range(len(table)):
            np.maximum(low, np.abs(table[p] - to_pivots[p, i]), out=low)
        # rounding of the square roots must not lower a bound
        bound = (norms + q_norms[i] - low**2) / 2 + 1e-6 * (norms + q_norms[i]) + 1.0
        order = np.flatnonzero((bound >= floor[i]) & (ids != own[i]))
        order = order[np.argsort(-bound[order], kind="stable")]
        best_rows, best_scores = np.empty(0, np.int64), np.empty(0, np.int64)
        done, step = 0, FIRST_STEP
        while done < len(order):
            part = order[done : done + step]
            if len(best_scores) == k and best_scores[-1] > bound[part[0]]:
                break
            scores = (fv[part] @ fq[i]).astype(np.int64) if exact else vectors[part] @ queries[i]
            best_rows, best_scores = np.r_[best_rows, part], np.r_[best_scores, scores]
            top = np.lexsort((ids[best_rows], -best_scores))[:k]
            best_rows, best_scores = best_rows[top], best_scores[top]
            done, step = done + len(part), step * 2
        found_rows.append(best_rows)
        found_scores.append(best_scores)
    return found_rows, found_scores


def sampled(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A bounded, seeded sample (ids, vectors) of each of the commonest lengths: the vectors with the least hashes."""
    hashed = rows.select("id", "v", F.size("v").alias("dim"), F.xxhash64(F.lit(11), "id").alias("h"))
    sizes = hashed.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(LENGTHS)
    chosen = {}
    for dim in [r["dim"] for r in sizes.collect()]:
        picked = hashed.where(F.col("dim") == dim).orderBy("h", "id").limit(max(1, min(SAMPLE, SAMPLE_VALUES // dim))).select("id", "v").collect()
        chosen[dim] = (np.array([r["id"] for r in picked], np.int64), np.array([r["v"] for r in picked], np.int64))
    return chosen


def _blocks(rows: DataFrame, most_rows: int, most_values: int) -> int:
    """How many blocks keep both bounds."""
    held = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0)).alias("values")).first()
    return max(1, -(-held["rows"] // most_rows), -(-held["values"] // most_values))


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    *,
    pivots: int = PIVOTS,
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Each query's k best vectors other than those with its own id: query_id, rank, vec_id, score.

    Both tables have id (long) and v (array of long, not null); other columns are not looked at. A query is
    compared with the vectors of its own length. Repeated ids are scored row by row; ties go to the smaller
    id; an empty table gives no rows. Null ids are left out. Blocks hold about block_values components at
    most, however long the vectors are.
    """
    vectors, queries = vectors.where("id is not null"), queries.where("id is not null")
    v_blocks, q_blocks = _blocks(vectors, vector_block, block_values), _blocks(queries, query_block, block_values)
    chosen = sampled(vectors)
    v_packed = pack(vectors, F.pmod(F.xxhash64("id", "v"), F.lit(v_blocks)), chosen, pivots, k).drop("floor")
    q_packed = pack(queries, F.pmod(F.xxhash64("id"), F.lit(q_blocks)), chosen, pivots, k)
    v_packed = materialize(v_packed, "vector-blocks")
    q_packed = materialize(q_packed.select("dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "ids", "data", "table", "floor")]), "query-blocks")
    # every vector block meets every query block: the stated query set against all rows, block by block
    meets = v_packed.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))))
    met = meets.join(q_packed, ["q_block", "dim"]).repartition(max(v_blocks * q_blocks, 1), "q_block", "block", "dim")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, own = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                v, q = (np.frombuffer(row[c], np.int64).reshape(-1, row["dim"]) for c in ("data", "q_data"))
                table, to_pivots = (np.frombuffer(row[c], np.float64).reshape(-1, n) for c, n in (("table", len(ids)), ("q_table", len(own))))
                rows, scores = search_block(q, to_pivots, np.frombuffer(row["q_floor"], np.float64), own, v, table, ids, k)
                sizes = [len(x) for x in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(own, sizes)), pa.array(ids[np.concatenate(rows)]), pa.array(np.concatenate(scores))],
                    ["query_id", "vec_id", "score"],
                )

    found = met.transform(map_batches, searched, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def embedding_neighbours(embeddings: DataFrame, k: int = TOP_K, step: int = QUERY_STEP) -> DataFrame:
    """Rows whose vec_id is divisible by step against all others, on quantised vectors.

    Null and empty vectors, those that hold null or non-finite components, and null ids take no part.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), quantised(F.col("embedding")).alias("v")).where("v is not null")
    return top_k(rows, rows.where(F.col("id") % step == 0), k)


SQL = f"""with v as (select vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v from embeddings
    where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id % {QUERY_STEP} = 0 and q.vec_id <> c.vec_id and len(q.v) = len(c.v)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= {TOP_K}"""
