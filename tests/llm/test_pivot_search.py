import math
import random

import numpy as np

from matchloom.llm import pivot_search


def vectors(n, dim, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(dim)], 1) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(30)]  # a common vector: ties
    return rows + [(9000, None, 1), (9001, [1.0, None] + [0.0] * (dim - 2), 1), (9050, [math.nan] * dim, 1), (9100, [], 1), (9150, [0.5, 0.5], 1), (9151, [0.25, 0.5], 1)]


def brute(rows, k, step):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in whole:
        if q % step == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_equals_brute_force(spark):
    rows = vectors(400, 12, 1)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in pivot_search.embedding_neighbours(table).collect()}
    assert got == brute(rows, 5, 50)


def test_blocks_do_not_matter(spark):
    rows = vectors(150, 6, 2)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    table = table.selectExpr("vec_id as id", "embedding").select("id", pivot_search.quantised(table.embedding).alias("v")).where("v is not null")
    out = pivot_search.top_k(table, table.where("id % 10 = 0"), 3, vector_block=20, query_block=4, pivots=5)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()} == brute(rows, 3, 10)


def test_empty_table(spark):
    table = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert pivot_search.embedding_neighbours(table).count() == 0


def test_hundreds_of_equal_vectors_in_one_block():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        vectors = np.floor(256 * rng.normal(0, 0.1, (2000, 16))).astype(np.int64)
        query = np.floor(256 * rng.normal(0, 0.3, (1, 16))).astype(np.int64)
        vectors[rng.choice(2000, 700, replace=False)] = query[0]
        ids = np.arange(2000)
        pivots = vectors[:48].astype(float)
        to_pivots, table = pivot_search.distances(query.astype(float), pivots).T, pivot_search.distances(vectors.astype(float), pivots).T
        floor = pivot_search.sample_floor(query.astype(float), np.array([-1]), (ids[::7], vectors[::7]), 5)
        rows, scores = pivot_search.search_block(query, to_pivots, floor, np.array([-1]), vectors, table, ids, 5)
        exact = vectors @ query[0]
        assert rows[0].tolist() == np.lexsort((ids, -exact))[:5].tolist()
        assert scores[0].tolist() == exact[rows[0]].tolist()


def test_blocks_by_components(spark):
    rows = vectors(120, 300, 3)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    table = table.selectExpr("vec_id as id", "embedding").select("id", pivot_search.quantised(table.embedding).alias("v")).where("v is not null")
    assert pivot_search._blocks(table, 4096, 10_000) >= 120 * 300 // 10_000 and pivot_search._blocks(table.limit(0), 4096, 10_000) == 1
    out = pivot_search.top_k(table, table.where("id % 10 = 0"), 3, block_values=10_000)
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in out.collect()} == brute(rows, 3, 10)
