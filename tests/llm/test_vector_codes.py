import hashlib
import math
import random

import duckdb
import numpy as np
import pandas as pd

from matchloom.llm import vector_codes

COLUMNS = "vec_id long, embedding array<double>, label int, code int"


def brute(rows, parts, entries, rounds):
    """The codes, errors and codebooks by plain loops."""
    kept = [(i, [math.floor(1024 * x) for x in v], y) for i, v, y, *_ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][j * width : (j + 1) * width] for r in seeds] for j in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for j in range(parts):
            groups = {}
            for _, v, _ in kept:
                part = v[j * width : (j + 1) * width]
                groups.setdefault(nearest(part, books[j])[1], []).append(part)
            for k, members in groups.items():
                books[j][k] = [sum(x) // len(members) for x in zip(*members)]
    out = []
    for i, v, y in kept:
        best = [nearest(v[j * width : (j + 1) * width], books[j]) for j in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), y))
    return out, books


def table(n, dim, seed):
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 0.3), 2) for _ in range(dim)], rng.choice([0, 1, None]), 7) for i in range(n)]
    rows += [(n + i, rows[0][1], 2, 7) for i in range(n)]  # a vector that half of the rows hold
    return rows + [(None, rows[1][1], None, 7), (5, rows[2][1], 0, 7), (90, None, 0, 7), (91, [1.0, None] + [0.0] * (dim - 2), 0, 7), (92, [math.nan] * dim, 0, 7), (93, [math.inf] * dim, 0, 7)]


def test_walk_equals_all_distances():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        width, reach = int(rng.integers(1, 6)), int(rng.choice([2, 5, 1000, 1 << 27, 1 << 40]))
        parts = np.unique(rng.integers(-reach, reach, (300, width)), axis=0)
        entries = rng.integers(-reach, reach, (int(rng.integers(1, 20)), width))
        codes, errors = vector_codes.nearest_entries(parts, entries)
        exact = ((parts.astype(object)[:, None] - entries.astype(object)[None]) ** 2).sum(2)
        assert codes.tolist() == exact.argmin(1).tolist()
        assert errors.tolist() == exact.min(1).tolist()


def test_report_equals_brute_force(spark):
    rows = table(300, 8, 1)
    got = vector_codes.code_report(spark.createDataFrame(rows, COLUMNS))
    expected, books = brute(rows, 4, 256, 4)
    sums = {}
    for _, _, error, label in expected:
        sums[label] = sums.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    assert sorted(map(str, ((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got.collect()))) == sorted(str((i, c, e, sums[y], digest)) for i, c, e, y in expected)


def test_few_entries_and_rounds(spark):
    rows = [r[:3] for r in table(120, 6, 2)]
    codes, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), parts=2, entries=5, rounds=2)
    expected, plain = brute(rows, 2, 5, 2)
    assert books.tolist() == plain
    assert sorted(map(str, ((r.id, r.code, r.error) for r in codes.collect()))) == sorted(str(r[:3]) for r in expected)
    back = vector_codes.decode(codes, books).where("id = 3").first()
    code = next(c for i, c, _, _ in expected if i == 3)
    assert back.v == plain[0][int(code[:2], 16)] + plain[1][int(code[2:], 16)]


def test_fewer_rows_than_entries_other_lengths_and_large_components(spark):
    rows = [(1, [0.5, 0.25, 1e12, -1e12], None), (2, [0.5, 0.25, 1e12, -1e12], 1), (3, [-0.1, 0.0, -3e9, 3e9], 1), (4, [], 1), (5, [1.0] * 5, 1), (6, [1.0] * 8, 1)]
    out = {r.vec_id: r for r in vector_codes.code_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [out[i].code for i in (1, 2, 3)] == ["00000000", "00000000", "02020202"] and [out[i].error for i in (1, 2, 3)] == [0, 0, 0]
    assert [(out[i].code, out[i].error) for i in (4, 5, 6)] == [(None, None)] * 3


def test_empty_table(spark):
    assert vector_codes.code_report(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_sql_equals_the_query(spark):
    rows = [(i, v, y) for i, v, y, _ in table(260, 8, 3) if i is not None]
    embeddings = pd.DataFrame(rows, columns=["vec_id", "embedding", "label"])
    embeddings["label"] = embeddings["label"].astype("Int64")
    con = duckdb.connect()
    con.register("raw", embeddings)
    con.sql("create view embeddings as select vec_id::bigint as vec_id, embedding::double[] as embedding, label::int as label from raw")
    wanted = con.sql(vector_codes.code_sql()).fetchall()
    got = vector_codes.code_report(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(tuple(r) for r in got) == sorted(wanted)
