import itertools
import random

import numpy as np

from matchloom.llm import ngram_join
from matchloom.llm.components import connected_components


def brute_force(texts):
    """component_id and set size of each id, by comparing all pairs of shingle sets."""
    sets = {}
    for i, text in texts.items():
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(texts), 2):
        union = len(sets[a] | sets[b])
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * union:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {(i, len(sets[i]), find(i)) for i in texts}


def corpus(seed, groups=12, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = rng.choices(vocabulary, k=30)
    texts, i = {}, 0
    for _ in range(groups):
        base = rng.choices(vocabulary, k=rng.choice((3, 6, 20, 80, 200)))
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 3, 5, 9))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts[i] = rng.choice((" ", "\n", "\t ")).join(words).upper() if rng.random() < 0.2 else " ".join(words)
            i += 1
    return texts | {i: None, i + 1: "", i + 2: " \n ", i + 3: "one", i + 4: "One", i + 5: "the end", i + 6: "x" * 100_000}


def found(spark, texts, **extra):
    docs = spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string")
    return {tuple(r) for r in ngram_join.near_duplicates(docs).collect()}


def test_equals_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        assert found(spark, texts) == brute_force(texts)


def test_split_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 4)
    monkeypatch.setattr(ngram_join, "HEAP_ENTRIES", 5)
    monkeypatch.setattr(ngram_join, "PROBED_TOGETHER", 2)
    monkeypatch.setattr(ngram_join, "CELL_BYTES", 4000)
    monkeypatch.setattr(ngram_join, "BUCKET_ENTRIES", 500)
    monkeypatch.setattr(ngram_join, "HEAVY_SAMPLE", 2)
    monkeypatch.setattr(ngram_join, "HEAVY_HOLDERS", 12)
    texts = corpus(3, groups=4, copies=30)
    assert found(spark, texts) == brute_force(texts)


def test_cell_search_alone():
    rng = random.Random(5)
    base = [rng.randrange(1 << 60) for _ in range(200)]
    sets = [np.unique(np.array([*base[: 200 - k], *(rng.randrange(1 << 60) for _ in range(k))], np.uint64)) for k in range(0, 120, 5)]
    links = ngram_join.search_cell(np.arange(len(sets)), np.arange(len(sets)), sets)
    root = list(range(len(sets)))
    for a, b in links:
        x = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x)
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    expected = list(range(len(sets)))
    for a, b in itertools.combinations(range(len(sets)), 2):
        x = len(np.intersect1d(sets[a], sets[b]))
        if 100 * x >= 80 * (len(sets[a]) + len(sets[b]) - x):
            low = min(expected[a], expected[b])
            expected = [low if r in (expected[a], expected[b]) else r for r in expected]
    assert root == expected


def test_empty_nulls_and_repeats(spark):
    schema = "doc_id long, text string, component_id string"
    assert ngram_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (0, "a b c d e f", "y")]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(map(str, ({tuple(r) for r in ngram_join.near_duplicates(docs).collect()}))) == sorted(map(str, {(None, 2, None), (1, 2, 0), (0, 2, 0)}))
    assert sorted(map(str, ngram_join.one_of_each(docs).collect())) == sorted(map(str, docs.where("doc_id is null or doc_id = 0").collect()))


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    out = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_exact_copies_travel_once(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = {i: " ".join(words) for i in range(200)} | {200: " ".join([*words[:-1], "other"]), 201: "something else"}
    rows_of = []
    plain = ngram_join.shared_fingerprints

    def counted(rows, owner, *rest, **extra):
        rows_of.append((rows.count(), rows.select(owner).distinct().count()))
        return plain(rows, owner, *rest, **extra)

    monkeypatch.setattr(ngram_join, "shared_fingerprints", counted)
    assert found(spark, texts) == brute_force(texts)
    assert rows_of[0] == (3, 3)
    assert all(rows == owners for rows, owners in rows_of)


def test_marks_bound_the_difference():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 600).astype(np.uint64))
    sets = [np.unique(np.r_[rng.choice(base, n, replace=False), rng.integers(0, 1 << 63, m).astype(np.uint64)]) for n, m in [(1, 0), (590, 3), (580, 40), (300, 900), (0, 1)]]
    marks = ngram_join.parity_marks(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            assert int(np.bitwise_count(marks[i] ^ marks[j]).sum()) <= len(np.setxor1d(a, b))


def test_sets_that_share_much_but_too_little_do_not_enter_the_heap(monkeypatch):
    from heapq import merge

    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 400).astype(np.uint64))
    sets = [np.sort(rng.choice(base, 240, replace=False)) for _ in range(150)]  # any two share about 144 of the 214 that a link needs
    near = [np.sort(np.r_[np.delete(s, [3, 40, 100]), rng.integers(0, 1 << 63, 3).astype(np.uint64)]) for s in sets[:20]]
    merged = []

    def counted(*runs):
        merged.append(sum(map(len, runs)))
        return merge(*runs)

    monkeypatch.setattr(ngram_join.heapq, "merge", counted)
    every = sets + near
    links = ngram_join.search_cell(np.arange(170), np.arange(170), every)
    assert {tuple(sorted(x)) for x in links} == {(i, 150 + i) for i in range(20)}
    assert sum(merged) < 170 * 20
