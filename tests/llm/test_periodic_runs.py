import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np

from matchloom.llm import periodic_runs


def brute(words, least=24, exponent=3):
    """Runs by comparing the words at every distance."""
    found = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j + q), q)  # periods come in order, so the smallest stays
            i = j
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def random_words(rng):
    """Words with nested periods, broken periods and neighbouring runs."""
    out = []
    for _ in range(rng.randint(0, 6)):
        root = [str(rng.randint(0, rng.choice([1, 2, 5, 50]))).encode() for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 40, 65]))]
        if rng.random() < 0.3:
            root = root * rng.randint(2, 9) + [b"x"]
        part = (root * rng.randint(1, 8))[: rng.randint(1, 400)]
        if rng.random() < 0.3:
            part[rng.randrange(len(part))] = b"y"
        out += part
    return out


def test_runs_equal_brute_force():
    rng = random.Random(4)
    docs = [random_words(rng) for _ in range(400)]
    for i in range(0, 400, 40):
        assert periodic_runs.runs_of(docs[i : i + 40]) == [brute(w) for w in docs[i : i + 40]]


def test_other_limits_and_one_word_at_a_time():
    rng = random.Random(5)
    for least, exponent in ((2, 2), (6, 2), (10, 4), (24, 3)):
        for _ in range(25):
            words = random_words(rng)[:160]
            names = {w: i for i, w in enumerate(sorted(set(words)))}
            catcher = periodic_runs.SquareCatcher(least=least, exponent=exponent)
            at = 0
            while at < len(words):  # the runs do not depend on how many words come at a time
                n = rng.choice([1, 1, 2, 7, 30])
                catcher.append(np.array([names[w] for w in words[at : at + n]], np.int64))
                at += n
            assert [tuple(r) for r in catcher.finish().tolist()] == brute(words, least, exponent)


def test_one_word_repeated_and_a_long_text():
    assert periodic_runs.runs_of([[b"a"] * 20_000, [], [b"a"] * 23]) == [[(0, 20_000, 1)], [], []]
    rng = random.Random(6)
    line = [str(rng.randint(0, 10**6)).encode() for _ in range(70_001)]
    assert periodic_runs.runs_of([line * 3 + line[:5]]) == [[(0, 210_008, 70_001)]]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(runs), *shown, hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_report_equals_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, b" ".join(random_words(rng)).decode() + "\x1c  é\n", 5) for i in range(120)]
    rows += [(None, "a b " * 30, 5), (None, None, 5), (3, "", 5), (7, " \t\n\x0b\x0c\r ", 5), *[rows[0]] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    out = periodic_runs.run_report(docs)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(expected(*r[:2])) for r in rows)
    assert periodic_runs.run_report(docs.limit(0)).count() == 0


def test_runs_and_collapsed_texts(spark):
    docs = spark.createDataFrame([(1, "x " + "b  c " * 20 + "d"), (2, None), (3, "one two")], "doc_id long, text string")
    assert [tuple(r) for r in periodic_runs.find_runs(docs).collect()] == [(1, 1, 40, 2)]
    assert {tuple(r) for r in periodic_runs.collapse_text(docs).collect()} == {(1, 1, "x b c d"), (2, 0, ""), (3, 0, "one two")}
