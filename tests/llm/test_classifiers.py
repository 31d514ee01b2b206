import math
import random
import re
import statistics
import zlib

import numpy as np

from matchloom.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int, note string"


def corpus(spark, n=1500, seed=4):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)]
    docs, labels = [], []
    for i in range(n):
        text = rng.choices(words, k=40)
        toxic, good = int(i % 5 == 0), int(i % 3 > 0)
        if toxic:
            for _ in range(rng.choice((1, 3, 8))):
                text[rng.randrange(40)] = rng.choice(["zounds", "zounding", "xylo", "qwerty"])
        docs.append((i, (" " if good else "### ").join(text), "en"))
        labels.append((i, good, toxic, None))
    docs += [(None, None, None), (n, "", "en"), (n + 1, "word " * 50_000, "en")]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic string"), spark.createDataFrame(labels, LABELS)


def test_toxicity_on_rows_kept_from_training(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels.where("doc_id % 2 = 0"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    out = toxicity.score(docs, model).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.expected_severity <= 3 and 0 <= r.grade <= 3
    seen = [(truth[r.doc_id], r.toxic) for r in out if r.doc_id in truth and r.doc_id % 2]
    assert np.mean([a == b for a, b in seen]) > 0.94
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {r.doc_id for r in out if not r.toxic}
    assert toxicity.drop_toxic(docs, model).columns == docs.columns


def test_scores_recomputed(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}

    def by_hand(text):
        words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
        total = sum(model.weights[zlib.crc32(p.encode()) % (1 << 18)] for w in words for p in [f"={w}", *(f"^{w[:n]}" for n in range(3, 8) if len(w) >= n)])
        return [1 / (1 + math.exp(t - total)) for t in model.thresholds]

    for r in toxicity.score(docs, model).collect():
        p = by_hand(texts[r.doc_id])
        assert abs(r.expected_severity - sum(p)) < 1e-9 and abs(r.p_toxic - p[0]) < 1e-9 and r.toxic == (p[0] >= toxicity.REJECT_AT)
        assert r.grade == int(np.argmax([1 - p[0], p[0] - p[1], p[1] - p[2], p[2]]))


def test_severity_orders_texts_of_one_length_and_ignores_repeats(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels)
    clean = [r.text.split() for r in docs.where("doc_id = 1").collect()][0]
    bad = ["zounds", "xylo", "qwerty", "zounding"]
    texts = [" ".join(clean[: 40 - n] + bad[:n]) for n in range(5)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(10 + i, f"{t} {t}") for i, t in enumerate(texts)]
    severity = {r.doc_id: r.expected_severity for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert all(severity[i] < severity[i + 1] for i in range(4)) and all(severity[i] == severity[10 + i] for i in range(5))


def by_hand_statistics(text):
    data = text.encode()
    words, lines, n = data.split(), [x for x in data.split(b"\n") if x.strip()], len(data)
    sizes, line_sizes = [len(w) for w in words], [len(x) for x in lines] or [0]
    upper, lower = sum(65 <= c <= 90 for c in data), sum(97 <= c <= 122 for c in data)
    total, sizes = max(len(words), 1), sizes or [0]
    return [
        math.log1p(n), math.log1p(len(words)), math.log1p(len(lines)), upper / n, lower / n, sum(48 <= c <= 57 for c in data) / n, sum(c > 127 for c in data) / n,
        sum(c in b"\t\n\v\f\r " for c in data) / n, upper / max(upper + lower, 1), statistics.fmean(sizes), statistics.pstdev(sizes), math.log1p(max(sizes)),
        sum(x <= 3 for x in sizes) / len(sizes), len(set(words)) / total, max([words.count(w) for w in words], default=0) / total, sum(words.count(w) == 1 for w in words) / total,
        len(set(lines)) / max(len(lines), 1), statistics.fmean(line_sizes), statistics.pstdev(line_sizes), sum(c < 32 for c in data) / n,
        *(data.count(bytes([m])) / total for m in quality.MARKS),
    ]


def test_statistics_by_hand():
    for text in ("A b, a.\nA b, a.\n\n  two  3 #x", "x", "  \n ", "Ünïcode ñ; \t(tab) [x] {y}", "one\rtwo\x0bthree"):
        assert np.allclose(quality.statistics(text), by_hand_statistics(text)), text
    assert not quality.statistics("").any() and not quality.statistics(None).any()


def test_quality_of_an_empty_table(spark):
    docs, labels = corpus(spark, 60)
    assert quality.quality_report(docs.limit(0), labels).count() == 0


def test_grades_follow_the_number_of_hits():
    rng = np.random.default_rng(1)
    lists, grades = [], []
    for i in range(400):
        grade = i % 4
        lists.append(np.r_[np.arange(100, 100 + 4 * grade), rng.integers(1000, 3000, 20)])
        grades.append(grade)
    rows = np.repeat(np.arange(400), [len(x) for x in lists])
    model = toxicity.fit_ordinal(rows, np.concatenate(lists), np.array(grades))
    assert (np.diff(model.thresholds) > 0).all()
    scores = np.array([model.weights[x].sum() for x in lists])
    expected = model.at_least(scores).sum(1)
    assert np.abs(expected - np.array(grades)).mean() < 0.4


def test_without_labels(spark):
    docs, labels = corpus(spark, 20)
    model = toxicity.train(docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.score(docs, model).collect())
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_quality_on_the_held_out_fold(spark):
    docs, labels = corpus(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = quality.quality_report(docs, labels).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    fold = [(truth[r.doc_id], r.predicted) for r in out if r.held_out and r.doc_id in truth]
    assert len(fold) > 100 and np.mean([a == b for a, b in fold]) > 0.97


def test_forest_arrays_equal_a_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.fit_forest(x, y, trees=15, depth=3)

    def walk(row):
        total = forest.base
        for t in range(15):
            node = 0
            while node < 7:
                node = 2 * node + (1 if row[forest.feature[t, node]] <= forest.limit[t, node] else 2)
            total += forest.value[t, node - 7]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(forest.score(x), [walk(r) for r in x])
    assert ((forest.score(x) > 0.5) == y).mean() > 0.95


def test_one_labelled_id_fifty_thousand_times(spark):
    docs, labels = corpus(spark, 300)
    many = spark.range(50_000).selectExpr("0L as doc_id", "concat('zounds ', id % 700) as text", "'en' as toxic")
    for label in ("toxic", "quality"):
        sample, totals = toxicity.sample_rows(docs.unionByName(many).unionByName(docs), labels, label, 100)
        rows = sample.groupBy("doc_id").count().collect()
        assert 0 < len(rows) < 200 and all(r["count"] == 1 for r in rows) and sum(totals.values()) == 300
    model, plain = (toxicity.train(d, labels) for d in (docs.unionByName(docs), docs))
    assert np.array_equal(model.weights, plain.weights)  # repeated rows weigh nothing more
