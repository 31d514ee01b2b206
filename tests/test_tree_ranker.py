import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import metrics, ranker, tree_ranker
from matchloom.operators.tree_ranker import Tree, TreeRanker

SCHEMA = "job_id string, resume_id long, retrieval_rank int, a double, b double, c double, final_label int, weight double"
COLUMNS = ["a", "b", "c"]
GAIN = [0.0, 1.0, 2.0, 4.0, 8.0]


def pairs(jobs, seed):
    """Labels that follow a and, where b is high, c: no weighted sum of the columns orders them."""
    rng = random.Random(seed)
    rows = []
    for j in range(jobs):
        for i in range(rng.randint(1, 14)):
            a, b, c = (round(rng.random(), 3) for _ in range(3))
            merit = (1 - a if b > 0.5 else a) * 4 + 0.5 * c
            rows.append((f"j{j}", i, i, a, b, c, min(4, int(merit + rng.gauss(0, 0.2)) if merit > 0 else 0), rng.choice([0.5, 1.0])))
    return [(*r[:6], max(0, r[6]), r[7]) for r in rows]


def plain_gradients(scores, gains):
    order = sorted(range(len(scores)), key=lambda i: -scores[i])
    best = sum(g / math.log2(i + 2) for i, g in enumerate(sorted(gains, reverse=True)))
    g, h = [0.0] * len(scores), [0.0] * len(scores)
    for p, q in itertools.permutations(range(len(order)), 2):
        i, j = order[p], order[q]
        if best and gains[i] > gains[j] and min(p, q) < tree_ranker.TRUNCATION:
            change = (gains[i] - gains[j]) * abs(1 / math.log2(p + 2) - 1 / math.log2(q + 2)) / best
            wrong = 1 / (1 + math.exp(scores[i] - scores[j]))
            g[i], g[j] = g[i] - wrong * change, g[j] + wrong * change
            h[i], h[j] = h[i] + wrong * (1 - wrong) * change, h[j] + wrong * (1 - wrong) * change
    return g, h


def plain_fit(rows, edges, trees, depth, rate, l2, least):
    """Scores by a fit in plain loops over all rows at once."""
    x = [r[3:6] for r in rows]
    groups = [list(g) for _, g in itertools.groupby(range(len(rows)), key=lambda i: rows[i][0])]
    scores = [0.0] * len(rows)
    for _ in range(trees):
        g, h = [0.0] * len(rows), [0.0] * len(rows)
        for own in groups:
            for i, a, b in zip(own, *plain_gradients([scores[i] for i in own], [GAIN[rows[i][6]] for i in own])):
                g[i], h[i] = a * rows[i][7], b * rows[i][7]
        leaves = [list(range(len(rows)))]
        for _ in range(depth):
            following = []
            for own in leaves:
                best = (1e-9, None)
                for f, cuts in enumerate(edges):
                    for cut in cuts:
                        sides = [[i for i in own if x[i][f] <= cut], [i for i in own if x[i][f] > cut]]
                        sums = [(sum(g[i] for i in s), sum(h[i] for i in s)) for s in [*sides, own]]
                        if all(len(s) >= least for s in sides) and all(c >= tree_ranker.LEAST_HESSIAN for _, c in sums[:2]):
                            value = sum(a * a / (c + l2) for a, c in sums[:2]) - sums[2][0] ** 2 / (sums[2][1] + l2)
                            if value > best[0] + 1e-9:
                                best = (value, sides)
                following += best[1] or [own]
            leaves = following
        for own in leaves:
            value = -rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + l2)
            for i in own:
                scores[i] += value
    return scores


def test_gradients_equal_plain_loops():
    rng = random.Random(1)
    for n in (1, 2, 7, 45):
        scores, gains = [rng.choice([0.0, 0.5, rng.random()]) for _ in range(n)], [rng.choice(GAIN) for _ in range(n)]
        got = tree_ranker.swap_gradients(np.array(scores), np.array(gains))
        for a, b in zip(got, plain_gradients(scores, gains)):
            assert np.allclose(a, b)
    assert not tree_ranker.swap_gradients(np.zeros(5), np.zeros(5))[0].any()


def test_fit_equals_a_plain_fit(spark, monkeypatch):
    monkeypatch.setattr(tree_ranker, "BLOCK_ROWS", 60)
    rows = pairs(25, 2)
    edges = [np.array([0.2, 0.4, 0.6, 0.8])] * 3
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    model = tree_ranker.fit_trees(table, COLUMNS, trees=3, depth=3, rate=0.3, least_rows=5, edges=edges)
    expected = plain_fit(rows, edges, 3, 3, 0.3, 1.0, 5)
    assert len(model.trees) == 3
    assert np.allclose(model.predict(np.array([r[3:6] for r in rows])), expected)
    scored = {(r.job_id, r.resume_id): r.pred for r in ranker.predictions(table, model).collect()}
    assert all(abs(scored[r[0], r[1]] - e) < 1e-8 for r, e in zip(rows, expected))


def test_trees_beat_the_linear_ranker(spark):
    train, valid = spark.createDataFrame(pairs(150, 3), SCHEMA), spark.createDataFrame(pairs(80, 4), SCHEMA)
    model = tree_ranker.fit_trees(train, COLUMNS, trees=12, depth=3, rate=0.3)
    found = [metrics.overall_metrics(ranker.score_pairs(valid, m)).first()["ndcg_10"] for m in (model, ranker.fit_ranker(train, COLUMNS))]
    assert found[0] > found[1] + 0.05
    # openings without positives, null labels and null cells change nothing or count as 0
    more = [("none", i, i, 0.1, 0.1, None, 0, 1.0) for i in range(5)] + [("null", 0, 0, None, None, None, None, 1.0), (None, 1, 1, 0.5, 0.5, 0.5, 4, 1.0)]
    assert ranker.score_pairs(spark.createDataFrame(more, SCHEMA), model).where("pred is null").count() == 0
    with pytest.raises(ValueError, match="missing feature columns: c"):
        ranker.score_pairs(valid.drop("c"), model)
    assert tree_ranker.fit_trees(spark.createDataFrame(more, SCHEMA), COLUMNS, trees=3).trees == []


def known(tree, x, features, node=0):
    """The tree's value where only some features are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    sides = [known(tree, x, features, child) for child in (2 * node + 1, 2 * node + 2)]
    if f in features:
        return sides[int(x[f] > tree.threshold[node])]
    return (tree.cover[2 * node + 1] * sides[0] + tree.cover[2 * node + 2] * sides[1]) / tree.cover[node]


def test_contributions_equal_enumeration(spark):
    rng = np.random.default_rng(5)
    trees = []
    for _ in range(6):  # features come again below themselves
        feature = np.r_[rng.integers(0, 4, 7), np.full(8, -1)]
        feature[rng.choice([3, 4, 5, 6])] = -1
        cover = np.zeros(15)
        cover[0] = 100
        for i in range(7):
            cover[2 * i + 1] = round(cover[i] * rng.uniform(0.1, 0.9), 3)
            cover[2 * i + 2] = cover[i] - cover[2 * i + 1]
        trees.append(Tree(feature, rng.choice([0.25, 0.5, 0.75], 15), rng.normal(size=15), cover))
    model = TreeRanker(["a", "b", "c", "d"], trees)
    x = rng.choice([0.0, 0.25, 0.3, 0.6, 0.75, 1.0], (40, 4))
    got = model.contributions(x)
    for row, own in zip(x, got):
        for j in range(4):
            rest = [i for i in range(4) if i != j]
            total = 0.0
            for n in range(4):
                for held in itertools.combinations(rest, n):
                    share = math.factorial(n) * math.factorial(3 - n) / math.factorial(4)
                    total += share * sum(known(t, row, {*held, j}) - known(t, row, set(held)) for t in trees)
            assert abs(own[j] - total) < 1e-9
    assert np.allclose(got.sum(1) + model.base, model.predict(x))
    rows = spark.createDataFrame([(str(i), i, i, *map(float, r)) for i, r in enumerate(x)], "job_id string, resume_id int, retrieval_rank int, a double, b double, c double, d double")
    explained = ranker.contributions(ranker.score_pairs(rows, model), model).collect()
    for r in explained:
        assert abs(r.base_value + sum(c.impact for c in r.contributions) - r.pred) < 1e-6 and [c.feature for c in r.contributions] == model.features
    summary = ranker.contribution_summary(ranker.contributions(rows, model))
    assert {r.feature: r.mean_impact for r in summary.collect()} == {f: pytest.approx(m, abs=1e-6) for f, m in zip(model.features, got.mean(0))}
    assert rows.select(F.sum(model.score())).first()[0] == pytest.approx(model.predict(x).sum())
