import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from matchloom.operators import features, feedback, labels, metrics, normalize, ranker, reports, retrieval, shortlist
from matchloom.plans import matching
from matchloom.sources import tables

PAIRS = "job_id string, resume_id string, retrieval_rank int, embedding_cosine double, skill_overlap_ratio double, title_overlap_ratio double, years_gap double, experience_match_flag int"


def test_groups_of_one_and_of_equals(spark):
    rows = [("one", "a", 1, 0.5, 0.5, 0.0, 1.0, 1)] + [("same", x, i, 0.3, 0.2, 0.1, -2.0, 0) for i, x in enumerate("abc", 1)]
    out = features.engineered_features(spark.createDataFrame(rows, PAIRS)).collect()
    for r in out:
        assert r.embedding_cosine_zscore_in_job == 0 and r.embedding_cosine_rank_in_job == 1 and r.ce_score_x_skill == 0
        assert r.abs_years_gap == abs(r.years_gap) and set(features.ENGINEERED_FEATURES) <= set(r.asDict())
    scaled = spark.createDataFrame(rows, PAIRS).withColumn("n", shortlist.minmax("embedding_cosine"))
    assert {r.n for r in scaled.collect()} == {1.0}


def test_labels_at_their_edges(spark):
    scores = {0.25: 1, 0.35: 2, 0.5: 3, 0.65: 4, 1.01: 0, None: 0, -0.1: 0, 0.2499: 0, 1.0: 4}
    rows = spark.createDataFrame([(s,) for s in scores], "s double").withColumn("l", labels.assign_label(F.col("s"))).collect()
    assert {r.s: r.l for r in rows} == scores


def reference_ndcg(rows, k):
    """Tied predictions share the mean gain of their places."""
    discount = [1 / math.log2(i + 2) if i < k else 0 for i in range(len(rows))]
    preds = sorted({p for p, _ in rows}, reverse=True)
    total, at = 0.0, 0
    for p in preds:
        tied = [g for q, g in rows if q == p]
        total += sum(discount[at : at + len(tied)]) * sum(tied) / len(tied)
        at += len(tied)
    return total / sum(d * g for d, g in zip(discount, sorted((g for _, g in rows), reverse=True)))


def test_metrics(spark):
    rng = random.Random(1)
    groups = {f"j{i}": [(rng.randint(0, 5) / 5, rng.randint(0, 4)) for _ in range(rng.randint(2, 25))] for i in range(12)}
    groups |= {"flat": [(0.1, 2), (0.2, 2)], "none": [(0.3, 0), (0.1, 0), (0.2, 0)]}
    rows = [(j, f"r{i:03}", p, g) for j, own in groups.items() for i, (p, g) in enumerate(own)]
    out = {r.job_id: r for r in metrics.per_job_metrics(spark.createDataFrame(rows, "job_id string, resume_id string, pred double, final_label int")).collect()}
    for j, own in groups.items():
        ordered = [g for _, _, g in sorted((-p, i, g) for i, (p, g) in enumerate(own))]
        good = [i for i, g in enumerate(ordered, 1) if g >= 1]
        for k in (5, 10):
            if len({g for _, g in own}) == 1:
                assert out[j][f"ndcg_{k}"] is None
            else:
                assert out[j][f"ndcg_{k}"] == pytest.approx(reference_ndcg(own, k), abs=2e-6)
            hits = sum(g >= 1 for g in ordered[:k])
            assert out[j][f"precision_{k}"] == pytest.approx(hits / k, abs=1e-6)
            assert out[j][f"recall_{k}"] == pytest.approx(hits / len(good) if good else 0, abs=1e-6)
        ap = sum(n / i for n, i in enumerate(good, 1)) / len(good) if good else 0
        assert out[j]["map"] == pytest.approx(ap, abs=1e-6) and out[j]["mrr"] == pytest.approx(1 / good[0] if good else 0, abs=1e-6)


def test_block_top_k_equals_the_cross_join(spark):
    rng = random.Random(2)
    jobs = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(25)], "job_id long, embedding array<float>")
    resumes = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)], "resume_id long, embedding array<float>")
    pairs = jobs.withColumnRenamed("embedding", "a").crossJoin(resumes.withColumnRenamed("embedding", "b"))
    plain = retrieval.top_k(pairs.select("job_id", "resume_id", retrieval.cosine(F.col("a"), F.col("b")).alias("embedding_cosine")), 7, "embedding_cosine")
    blocks = retrieval.topk_cosine(jobs, resumes, 7, query_block=4)
    assert {tuple(r) for r in blocks.select("job_id", "resume_id", "retrieval_rank").collect()} == {tuple(r) for r in plain.select("job_id", "resume_id", "retrieval_rank").collect()}


def test_index_finds_distant_neighbours_and_fills_every_opening(spark):
    from matchloom.operators import vector_index
    from matchloom.sources.tables import scratch_path

    rng = random.Random(5)

    def unit(near=None):
        v = [rng.gauss(0, 1) + (8 * near[i] if near else 0) for i in range(30)]
        size = math.sqrt(sum(x * x for x in v))
        return [x / size for x in v]

    vectors = [unit() for _ in range(20)]
    jobs = spark.createDataFrame([*enumerate(vectors), (99, None)], "job_id long, embedding array<float>")
    # the first three openings have twelve profiles close by, the others only distant ones; one profile comes many times
    close = [unit(v) for v in vectors[:3] for _ in range(12)]
    rows = list(enumerate(close + [unit() for _ in range(300)] + [close[0]] * 150)) + [(None, close[0]), (9999, None)]
    resumes = spark.createDataFrame(rows, "resume_id long, embedding array<float>")
    exact = {tuple(r) for r in retrieval.topk_cosine(jobs, resumes, 10).select("job_id", "resume_id").collect()}
    index, path = vector_index.fit_index(resumes, 10), scratch_path(spark, "index")
    vector_index.write_index(resumes, index, path)
    assert spark.read.parquet(path).selectExpr("sum(size(ids))").first()[0] == 486 and 1 <= index.probes <= len(index.centroids)
    # copies of one vector have equal codes and cosines, so which of them come is decided by the exact scores of those that were guessed
    copies = {i for i, v in rows if v == close[0]}
    for probes, least in ((None, 0.9), (1, 0.1)):
        index.probes = probes or index.probes
        got = [(r.job_id, r.resume_id) for r in vector_index.search_index(jobs, resumes, index, path, 10).collect()]
        assert len(got) == len(set(got)) == len(exact) == 200  # also where one cell would hold fewer than ten profiles
        found = [Counter((j, "copy" if i in copies else i) for j, i in x) for x in (got, exact)]
        assert sum((found[0] & found[1]).values()) >= least * len(exact)
    with pytest.raises(ValueError, match="no profile"):
        vector_index.fit_index(resumes.where("embedding is null"), 10)


def test_index_query_on_the_given_vectors(spark):
    from matchloom.plans import fixtures as fx

    folder = "/root/testdata/sf0.001"
    got = {(r.job_id, r.resume_id) for r in matching.topk_ivf(spark, folder).select("job_id", "resume_id").collect()}
    jobs, resumes = fx.job_vectors(spark, folder), fx.resume_vectors(spark, folder)
    exact = {(r.job_id, r.resume_id) for r in retrieval.topk_cosine(jobs, resumes, 10).collect()}
    assert len(got) == len(exact) == 10 * jobs.count() and len(got & exact) >= 0.9 * len(exact)


def test_text_relevance_in_small_blocks(spark, monkeypatch):
    from collections import Counter

    from matchloom.operators import sparse

    monkeypatch.setattr(sparse, "BLOCK_TERMS", 40)
    monkeypatch.setattr(sparse, "QUERY_BLOCK", 3)
    rng = random.Random(9)
    words = [f"w{i}" for i in range(30)]
    asked = {i: rng.choices(words, k=6) for i in range(10)} | {10: ["the"], 11: ["unseen"]}
    docs = {i: ["w0", *rng.choices(words, k=rng.randint(0, 20))] for i in range(80)}  # one term is in all of them
    n, average = len(docs) + 1, sum(map(len, docs.values())) / (len(docs) + 1)
    scores = {}
    for j, own in asked.items():
        for r, held in docs.items():
            tf = Counter(held)
            df = {t: sum(t in d for d in docs.values()) for t in own}
            parts = [math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(held) / average)) for t in set(own) if tf[t]]
            if parts:
                scores[j, r] = round(sum(parts), 4)
    jobs = spark.createDataFrame([(j, " ".join(t)) for j, t in asked.items()] + [(None, "w1")], "job_id long, text string")
    resumes = spark.createDataFrame([(r, " ".join(t)) for r, t in docs.items()] + [(99, None)], "resume_id long, text string")
    found = {(r.job_id, r.resume_id): r.text_score for r in retrieval.bm25_scores(jobs, resumes).collect()}
    assert found.keys() == scores.keys() and all(abs(found[x] - scores[x]) < 1.1e-4 for x in scores)
    best = {(r.job_id, r.resume_id) for r in retrieval.bm25_scores(jobs, resumes, k=4).collect()}
    assert best == {x for j in asked for x in sorted((x for x in found if x[0] == j), key=lambda x: (-found[x], x[1]))[:4]}
    assert retrieval.bm25_scores(jobs, resumes.limit(0)).count() == 0


def test_text_relevance_of_all_pairs(spark, monkeypatch):
    import duckdb

    from matchloom.operators import sparse

    monkeypatch.setattr(sparse, "OUT_ROWS", 150)
    folder, db = "/root/testdata/sf0.001", duckdb.connect()
    for name in ("benchmark", "documents"):
        db.execute(f"create view {name} as from '{folder}/{name}.parquet'")
    wanted = {(j, r): score for j, r, score in db.execute(matching.ORACLES["bm25_scores"]).fetchall()}
    rows = matching.bm25_scores(spark, folder).collect()
    found = {(r.job_id, r.resume_id): r.text_score for r in rows}
    assert len(rows) == len(found) and found.keys() == wanted.keys() and all(abs(found[x] - wanted[x]) < 1.1e-4 for x in wanted)
    tables = [db.execute(f"select {key}, text from {name}").fetchall() for key, name in (("item_id", "benchmark"), ("doc_id", "documents"))]
    asked, held = [{key: set(re.findall("[a-z0-9]+", (text or "").lower())) - set(retrieval.ENGLISH_STOP_WORDS) for key, text in rows} for rows in tables]
    assert found.keys() == {(j, r) for j in asked for r in held if asked[j] & held[r]}
    assert max(Counter(j for j, _ in found).values()) > 100


def test_search_by_bounds_skips_groups_and_misses_nothing(spark, monkeypatch):
    import numpy as np

    from matchloom.operators import sparse

    monkeypatch.setattr(sparse, "BLOCK_TERMS", 3000)
    monkeypatch.setattr(sparse, "GROUP", 4)
    monkeypatch.setattr(sparse, "FLOOR_BLOCKS", 1)
    rng = random.Random(12)
    items = [(i, f, [f"t{t}" for t in own], [rng.choice([0.5, 1.0, 2.0]) for _ in own]) for i in range(900) for f in (0, 1) if (own := rng.sample(range(400), rng.randint(0, 6)) + [400])]
    asked = [(q, f, [f"t{t}" for t in {*rng.sample(range(400), 5), 400}]) for q in range(40) for f in (0, 1)] + [(99, 0, ["unseen"])]
    frames = [
        spark.createDataFrame(items, "item long, field int, t array<string>, w array<double>"), spark.createDataFrame(asked, "q long, field int, t array<string>"),
    ]
    rows = [[sparse.sparse_rows(f.where(f"field = {n}"), key, n, f["t"], f["w"] if key == "item" else None) for n in (0, 1)] for f, key in zip(frames, ("item", "q"))]

    def combine(sums, counts):
        return sums[0] + 2 * (sums[1] > 0) + 0.25 * sums[1] / max(counts[1], 1), sums[0] > 0

    def search(k, report=False):
        return sparse.sparse_top_k(rows[1][0].union(rows[1][1]), rows[0][0].union(rows[0][1]), 41, 2, combine, k, key="q", item="item", report=report)

    every = {(r.q, r["item"]): r.score for r in search(None).collect()}
    held = {(i, f): dict(zip(t, w)) for i, f, t, w in items}
    wanted = {q: {f: t for p, f, t in asked if p == q} for q, *_ in asked}
    plain = {}
    for q, own in wanted.items():
        for i in range(900):
            sums = [[sum(held[i, f].get(t, 0) for t in own.get(f, []))] for f in (0, 1)]
            score, counts = combine(np.array(sums), np.array([len(own.get(f, [])) for f in (0, 1)]))
            if counts[0]:
                plain[q, i] = round(float(score[0]), 6)
    assert every == plain
    best = retrieval.top_k(search(5), 5, "score", "q", "item").collect()
    assert {(r.q, r["item"], r.score) for r in best} == {(q, i, every[q, i]) for q in wanted for _, i in sorted((-s, i) for (p, i), s in every.items() if p == q)[:5]}
    possible, scored = search(5, report=True).groupBy().sum("possible", "scored").first()
    assert 0 < scored < 0.5 * possible  # every item holds a common term, so every group could hold a hit


def test_coded_scores_equal_the_scorer(spark):
    jobs = spark.createDataFrame([(1, "Data, data ENGINEER c++"), (2, None), (3, "...")], "job_id long, job_text string")
    resumes = spark.createDataFrame([(1, "engineer of data"), (2, ""), (3, None), (4, "C"), (5, "never asked")], "resume_id long, resume_text string")
    pairs = spark.createDataFrame([(j, r) for j in (1, 2, 3) for r in (1, 2, 3, 4)] + [(1, 77)], "job_id long, resume_id long")
    got = {(r.job_id, r.resume_id): r.ce_score_raw for r in features.coded_scores(pairs, jobs, resumes).collect()}
    texts = pairs.join(jobs, "job_id").join(resumes, "resume_id")
    assert got == {(r.job_id, r.resume_id): pytest.approx(r.ce_score_raw) for r in features.scored_pairs(texts).collect()} and max(got.values()) > 0.5


def test_skills_within_in_vocabulary_blocks(spark):
    texts = spark.createDataFrame([(1, "data engineer with c++ and go"), (2, ""), (None, "go"), (4, "nothing")], "vacancy_id long, text string")
    skills = spark.createDataFrame([("go",), ("c++",), ("data eng",), ("rust",)], "skill string")
    for block in (5, 1000):
        found = {(r.vacancy_id, r.skill) for r in shortlist.skills_within(texts, skills, block).collect()}
        assert found == {(1, "go"), (1, "c++"), (1, "data eng"), (None, "go")}
    rows = [(1, "Go", "", [" Go ", "SQL"]), (2, "data eng", "x", []), (3, "Senior Poet", "", None)]
    vacancies = spark.createDataFrame(rows, "vacancy_id long, title string, description string, explicit_skills array<string>")
    jobs = skills.selectExpr("array(skill) as job_skills")
    assert {(r.vacancy_id, *r.skills) for r in shortlist.vacancy_skills_from(vacancies, jobs).collect()} == {(1, "go", "sql"), (2, "data eng"), (3, "poet", "senior")}


def test_profiles_and_fallbacks(spark):
    pool = spark.createDataFrame([("j", "a", 0.9, "hit a"), ("j", "b", 0.8, "hit b")], "job_id string, resume_id string, retrieval_score_raw double, hit_text string")
    resumes = spark.createDataFrame([("a", "own a")], "resume_id string, text string")
    with pytest.raises(ValueError, match="b"):
        retrieval.require_profiles(pool, resumes)
    retrieval.require_profiles(pool.where("resume_id = 'a'"), resumes)
    assert {(r.resume_id, r.embedding_source, r.text) for r in retrieval.with_fallback(pool, resumes, ["text"]).collect()} == {("a", "local_embedding", "own a"), ("b", "elastic_score_fallback", "hit b")}
    vectors = spark.createDataFrame([("a", [0.6, 0.8])], "resume_id string, embedding array<double>")
    out = retrieval.with_cosines(pool, spark.createDataFrame([("j", [1.0, 0.0])], "job_id string, embedding array<double>"), vectors).collect()
    assert {(r.resume_id, r.embedding_cosine, r.embedding_source) for r in out} == {("a", 0.6, "local_embedding"), ("b", 0.8, "elastic_score_fallback")}


def test_row_weights_change_the_fit(spark):
    rng = random.Random(7)
    rows = [(f"j{j}", f"r{i}", i, 4 if (x := rng.random()) > 0.5 else 0, x, 1.0) for j in range(10) for i in range(10)]
    rows += [(f"f{j}", f"r{i}", i, 0 if (x := rng.random()) > 0.5 else 4, x, 4.0) for j in range(10) for i in range(10)]  # feedback says the opposite
    pairs = spark.createDataFrame(rows, "job_id string, resume_id string, retrieval_rank int, final_label int, x double, weight double")
    plain = ranker.fit_ranker(pairs.drop("weight"), ["x"]).weights["x"]
    weighted = ranker.fit_ranker(pairs, ["x"]).weights["x"]
    assert weighted < -1 and weighted < plain - 1
    final, metadata = ranker.refit_report(pairs.where("job_id < 'f5'"), pairs.where("job_id between 'f5' and 'j4'"), pairs.where("job_id > 'j4'"), {"regParam": 0.1}, ["x"])
    assert metadata["train_jobs"] == 5 and metadata["test_rows"] == 50 and set(metadata["valid_metrics"]) == set(metadata["test_metrics"]) and metadata["weights"] == final.weights
    assert sum(metadata["label_distribution"].values()) == 200


def test_records_of_shortlists(spark):
    jobs = spark.createDataFrame([("j", "Data Engineer", "data engineer sql", ["sql", "go"], 3.0)], "job_id string, job_title string, text string, job_skills array<string>, job_years double")
    resumes = spark.createDataFrame([("a", "sql data", ["sql"], ["data engineer"], 5.0), ("b", "cook", ["rice"], ["chef"], 1.0)], "resume_id string, text string, resume_skills array<string>, resume_titles array<string>, resume_years double")
    near = spark.createDataFrame([("j", "a", 0.5), ("j", "b", 0.25), ("j", "gone", 0.1)], "job_id string, resume_id string, embedding_cosine double")
    pool = retrieval.hybrid_retrieval(near, jobs, resumes, 10)
    assert {(r.resume_id, r.retrieval_rank) for r in pool.collect()} == {("a", 1), ("b", 2), ("gone", 3)}
    vectors = spark.createDataFrame([("j", [1.0, 0.0])], "job_id string, embedding array<double>")
    model = ranker.LinearRanker({"embedding_cosine": 1.0, "years_gap": 0.5, "skill_overlap_ratio": 1.0}, {"embedding_cosine": 0.2, "years_gap": 0.0, "skill_overlap_ratio": 0.5})
    shown = shortlist.served_shortlists(pool, jobs, resumes, vectors, vectors.selectExpr("'a' as resume_id", "array(0.5d, 0.5d) as embedding"), model, 5)
    out = {r.resume_id: r for r in shortlist.candidate_records(shown, model, resumes).collect()}
    assert set(out) == {"a", "b"} and out["a"].final_rank == 1 and out["a"].score == 1.0 and out["a"].resume_text == "sql data"
    good = out["a"].explanation
    assert (good.matched_skills, good.missing_skills) == (["sql"], ["go"]) and out["b"].embedding_source == "elastic_score_fallback"
    assert [(f.feature, f.label, f.impact, f.raw_value) for f in good.top_positive_factors] == [("years_gap", "Experience Gap (Resume - Job)", 1.0, "2.0000"), ("embedding_cosine", "Semantic Similarity (Cosine)", 0.3, "0.5000")]
    assert [f.feature for f in out["b"].explanation.top_negative_factors][:1] == ["years_gap"]
    assert good.raw_feature_values["Missing Skills"] == "go" and good.raw_feature_values["Skill Overlap Count"] == "1" and good.raw_feature_values["Missing Skills Count"] == "1"


def test_cascade_of_150_and_151(spark):
    rows = [(f"j{n}", f"r{i:03}", i, i / 200, 0.0) for n in (150, 151) for i in range(n)]
    pairs = spark.createDataFrame(rows, "job_id string, resume_id string, retrieval_rank int, embedding_cosine double, skill_overlap_ratio double")
    out = features.cascade_scores(pairs, F.lit(0.9)).groupBy("job_id").agg(F.count_if(F.col("ce_score") == 0).alias("n")).collect()
    assert {r.job_id: r.n for r in out} == {"j150": 0, "j151": 1}


def test_sigmoid_only_beyond_its_range(spark):
    inside, outside = spark.createDataFrame([(0.1,), (1.0,)], "x double"), spark.createDataFrame([(-3.0,), (100.0,)], "x double")
    assert [r.x for r in features.squashed(inside, "x").collect()] == [0.1, 1.0]
    assert all(0 <= r.x <= 1 for r in features.squashed(outside, "x").collect())
    assert [r.x for r in features.squashed(outside, "x", mode="never").collect()] == [-3.0, 100.0]


def test_feedback_and_merge(spark):
    good = '{"embedding_cosine": 0.5, "skill_overlap_count": 1, "skill_overlap_ratio": 0.5, "title_overlap_ratio": 0, "years_gap": 1, "experience_match_flag": 1, "resume_years_experience": 3, "job_years_required": 2}'
    rows = [("run1", "", "", "r1", "accept", 4, good), ("run2", "v2", "", "r2", "reject", None, good), ("run3", "v3", "j3", "r3", "maybe", 1, "{bad"), ("run4", "v4", "j4", "r4", "interview", 1, None)]
    pairs = feedback.feedback_pairs(spark.createDataFrame(rows, "run_id string, vacancy_id string, existing_job_id string, resume_id string, decision string, final_rank int, feature_snapshot string"))
    assert {(r.job_id, r.resume_id, r.final_label, r.retrieval_rank) for r in pairs.collect()} == {("run1", "r1", 3, 4), ("v2", "r2", 0, 0)}
    teacher = spark.createDataFrame([("run1", "r1", 0), ("run1", "r9", 1)], "job_id string, resume_id string, final_label int")
    assert {(r.job_id, r.resume_id, r.weight) for r in feedback.merge_pairs(teacher, pairs).collect()} == {("run1", "r9", 1.0), ("run1", "r1", 4.0), ("v2", "r2", 4.0)}
    with pytest.raises(ValueError, match="20"):
        feedback.require_feedback(pairs)


def test_buckets_and_parity(spark):
    years = {0.99: "0-1y", 1.0: "1-3y", 3.0: "3-6y", 6.0: "6-10y", 10.0: "10y+", None: "unknown"}
    rows = spark.createDataFrame([(y,) for y in years], "y double").withColumn("b", reports.experience_bucket(F.col("y"))).collect()
    assert {r.y: r.b for r in rows} == years
    schema = "group_value string, candidates_total long, selection_rate double"
    two = reports.parity(spark.createDataFrame([("a", 9, 0.5), ("b", 9, 0.3), ("unknown", 9, 0.9), ("c", 4, 0.01)], schema)).first()
    assert (two.eligible_groups, two.parity_ratio, two.reference_group, two.below_threshold) == (2, 0.6, "a", True)
    for rows in ([("a", 9, 0.5)], [("a", 9, 0.0), ("b", 9, 0.0)]):
        assert reports.parity(spark.createDataFrame(rows, schema)).first().parity_ratio is None


def test_ranker(spark):
    rng = random.Random(3)
    rows = []
    for j in range(30):
        for i in range(12):
            x, z = rng.random(), rng.random()
            rows.append((f"j{j}", f"r{i}", i, min(4, int(5 * (0.8 * x + 0.2 * rng.random()))), x, z))
    pairs = spark.createDataFrame(rows, "job_id string, resume_id string, retrieval_rank int, final_label int, x double, z double")
    model = ranker.fit_ranker(pairs, ["x", "z"])
    assert model.weights["x"] > 5 * abs(model.weights["z"])
    scored = ranker.score_pairs(ranker.contributions(pairs, model), model)
    total = F.aggregate("contributions", F.col("base_value"), lambda s, c: s + c["impact"])
    assert scored.select(F.max(F.abs(total - F.col("pred")))).first()[0] < 1e-6
    assert metrics.overall_metrics(scored).first().ndcg_10 > 0.85
    with pytest.raises(ValueError, match="x"):
        ranker.score_pairs(pairs.drop("x"), model)
    space = {"regParam": [0.001, 0.5, -1.0], "elasticNetParam": [0.0, 0.5], "maxIter": [3, 8]}
    trials, best = ranker.random_search(pairs, pairs, 7, ["x", "z"], seed=3, space=space)
    assert len(trials) == 7 and best == ranker.random_search(pairs, pairs, 7, ["x", "z"], seed=3, space=space)[1]
    failed = [t for t in trials if t["regParam"] < 0]
    assert failed and all(t["metric"] is None and t["error"] for t in failed)
    for t in [t for t in trials if t not in failed][:2]:  # all trials at once give what each gives alone
        alone = ranker.fit_ranker(pairs, ["x", "z"], **{k: t[k] for k in space})
        assert t["metric"] == metrics.overall_metrics(ranker.score_pairs(pairs, alone)).first()["ndcg_10"]
    with pytest.raises(RuntimeError, match="every trial failed"):
        ranker.random_search(pairs, pairs, 2, ["x", "z"], space=space | {"regParam": [-1.0]})
    # the fit is the minimum of the weighted logistic loss with its penalty
    import numpy as np

    fitted = ranker.fit_ranker(pairs, ["x", "z"], regParam=1.0, maxIter=40)
    scales = {c: pairs.select(F.stddev_pop(c)).first()[0] for c in ("x", "z")}
    rows = ranker.training_pairs(pairs, ["x", "z"], scales).collect()
    diff, weight = np.array([r.diff for r in rows]), np.array([r.weight for r in rows])
    w = np.array([fitted.weights[c] * scales[c] for c in ("x", "z")])
    slope = -(diff * (weight / (1 + np.exp(diff @ w)))[:, None]).sum(0) / weight.sum() + 1.0 * w
    assert np.abs(slope).max() < 1e-5


def test_split_shares_no_opening(spark):
    pairs = spark.createDataFrame([(f"j{i % 408}", i) for i in range(1000)], "job_id string, resume_id int")
    out = labels.group_split(pairs)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"test": 62, "valid": 62, "train": 284}
    assert out.select("job_id").distinct().count() == 408


def test_pool_limits():
    assert retrieval.pool_limits(1000) == (20, 100) and retrieval.pool_limits(50, 30, 10) == (30, 30) and retrieval.pool_limits(5) == (5, 5)
    with pytest.raises(ValueError):
        retrieval.pool_limits(10, 31)


def test_verdict(spark):
    cases = {
        "A is best.\n**Recommendation: interview Candidate #2 first.**": "A is best\n\nRecommendation: interview Candidate #2 first.",
        "recommendation: interview 1 first": "Recommendation: interview Candidate #1 first.", "nothing  \n": "nothing", None: None,
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").withColumn("v", shortlist.verdict(F.col("t"))).collect()
    assert {r.t: r.v for r in rows} == cases


def test_tables(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "quoted"\nline', "x"), ("2", "b", None)], "job_id string, job_text string, s string")
    tables.write_table(rows, f"{tmp_path}/t", "csv")
    again = tables.read_first(spark, [f"{tmp_path}/none"], [f"{tmp_path}/t"], "openings", "job_id string, job_text string, s string")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in rows.collect()}
    with pytest.raises(FileNotFoundError, match="none.*gone"):
        tables.read_first(spark, [f"{tmp_path}/none"], [f"{tmp_path}/gone"], "openings")
    vectors = spark.createDataFrame([("1", [1.0])], "job_id string, embedding array<double>")
    with pytest.raises(ValueError, match="1 rows"):
        tables.attach_vectors(rows, vectors, "job_id")
    with pytest.raises(ValueError, match="1 to 2"):
        tables.attach_vectors(rows, vectors.unionByName(spark.createDataFrame([("2", [1.0, 2.0])], vectors.schema)), "job_id")
    first = normalize.normalize_jobs(spark.createDataFrame([("1", "x", 2), ("1", "y", 1)], "job_id string, job_title string, p int"), F.col("p")).collect()
    assert [(r.job_title, r.job_text, r.job_skills_norm, r.job_years_required) for r in first] == [("y", "y ", [], 0.0)]
    with pytest.raises(ValueError, match="repeated ids 1"):
        normalize.require_unique(spark.createDataFrame([("1",), ("1",)], "k string"), "k", "t")
    shown = spark.createDataFrame([(1, "r", 0.5)], "final_rank int, resume_id string, score double")
    cards = shown.selectExpr("'run' as run_id", "final_rank", "resume_id", "score as final_fusion_score", "score as model_score", "1 as retrieval_rank", "named_struct('a', 1) as explanation", *[f"score as {k}" for k in tables.SNAPSHOT_KEYS])
    for _ in range(2):
        tables.append_run(spark.createDataFrame([("run",)], "id string"), cards, f"{tmp_path}/runs", f"{tmp_path}/shown")
    assert spark.read.parquet(f"{tmp_path}/shown").count() == 2 and '"a":1' in spark.read.parquet(f"{tmp_path}/shown").first().explanation_json


def test_hybrid_openings_are_all_passages(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, f"passage{i}") for i in range(60)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, f"document{i}") for i in range(60, 80)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.job_id, r.resume_id) for r in matching.hybrid_retrieval(spark, str(tmp_path)).collect()}
    assert got == {(job, resume) for job in range(60) for resume in range(60, 80)}


def test_quantiles_by_narrowing(spark, monkeypatch):
    from matchloom.operators import quantiles

    monkeypatch.setattr(quantiles, "RANGES", 8)
    monkeypatch.setattr(quantiles, "FEW", 3)
    rng = random.Random(6)
    rows = [("a", rng.lognormvariate(0, 4)) for _ in range(900)] + [("b", float(rng.randint(0, 3))) for _ in range(300)] + [("c", 5.0)] * 400 + [(None, x * 1e300) for x in (-1.7, 0.0, 1.7, 1.2)]
    rows += [("a", None), ("a", float("nan")), ("none", None), ("two", 1.0), ("two", 2.0), ("one", 7.0)]
    table = spark.createDataFrame(rows, "g string, x double")
    points = [0.0, 0.1, 0.25, 0.5, 0.9, 0.95, 1.0]
    got = {(r.g, r.point): r.value for r in quantiles.exact_quantiles(table, "x", points, "g").collect()}
    exact = table.where("not isnan(x)").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, points))).alias("q")).collect()
    wanted = {(r.g, p): v for r in exact for p, v in zip(points, r.q or [])}
    assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(wanted[k], rel=1e-12) for k in wanted)
    assert quantiles.exact_quantiles(table.limit(0), "x", points, "g").count() == 0


SMALL_HEAP = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from matchloom.operators import sparse
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.autoBroadcastJoinThreshold", "-1").getOrCreate()
sparse.QUERY_BLOCK = 8
items = spark.range(20_000).select("id", F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("t"), (F.col("id") * 31 + i * i) % 5000)).alias("t"))
rows = sparse.sparse_rows(items, "id", 0, F.array_distinct("t"))
asked = sparse.sparse_rows(items.where("id < 3200").withColumnRenamed("id", "q"), "q", 0, F.array_distinct("t"))
found = sparse.sparse_top_k(asked, rows, 3200, 1, lambda sums, _: (sums[0], sums[0] > 0), 1, key="q", item="id")
print("queries answered:", found.select("q").distinct().count())
"""


def test_blocks_of_an_index_are_not_held_once_for_every_block_of_queries(tmp_path):
    import os
    import subprocess
    import sys

    (tmp_path / "search.py").write_text(SMALL_HEAP.format(root=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    settings = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 700m pyspark-shell", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    ran = subprocess.run([sys.executable, str(tmp_path / "search.py")], env=settings, capture_output=True, text=True, timeout=300, cwd=tmp_path)
    assert "queries answered: 3200" in ran.stdout, ran.stderr[-2000:]


def test_index_keeps_its_recall_in_larger_tables(spark, monkeypatch):
    import numpy as np

    from matchloom.operators import vector_index
    from matchloom.sources.tables import scratch_path

    monkeypatch.setattr(vector_index, "CODE_BLOCK", 500)
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 16)
    vectors = np.random.default_rng(4).normal(size=(6060, 64))
    vectors /= np.linalg.norm(vectors, axis=1)[:, None]
    vectors[200:260] = vectors[70]  # copies: the smaller ids come first
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, embedding array<float>")
    jobs, resumes = rows.where("id < 60").withColumnRenamed("id", "job_id").union(spark.createDataFrame([(70, vectors[70].tolist())], "job_id long, embedding array<float>")), rows.where("id >= 60").withColumnRenamed("id", "resume_id")
    index, path = vector_index.fit_index(resumes, 10), scratch_path(spark, "index")
    vector_index.write_index(resumes, index, path)
    shards = spark.read.parquet(path).selectExpr("size(ids) as n").collect()
    assert sum(r.n for r in shards) == 6000 and len(shards) <= 24  # a search meets few large parts, not each cell in many
    exact = {(r.job_id, r.resume_id, r.retrieval_rank) for r in retrieval.topk_cosine(jobs, resumes, 10, query_block=16, item_block=300).collect()}
    scores = np.round(vectors[[*range(60), 70]].astype(np.float32).astype(float) @ vectors[60:].astype(np.float32).astype(float).T, 6)
    wanted = np.argsort(-scores, axis=1, kind="stable")[:, :10] + 60
    assert exact == {(j, int(r), n + 1) for j, own in zip([*range(60), 70], wanted) for n, r in enumerate(own)}
    found = {(r.job_id, r.resume_id) for r in vector_index.search_index(jobs, resumes, index, path, 10, rescored=20).collect()}
    assert len(found) == 610 and len(found & {x[:2] for x in exact}) >= 0.9 * 610
    assert {r for j, r in found if j == 70} == {70, *range(200, 209)}


def test_ranker_writes_rows_and_no_pairs(spark, monkeypatch):
    import numpy as np

    rng, data = random.Random(8), []
    for j in range(60):
        for i in range(rng.choice([1, 2, 7, 30])):
            x, z = rng.random(), rng.random()
            data.append((None if j == 7 else j, i, i, None if rng.random() < 0.05 else min(4, int(4 * x + 2 * rng.random())), x, None if rng.random() < 0.1 else z, rng.choice([0.0, 0.5, 1.0, 2.0])))
    rows = spark.createDataFrame(data, "job_id long, resume_id long, retrieval_rank int, final_label int, x double, z double, weight double")
    sizes = []

    def spied(made, name, plain=ranker.written):
        out = plain(made, name)
        sizes.append(sum(len(c) for r in out.collect() for c in r if isinstance(c, bytes | bytearray)))
        return out

    monkeypatch.setattr(ranker, "written", spied)
    monkeypatch.setattr(ranker, "BLOCK_ROWS", 40, raising=False)
    fitted = ranker.fit_ranker(rows, ["x", "z"], regParam=0.5, maxIter=40)
    assert sum(sizes) <= len(data) * 8 * (2 + 4)  # features, gain, discount, weight, and a size for each opening
    scales = {c: rows.select(F.stddev_pop(F.coalesce(c, F.lit(0.0)))).first()[0] for c in ("x", "z")}
    pairs = ranker.training_pairs(rows, ["x", "z"], scales).collect()
    diff, weight = np.array([r.diff for r in pairs]), np.array([r.weight for r in pairs])
    w = np.array([fitted.weights[c] * scales[c] for c in ("x", "z")])
    assert np.abs(-(diff * (weight / (1 + np.exp(diff @ w)))[:, None]).sum(0) / weight.sum() + 0.5 * w).max() < 1e-5


def test_split_rows_are_worked_out_once(spark):
    for part in matching._split_rows(spark, "/root/testdata/sf0.001"):
        assert part.inputFiles() and not any("embeddings" in f for f in part.inputFiles())
