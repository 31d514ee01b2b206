"""Fused, explained shortlists for every opening, and the texts made from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import preview, strip, token_set
from matchloom.functions.vacancy import request_years
from matchloom.operators.features import BASE_FEATURES, CASCADE_TOP, cascade_text_scores, engineered_features, lexical_scorer, serving_features
from matchloom.operators.ranker import Ranker, contributions
from matchloom.operators.retrieval import with_cosines
from matchloom.operators.sparse import sparse_rows, sparse_top_k

# Fusion and proxy weights, whole-number features, verdict pattern. VOCABULARY_CHARS bounds a broadcast.
RETRIEVAL_WEIGHT, RERANKER_WEIGHT = 0.3, 0.7
SKILL_WEIGHT, TITLE_WEIGHT, TEXT_WEIGHT = 0.55, 0.25, 0.20
VOCABULARY_CHARS = 4_000_000
WHOLE_FEATURES = ("retrieval_rank", "skill_overlap_count", "experience_match_flag")
VERDICT = r"(?i)\**\s*Recommendation:\s*interview\s+(?:Candidate\s*#?\s*)?(\d)\s*(?:first)?\.?\s*\**"

# Labels of features; the descriptions are our own.
FEATURE_LABELS = {
    "ce_score_x_skill": ("Cross-Encoder x Skill Overlap", "Pair score times the share of skills."),
    "embedding_cosine": ("Semantic Similarity (Cosine)", "Cosine of both vectors."),
    "embedding_cosine_norm": ("Semantic Similarity (Normalized)", "Cosine moved to 0..1."),
    "skill_overlap_count": ("Skill Overlap Count", "Skills of the opening that the profile has."),
    "skill_overlap_ratio": ("Skill Overlap Ratio", "Share of the opening's skills that the profile has."),
    "title_overlap_ratio": ("Title Overlap Ratio", "Share of the title's words that past titles have."),
    "resume_years_experience": ("Resume Experience (Years)", "Years of experience of the profile."),
    "job_years_required": ("Job Required Experience (Years)", "Years of experience that the opening asks for."),
    "years_gap": ("Experience Gap (Resume - Job)", "Years of the profile less those asked for."),
    "experience_match_flag": ("Experience Match Flag", "1 if the years are enough."),
    "retrieval_rank": ("Retrieval Rank", "Place in the pool."),
    "log_retrieval_rank": ("Log Retrieval Rank", "Logarithm of one more than the place in the pool."),
    "abs_years_gap": ("|Experience Gap|", "Years between the profile and what is asked for."),
    "skill_overlap_x_emb": ("Skill x Semantic Similarity", "Share of skills times the moved cosine."),
    "experience_x_skill": ("Experience x Skill", "Enough years times the share of skills."),
    "title_x_emb": ("Title x Semantic Similarity", "Share of the title's words times the moved cosine."),
    "embedding_cosine_zscore_in_job": ("Semantic Similarity (Per-Job Z-Score)", "Cosine against the opening's other candidates."),
    "skill_overlap_ratio_zscore_in_job": ("Skill Overlap (Per-Job Z-Score)", "Share of skills against the opening's other candidates."),
    "title_overlap_ratio_zscore_in_job": ("Title Overlap (Per-Job Z-Score)", "Share of the title's words against the opening's other candidates."),
    "embedding_cosine_rank_in_job": ("Semantic Similarity Rank in Job", "Place among the opening's candidates by cosine."),
}


def minmax(column: str, group: str = "job_id") -> Column:
    """A score scaled to 0..1 within its opening; 1 where all are equal."""
    by = Window.partitionBy(group)
    low, high = F.min(column).over(by), F.max(column).over(by)
    return F.when(high == low, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(column) - low) / F.nullif(high - low, F.lit(0.0)))))


def fuse(rows: DataFrame, retrieval: str = "retrieval_score_raw", reranker: str = "reranker_score_raw") -> DataFrame:
    """Rows with both normalised scores, their contributions and the fused score; rows lacking a score go first."""
    whole = rows.dropna(subset=[retrieval, reranker])
    scaled = whole.withColumn("retrieval_score_norm", F.round(minmax(retrieval), 9)).withColumn("reranker_score_norm", F.round(minmax(reranker), 9))
    parts = scaled.withColumn("retrieval_part", RETRIEVAL_WEIGHT * F.col("retrieval_score_norm")).withColumn("reranker_part", RERANKER_WEIGHT * F.col("reranker_score_norm"))
    return parts.withColumn("final_fusion_score", F.round(F.col("retrieval_part") + F.col("reranker_part"), 9))


def final_order(rows: DataFrame, top_k: int) -> DataFrame:
    """final_rank by fused, reranker, retrieval score, then id; the first top_k of each opening."""
    order = Window.partitionBy("job_id").orderBy(F.desc("final_fusion_score"), F.desc("reranker_score_norm"), F.desc("retrieval_score_norm"), "resume_id")
    return rows.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k)


def run_rows(pool: DataFrame, shown: DataFrame, top_k: int, pool_size: int) -> DataFrame:
    """One row per run: how many were retrieved and returned, and the sizes asked for."""
    sizes = pool.groupBy("job_id").agg(F.count("*").alias("retrieved_count"))
    kept = shown.groupBy("job_id").agg(F.count("*").alias("returned_count"))
    return sizes.join(kept, "job_id", "left").select(
        "job_id", "retrieved_count", F.coalesce("returned_count", F.lit(0)).alias("returned_count"), F.lit(top_k).alias("top_k"), F.lit(pool_size).alias("num_candidates")
    )


def vocabulary_blocks(skills: DataFrame, block_chars: int) -> Iterator[list[str]]:
    """Distinct skills in blocks of bounded size."""
    total = skills.agg(F.sum(F.length("skill"))).first()[0] or 0
    blocks = -(-total // block_chars)
    for block in range(blocks):
        found = [r["skill"] for r in skills.where(F.pmod(F.xxhash64("skill"), F.lit(blocks)) == block).collect()]
        if found:
            yield found


def skills_within(texts: DataFrame, skills: DataFrame, block_chars: int = VOCABULARY_CHARS) -> DataFrame:
    """vacancy_id, skill: every skill that is a substring of a text. texts: vacancy_id, text; skills: skill, distinct.

    One automaton for each block of the vocabulary finds all of its skills in one pass over a text.
    """
    spark, kind = texts.sparkSession, texts.schema["vacancy_id"].dataType.simpleString()
    found = spark.createDataFrame([], f"vacancy_id {kind}, skill string")
    for block in vocabulary_blocks(skills, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for skill in shared.value:
                automaton.add_word(skill, skill)
            automaton.make_automaton()
            for batch in batches:
                rows = [(i, skill) for i, t in enumerate(batch.column(1)) for skill in sorted({s for _, s in automaton.iter(t.as_py() or "")})]
                ids = batch.column(0).take(pa.array([i for i, _ in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([s for _, s in rows], pa.string())], ["vacancy_id", "skill"])

        found = found.unionByName(texts.select("vacancy_id", "text").mapInArrow(searched, found.schema))
    return found


def vacancy_skills_from(vacancies: DataFrame, jobs: DataFrame) -> DataFrame:
    """vacancy_id, skills: the explicit list; else every skill of an opening that is a substring of the text; else title tokens.

    vacancies: vacancy_id (one row each), title, description, explicit_skills; jobs: job_skills. The distinct
    skills of all openings are the vocabulary.
    """
    explicit = F.array_sort(F.array_distinct(F.filter(F.transform("explicit_skills", lambda s: F.lower(strip(s))), lambda s: s != "")))
    asked = vacancies.withColumn("text", F.lower(F.concat_ws(" ", "title", "description"))).withColumn("explicit", explicit)
    vocabulary = jobs.select(F.explode("job_skills").alias("skill")).select(F.lower(strip(F.col("skill"))).alias("skill")).where("skill <> ''").distinct()
    open_ = asked.where(F.coalesce(F.size("explicit"), F.lit(0)) <= 0).select("vacancy_id", "text")
    found = skills_within(open_, vocabulary).groupBy("vacancy_id").agg(F.array_sort(F.collect_set("skill")).alias("found"))
    fallback = F.slice(F.array_sort(F.filter(token_set(F.col("title")), lambda t: F.length(t) > 2)), 1, 10)
    skills = F.when(F.size("explicit") > 0, F.col("explicit")).when(F.size("found") > 0, F.col("found")).otherwise(fallback)
    return asked.join(found, "vacancy_id", "left").select("vacancy_id", skills.alias("skills"))


def proxy_jobs(vacancies: DataFrame, jobs: DataFrame) -> DataFrame:
    """vacancy_id, job_id, proxy_score: the opening with most overlap of skills, title and text; ties to the smaller id.

    vacancies: vacancy_id, title, description, skills; jobs: job_id, job_title, job_description, job_skills.
    Blocks of both meet, and one opening of each block goes on; a vacancy that shares nothing takes the smallest id.
    """

    def fields(rows: DataFrame, key: str, *tokens: Column) -> DataFrame:
        return reduce(DataFrame.unionByName, [sparse_rows(rows, key, i, F.array_distinct(t)) for i, t in enumerate(tokens)])

    own = fields(vacancies, "vacancy_id", F.col("skills"), token_set(F.col("title")), token_set(F.concat_ws(" ", "title", "description")))
    theirs = fields(jobs, "job_id", F.col("job_skills"), token_set(F.col("job_title")), token_set(F.col("job_description")))

    def combined(sums: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [w * common / max(size, 1) for w, common, size in zip((SKILL_WEIGHT, TITLE_WEIGHT, TEXT_WEIGHT), sums, sizes, strict=True)]
        return parts[0] + parts[1] + parts[2], sums.sum(0) > 0

    found = sparse_top_k(own, theirs, vacancies.count(), 3, combined, 1, key="vacancy_id", item="job_id", score="proxy_score")
    best = Window.partitionBy("vacancy_id").orderBy(F.desc("proxy_score"), "job_id")
    top = found.withColumn("_turn", F.row_number().over(best)).where("_turn = 1")
    first = jobs.agg(F.min("job_id").alias("first_job"))
    return vacancies.select("vacancy_id").join(top, "vacancy_id", "left").crossJoin(F.broadcast(first)).select(
        "vacancy_id", F.coalesce("job_id", "first_job").alias("job_id"), F.coalesce("proxy_score", F.lit(0.0)).alias("proxy_score")
    )


def vacancy_openings(vacancies: DataFrame, jobs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ad-hoc vacancies as openings (job_id = vacancy_id): job_title, text, job_skills, job_years and the vector of their proxy job.

    vacancies: vacancy_id, title, description, skills; jobs as in proxy_jobs; vectors: job_id, embedding. A vacancy
    whose proxy has no vector has none either.
    """
    proxied = proxy_jobs(vacancies, jobs).join(vectors, "job_id", "left").select("vacancy_id", F.col("job_id").alias("proxy_job_id"), "embedding")
    text = F.concat_ws(" ", "title", "description")
    return vacancies.join(proxied, "vacancy_id").select(
        F.col("vacancy_id").alias("job_id"), "proxy_job_id", F.col("title").alias("job_title"), text.alias("text"), F.col("skills").alias("job_skills"), request_years(text).alias("job_years"), "embedding"
    )


def top_factors(contributions: Column, positive: bool, top: int = 3) -> Column:
    """The strongest positive or negative (feature, impact) of an array, strongest first, ties by feature."""
    sign = -1 if positive else 1
    chosen = F.filter(contributions, lambda c: c["impact"] * sign < 0)
    keyed = F.array_sort(F.transform(chosen, lambda c: F.struct((c["impact"] * sign).alias("order"), c["feature"].alias("feature"), c["impact"].alias("impact"))))
    return F.transform(F.slice(keyed, 1, top), lambda c: F.struct(c["feature"].alias("feature"), c["impact"].alias("impact")))


def feature_text(feature: str) -> Column:
    """A feature value as text: whole numbers for three features, four places for the others, n/a for null."""
    value = F.col(feature).cast("double")
    shown = F.format_string("%d", F.rint(value).cast("long")) if feature in WHOLE_FEATURES else F.format_string("%.4f", value)
    return F.when(value.isNotNull(), shown).otherwise("n/a")


def feature_values(features: list[str]) -> Column:
    """A map from feature to its text, with the missing skills and their number."""
    missing = F.coalesce(F.col("missing_skills"), F.array().cast("array<string>"))
    names = [*features, "missing_skills", "missing_skills_count"]
    texts = [feature_text(f) for f in features] + [F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise("none"), F.size(missing).cast("string")]
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*texts))


def labelled_values(features: list[str]) -> Column:
    """The map of feature_values with the features' labels as keys."""
    names = {f: FEATURE_LABELS.get(f, (f, ""))[0] for f in features}
    missing = F.coalesce(F.col("missing_skills"), F.array().cast("array<string>"))
    texts = [feature_text(f) for f in features] + [F.when(F.size(missing) > 0, F.array_join(missing, ", ")).otherwise("none"), F.size(missing).cast("string")]
    return F.map_from_arrays(F.array(*map(F.lit, [*names.values(), "Missing Skills", "Missing Skills Count"])), F.array(*texts))


def labelled_factors(contributions: Column, positive: bool, features: list[str], top: int = 3) -> Column:
    """The strongest factors as (feature, label, impact, raw_value, description). features: those that contributions may name."""
    values = F.map_from_arrays(F.array(*map(F.lit, features)), F.array(*map(feature_text, features)))
    label, description = (F.create_map(*[F.lit(x) for f in features for x in (f, FEATURE_LABELS.get(f, (f, ""))[i])]) for i in (0, 1))
    return F.transform(top_factors(contributions, positive, top), lambda c: F.struct(
        c["feature"].alias("feature"), label[c["feature"]].alias("label"), c["impact"].alias("impact"), values[c["feature"]].alias("raw_value"), description[c["feature"]].alias("description")
    ))


def candidate_records(shown: DataFrame, ranker: Ranker, resumes: DataFrame) -> DataFrame:
    """The records of shortlisted candidates: scores, their parts, base features, the profile's text and the explanation.

    shown: rows of final_order with serving features, contributions and base_value; resumes: resume_id, text.
    """
    features = list(ranker.features)
    explanation = F.struct(
        "matched_skills", "missing_skills", "experience_summary", "title_summary", F.col("base_value").alias("baseline_score"),
        labelled_factors(F.col("contributions"), True, features).alias("top_positive_factors"), labelled_factors(F.col("contributions"), False, features).alias("top_negative_factors"),
        labelled_values(list(dict.fromkeys([*BASE_FEATURES, *features]))).alias("raw_feature_values"),
    )
    texts = resumes.select("resume_id", F.coalesce("text", F.lit("")).alias("resume_text"))
    return shown.join(texts, "resume_id", "left").select(
        "job_id", "final_rank", "resume_id", "resume_text", F.col("reranker_score_raw").alias("model_score"), F.col("final_fusion_score").alias("score"), F.lit("fused_relevance").alias("score_label"),
        "retrieval_rank", "retrieval_score_raw", "retrieval_score_norm", "reranker_score_raw", "reranker_score_norm", F.lit(RETRIEVAL_WEIGHT).alias("fusion_alpha"), F.lit(RERANKER_WEIGHT).alias("fusion_beta"),
        F.col("retrieval_part").alias("retrieval_contribution"), F.col("reranker_part").alias("reranker_contribution"), "final_fusion_score",
        "embedding_cosine", "embedding_source", "skill_overlap_count", "skill_overlap_ratio", "title_overlap_ratio", "resume_years_experience", "job_years_required", "years_gap", "experience_match_flag",
        explanation.alias("explanation"),
    )


def served_shortlists(
    pool: DataFrame, jobs: DataFrame, resumes: DataFrame, job_vectors: DataFrame, resume_vectors: DataFrame, ranker: Ranker, top_k: int,
    scorer: Callable[[Column, Column], Column] = lexical_scorer, scored: int = CASCADE_TOP,
) -> DataFrame:
    """Every opening's shortlist from its pool, as one job: cosines, serving features, pair scores of the gate's best,
    features within the opening, the ranker's score and contributions, fusion, order; the first top_k.

    pool: job_id, resume_id, retrieval_score_raw, retrieval_rank; jobs: job_id, job_title, text, job_skills, job_years;
    resumes: resume_id, text, resume_skills, resume_titles, resume_years. Pool rows without a profile are left out.
    """
    job_fields = jobs.select("job_id", "job_skills", token_set(F.col("job_title")).alias("job_title_tokens"), "job_years")
    resume_fields = resumes.select("resume_id", "resume_skills", token_set(F.array_join("resume_titles", " ")).alias("resume_title_tokens"), "resume_years")
    base = serving_features(with_cosines(pool, job_vectors, resume_vectors), job_fields, resume_fields)
    texts = jobs.select("job_id", F.col("text").alias("job_text")), resumes.select("resume_id", F.col("text").alias("resume_text"))
    made = engineered_features(cascade_text_scores(base, *texts, scorer, scored))
    ranked = contributions(made.withColumn("reranker_score_raw", F.round(ranker.score(), 9)), ranker)
    return final_order(fuse(ranked), top_k)


def candidate_block() -> Column:
    """The card of one candidate for a prompt; lines without a value are left out."""

    def line(text: Column, value: Column) -> Column:
        return F.when(value.isNotNull(), text)

    def listed(title: str, items: str, n: int) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(f"  {title}: "), F.array_join(F.slice(items, 1, n), ", ")))

    years = F.when(F.col("job_years_required").isNotNull(), F.col("resume_years_experience"))
    return F.concat_ws(
        "\n", F.format_string("Candidate #%d  (score: %.1f%%)", F.col("final_rank").cast("int"), F.col("final_fusion_score") * 100),
        line(F.format_string("  Experience: %.1f yrs  (required: %.1f yrs)", "resume_years_experience", "job_years_required"), years),
        line(F.format_string("  Skill coverage: %.0f%%", F.col("skill_overlap_ratio") * 100), F.col("skill_overlap_ratio")),
        listed("Matched skills", "matched_skills", 8), listed("Missing skills", "missing_skills", 6),
        F.when(F.coalesce("experience_summary", F.lit("")) != "", F.concat(F.lit("  "), F.col("experience_summary"))),
        listed("Strengths", "strengths", 3), listed("Weaknesses", "weaknesses", 2),
    )


TASKS = {
    "explain": (
        "Top {n} candidates (independent assessment for each):",
        "For each of the {n} candidates write one paragraph: what they have, what is missing for the vacancy, and one suggestion to improve or verify. "
        "Start every paragraph with the label \"Candidate #N:\". Do not compare candidates.",
    ),
    "compare": (
        "Top {n} candidates to compare head-to-head:",
        "Compare these {n} candidates against the vacancy. Name the best match and why, then the second best. "
        "Finish with exactly this line:\nRecommendation: interview Candidate #N first.",
    ),
}


def prompts(candidates: DataFrame, mode: str, top: int = 3) -> DataFrame:
    """run_id, prompt: the vacancy and the cards of a run's first candidates. candidates: run_id, job_title, job_description, and the card's columns."""
    heading, task = (F.lit(t) for t in TASKS[mode])
    cards = candidates.where(F.col("final_rank") <= top).withColumn("card", candidate_block())
    runs = cards.groupBy("run_id").agg(
        F.min("job_title").alias("job_title"), F.min("job_description").alias("job_description"), F.count("*").cast("string").alias("n"),
        F.array_sort(F.collect_list(F.struct("final_rank", "card"))).alias("cards"),
    )
    body = F.array_join(F.transform("cards", lambda c: c["card"]), "\n\n")
    about = F.concat(F.lit("Vacancy: "), F.col("job_title"), F.lit("\nDescription: "), strip(F.substring(F.coalesce("job_description", F.lit("")), 1, 400)))
    return runs.select("run_id", F.array_join(F.array(about, F.replace(heading, F.lit("{n}"), "n"), body, F.replace(task, F.lit("{n}"), "n")), "\n\n").alias("prompt"))


def verdict(text: Column) -> Column:
    """A comparison text that ends with one canonical recommendation line, of the last candidate it names."""
    digit = F.try_element_at(F.regexp_extract_all(text, F.lit(VERDICT), F.lit(1)), F.lit(-1))
    body = F.regexp_replace(F.regexp_replace(text, VERDICT, ""), r"[ \t\n*.]+$", "")
    body = F.regexp_replace(body, r"\s+$", "")
    line = F.concat(F.lit("Recommendation: interview Candidate #"), digit, F.lit(" first."))
    ended = F.when(body != "", F.concat(body, F.lit("\n\n"), line)).otherwise(line)
    return F.when(digit.isNull(), F.regexp_replace(text, r"\s+$", "")).otherwise(ended)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def job_preview(text: Column) -> Column:
    return preview(text, 220)
