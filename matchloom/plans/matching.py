"""Queries on retrieval, pair features, labels, metrics, the ranker and shortlists, with their SQL."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions.text import title_tokens, token_set
from matchloom.operators import features, labels, metrics, ranker, retrieval, shortlist, tree_ranker, vector_index
from matchloom.operators.tree_ranker import Tree, TreeRanker
from matchloom.plans import fixtures as fx
from matchloom.plans import texts
from matchloom.sources import tables

QUERIES, ORACLES = {}, {}
RETRIEVAL_SQL = "(1 + embedding_cosine) / 2"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


TOPK_SQL = f"with {fx.COSINE_SQL} select job_id, resume_id, embedding_cosine, retrieval_rank from nearest"


@query("topk_cosine", TOPK_SQL)
def topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest profiles of every opening, by blocks."""
    return retrieval.topk_cosine(fx.job_vectors(spark, sf_dir), fx.resume_vectors(spark, sf_dir), fx.POOL)


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, vector_index.VectorIndex, str]:
    """The ten profiles of every opening by the inverted-file index, the index and its path."""
    jobs, resumes = fx.job_vectors(spark, sf_dir), fx.resume_vectors(spark, sf_dir)
    index, path = vector_index.fit_index(resumes, 10), tables.scratch_path(spark, "vector-index")
    vector_index.write_index(resumes, index, path)
    return vector_index.search_index(jobs, resumes, index, path, 10), index, path


@query("topk_ivf")
def topk_ivf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approximate nearest profiles of every opening, by cells and codes."""
    return _indexed(spark, sf_dir)[0]


QUERIES["topk_lsh"] = topk_ivf  # the name of the approximate search before it had an index


@query("ivf_recall", """select (select count(*) from embeddings where vec_id % 10 = 0) as openings, 10 * (select count(*) from embeddings where vec_id % 10 = 0) as rows,
    true as recall_from_90, 8 * 10.0 / (select count(*) from embeddings where vec_id % 10 <> 0) < 0.3 as vectors_read_below_30""")
def ivf_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index against the exact search: every opening has its ten rows, recall reaches 0.9, and few profiles are scored exactly."""
    found, index, path = _indexed(spark, sf_dir)
    exact = retrieval.topk_cosine(fx.job_vectors(spark, sf_dir), fx.resume_vectors(spark, sf_dir), 10)
    report = vector_index.index_report(tables.written(found, "found"), exact, index, path, vector_index.RESCORED * 10)
    return report.select("openings", "rows", (F.col("recall") >= 0.9).alias("recall_from_90"), (F.col("vectors_read") < 0.3).alias("vectors_read_below_30"))


STOP = ", ".join(f"'{w}'" for w in retrieval.ENGLISH_STOP_WORDS)
def bm25_sql(jobs: str = "jobs") -> str:
    return f"""docs as (select resume_id, list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t not in ({STOP})) as terms from resumes),
asked as (select distinct job_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: t not in ({STOP}))) as term from {jobs}),
size as (select count(*) as n, avg(len(terms)) as avg_length from docs),
postings as (select resume_id, len(terms) as length, unnest(terms) as term from docs),
tf as (select term, resume_id, count(*) as tf, any_value(length) as length from postings group by term, resume_id),
df as (select term, count(*) as df from tf group by term),
text_scores as (select job_id, resume_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 4) as text_score
    from asked join tf using (term) join df using (term), size group by job_id, resume_id)"""


BM25_SQL = bm25_sql()


@query("bm25_scores", f"with {fx.TEXT_SQL}, {BM25_SQL} select * from text_scores")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text relevance of every pair of opening and profile that shares a term."""
    return retrieval.bm25_scores(fx.text_jobs(spark, sf_dir), fx.text_resumes(spark, sf_dir))


_DOT = "round(list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1]::double * p[2]::double)), 6)"


def pool_sql(jobs: str = "jobs") -> str:
    """pool of openings (CTEs {jobs} and job_vec: job_id, embedding), over the vectors of profiles (rv)."""
    return f"""{bm25_sql(jobs)},
title_df as (select t, count(*) as df from (select unnest(resume_titles) as t from resumes) group by t),
clauses as (select job_id, resume_id, 0.5 * text_score + case when len(list_intersect(job_skills, resume_skills)) > 0 then 0.5 else 0 end
    + case when list_contains(resume_titles, job_title) then 0.25 * ln(1 + (n - df + 0.5) / (df + 0.5)) else 0 end as clause_score
    from text_scores join {jobs} using (job_id) join resumes using (resume_id) left join title_df on t = job_title, size),
rv as (select vec_id as resume_id, embedding from embeddings where vec_id not in (select item_id from benchmark)),
vec as (select job_id, resume_id, {_DOT.format(a="job_vec.embedding", b="rv.embedding")} as embedding_cosine from job_vec, rv where job_vec.embedding is not null
    qualify row_number() over (partition by job_id order by embedding_cosine desc, resume_id) <= 100),
both_ as (select coalesce(v.job_id, c.job_id) as job_id, coalesce(v.resume_id, c.resume_id) as resume_id,
    round(coalesce((1 + embedding_cosine) / 2, 0) + coalesce(clause_score, 0), 8) as retrieval_score_raw
    from vec v full outer join clauses c on v.job_id = c.job_id and v.resume_id = c.resume_id),
pool as (select *, row_number() over (partition by job_id order by retrieval_score_raw desc, resume_id)::int as retrieval_rank from both_ qualify retrieval_rank <= 100)"""


BENCHMARK_VECTORS_SQL = "job_vec as (select vec_id as job_id, embedding from embeddings where vec_id in (select item_id from benchmark))"
HYBRID_SQL = f"with {fx.TEXT_SQL}, {BENCHMARK_VECTORS_SQL}, {pool_sql()} select * from pool"


def _hybrid_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Vectors with the number of a passage are openings', the others profiles'."""
    vectors = fx.table(spark, sf_dir, "embeddings")
    passages = fx.table(spark, sf_dir, "benchmark").selectExpr("item_id as vec_id")
    asked, others = vectors.join(passages, "vec_id", "left_semi"), vectors.join(passages, "vec_id", "left_anti")
    return asked.selectExpr("vec_id as job_id", "embedding"), others.selectExpr("vec_id as resume_id", "embedding")


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profiles with their derived fields, worked out once."""
    return tables.written(fx.text_resumes(spark, sf_dir), "profiles")


@query("hybrid_retrieval", HYBRID_SQL)
def hybrid_retrieval(spark: SparkSession, sf_dir: str, resumes: DataFrame | None = None) -> DataFrame:
    asked, others = _hybrid_vectors(spark, sf_dir)
    near = retrieval.topk_cosine(asked, others, 100)
    return retrieval.hybrid_retrieval(near, fx.text_jobs(spark, sf_dir), fx.text_resumes(spark, sf_dir) if resumes is None else resumes, 100)


@query("pool_missing_ids", f"with {fx.COSINE_SQL} select distinct resume_id from nearest where resume_id not in (select doc_id from documents where doc_id % 3 <> 0)")
def pool_missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.missing_profiles(topk_cosine(spark, sf_dir), fx.table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").selectExpr("doc_id as resume_id"))


NOISE = "('sr', 'jr', 'the', 'a', 'an', 'of', 'and', 'to', 'in', 'at', 'i', 'ii')"
TEXT_PAIRS_SQL = f"""text_pairs as (select job_id, resume_id, row_number() over (partition by job_id order by text_score desc, resume_id)::int as retrieval_rank, text_score as embedding_cosine from text_scores qualify retrieval_rank <= 20)"""


def _text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = retrieval.bm25_scores(fx.text_jobs(spark, sf_dir), fx.text_resumes(spark, sf_dir), k=20)
    return retrieval.top_k(best, 20, "text_score").withColumnRenamed("text_score", "embedding_cosine")


def _fields(spark: SparkSession, sf_dir: str, serving: bool) -> tuple[DataFrame, DataFrame]:
    tokens = token_set if serving else title_tokens
    jobs = fx.text_jobs(spark, sf_dir).select("job_id", "job_skills", tokens(F.col("job_title")).alias("job_title_tokens"), "job_years")
    return jobs, fx.text_resumes(spark, sf_dir).select("resume_id", "resume_skills", tokens(F.array_join("resume_titles", " ")).alias("resume_title_tokens"), "resume_years")


@query("pair_features_train", f"""with {fx.TEXT_SQL}, {BM25_SQL}, {TEXT_PAIRS_SQL},
    f as (select p.*, len(list_intersect(job_skills, resume_skills))::int as n, len(job_skills) as js, job_years, resume_years,
        list_distinct(list_filter(regexp_extract_all(job_title, '[a-z0-9+#]+'), lambda t: length(t) > 1 and t not in {NOISE})) as a,
        list_distinct(list_filter(regexp_extract_all(resume_titles[1], '[a-z0-9+#]+'), lambda t: length(t) > 1 and t not in {NOISE})) as b
        from text_pairs p join jobs using (job_id) join resumes using (resume_id))
    select job_id, resume_id, retrieval_rank, embedding_cosine, n as skill_overlap_count, round(case when js > 0 then n / js else 0 end, 4) as skill_overlap_ratio,
        round(case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0 end, 4) as title_overlap_ratio, round(resume_years - job_years, 2) as years_gap,
        case when resume_years >= job_years then 1 else 0 end as experience_match_flag, resume_years as resume_years_experience, job_years as job_years_required from f""")
def pair_features_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.training_features(_text_pairs(spark, sf_dir), *_fields(spark, sf_dir, False))


@query("pair_features_serve", f"""with {fx.TEXT_SQL}, {BM25_SQL}, {TEXT_PAIRS_SQL},
    f as (select p.*, job_skills, resume_skills, len(list_intersect(job_skills, resume_skills))::int as n, job_years, resume_years, resume_years - job_years as gap,
        list_distinct(list_filter(string_split(job_title, ' '), lambda t: t <> '')) as a, list_distinct(list_filter(string_split(resume_titles[1], ' '), lambda t: t <> '')) as b
        from text_pairs p join jobs using (job_id) join resumes using (resume_id)),
    g as (select *, case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0 end as t from f)
    select job_id, resume_id, retrieval_rank, embedding_cosine, n as skill_overlap_count, n / greatest(len(job_skills), 1) as skill_overlap_ratio, t as title_overlap_ratio,
        gap as years_gap, case when gap >= 0 then 1 else 0 end as experience_match_flag, resume_years as resume_years_experience, job_years as job_years_required,
        list_sort(list_intersect(job_skills, resume_skills))[1:10] as matched_skills, list_sort(list_filter(job_skills, lambda s: not list_contains(resume_skills, s)))[1:10] as missing_skills,
        case when gap >= 0 then printf('Meets required experience (+%.2f years).', gap) else printf('Below required experience (%.2f years).', gap) end as experience_summary,
        printf('Title overlap ratio %.2f.', t) as title_summary from g""")
def pair_features_serve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.serving_features(_text_pairs(spark, sf_dir), *_fields(spark, sf_dir, True))


def _z(c: str) -> str:
    return f"case when max({c}) over w = min({c}) over w then 0 else coalesce(({c} - avg({c}) over w) / nullif(stddev_samp({c}) over w, 0), 0) end"


ENGINEERED = {
    "ce_score_x_skill": "ce_score * skill_overlap_ratio", "embedding_cosine_norm": "nm", "embedding_cosine_squared": "embedding_cosine * embedding_cosine", "log_retrieval_rank": "ln(1 + retrieval_rank)",
    "retrieval_rank_inv": "1 / (retrieval_rank + 1)", "is_top5_retrieval": "(retrieval_rank <= 5)::int", "is_top10_retrieval": "(retrieval_rank <= 10)::int", "abs_years_gap": "abs(years_gap)",
    "years_gap_squared": "years_gap * years_gap", "skill_overlap_x_emb": "skill_overlap_ratio * nm", "experience_x_skill": "experience_match_flag * skill_overlap_ratio", "experience_x_emb": "experience_match_flag * nm",
    "title_x_emb": "title_overlap_ratio * nm", "skill_x_title": "skill_overlap_ratio * title_overlap_ratio", **{f"{c}_zscore_in_job": _z(c) for c in features.RANKED},
    "embedding_cosine_rank_in_job": "r1", "skill_overlap_rank_in_job": "r2", "title_overlap_rank_in_job": "r3", "combined_rank_in_job": "(r1 + r2 + r3) / 3",
}
ENGINEERED_SQL = f"""with {fx.LABELLED_SQL}, n as (select *, greatest(0, least(1, (embedding_cosine + 1) / 2)) as nm,
    (rank() over (partition by job_id order by embedding_cosine desc))::double as r1, (rank() over (partition by job_id order by skill_overlap_ratio desc))::double as r2,
    (rank() over (partition by job_id order by title_overlap_ratio desc))::double as r3 from labelled)
select job_id, resume_id, {", ".join(f"({sql})::float as {c}" for c, sql in ENGINEERED.items())} from n window w as (partition by job_id)"""


def engineered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.engineered_features(fx.labelled(spark, sf_dir))


@query("engineered_features", ENGINEERED_SQL)
def engineered_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engineered(spark, sf_dir).select("job_id", "resume_id", *features.ENGINEERED_FEATURES)


@query("cascade_scores", f"""with {fx.PAIRS_SQL}, g as (select *, row_number() over (partition by job_id order by round(embedding_cosine + 0.5 * skill_overlap_ratio, 6) desc, retrieval_rank, resume_id) as turn from pairs)
    select job_id, resume_id, turn <= 20 as to_score, case when turn <= 20 then ce_score_raw else 0 end as ce_score from g""")
def cascade_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.cascade_scores(fx.pairs(spark, sf_dir), F.col("ce_score_raw"), top=20).select("job_id", "resume_id", "to_score", "ce_score")


@query("sigmoid_scores", f"with {fx.PAIRS_SQL}, s as (select *, 4 * ce_score_raw - 1 as x from pairs) select job_id, resume_id, round(case when (select min(x) < -0.01 or max(x) > 1.01 from s) then 1 / (1 + exp(-x)) else x end, 5) as x from s")
def sigmoid_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.pairs(spark, sf_dir).select("job_id", "resume_id", (4 * F.col("ce_score_raw") - 1).alias("x"))
    return features.squashed(raw, "x").withColumn("x", F.round("x", 5))


@query("group_sizes", f"with {fx.PAIRS_SQL} select job_id, count(*) as rows from pairs group by job_id")
def group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.group_sizes(fx.pairs(spark, sf_dir))


def _token_set_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({text}), '[^a-zA-Z0-9_]+'), lambda w: w <> ''))"


LEXICAL_SQL = "case when len(ja) > 0 and len(ra) > 0 then len(list_intersect(ja, ra)) / sqrt(len(ja)::double * len(ra)) else 0 end"


@query("lexical_scores", f"""with {fx.TEXT_SQL}, {BM25_SQL}, {TEXT_PAIRS_SQL}, t as (select p.job_id, p.resume_id, {_token_set_sql("j.text")} as ja, {_token_set_sql("r.text")} as ra
    from text_pairs p join jobs j using (job_id) join resumes r using (resume_id)) select job_id, resume_id, round({LEXICAL_SQL}, 6) as ce_score_raw from t""")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text pairs through the default scorer."""
    pairs = tables.written(_text_pairs(spark, sf_dir), "pairs")
    scored = features.coded_scores(pairs, fx.text_jobs(spark, sf_dir).selectExpr("job_id", "text as job_text"), fx.text_resumes(spark, sf_dir).selectExpr("resume_id", "text as resume_text"))
    return scored.select("job_id", "resume_id", F.round("ce_score_raw", 6).alias("ce_score_raw"))


L = f"with {fx.LABELLED_SQL}"
SPAN = "span as (select job_id, min(final_label) as label_min, max(final_label) as label_max, count(distinct final_label) as label_kinds, max(final_label) >= 3 and min(final_label) <= 1 as trainable from labelled group by job_id)"


@query("labels", f"{L} select job_id, resume_id, ce_score, final_label, within_job_rank from labelled")
def label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.labelled(spark, sf_dir).select("job_id", "resume_id", "ce_score", "final_label", "within_job_rank")


@query("trainable_pairs", f"{L}, {SPAN} select job_id, resume_id, final_label from labelled join span using (job_id) where trainable")
def trainable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.trainable_pairs(label_rows(spark, sf_dir)).select("job_id", "resume_id", "final_label")


@query("degenerate_report", f"""{L}, {SPAN}, s as (select span.*, n from span join (select job_id, count(*) as n from labelled group by job_id) using (job_id))
    select count(*) as jobs, count(*) filter (label_max < 3) as no_positive, count(*) filter (label_min > 1) as no_negative, count(*) filter (label_kinds = 1) as single_label,
    count(*) filter (trainable) as trainable, round(100.0 * sum(case when trainable then n else 0 end) / sum(n), 2)::double as rows_kept_percent from s""")
def degenerate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.degenerate_report(label_rows(spark, sf_dir))


@query("label_distribution", f"{L} select final_label, count(*) as rows, round(100.0 * count(*) / (select count(*) from labelled), 2)::double as percent from labelled group by final_label")
def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_distribution(label_rows(spark, sf_dir))


@query("score_summary", f"""{L} select count(ce_score) as rows, round(avg(ce_score), 6) as mean, round(stddev_samp(ce_score), 6) as std, min(ce_score) as min,
    {", ".join(f"round(quantile_cont(ce_score, 0.{p}), 6) as p{p}" for p in (10, 25, 50, 75, 90))}, max(ce_score) as max from labelled""")
def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.summary(label_rows(spark, sf_dir), "ce_score")


@query("label_spread", f"""{L}, j as (select min(final_label) as a, max(final_label) as b, avg(final_label) as c, count(distinct final_label) as d from labelled group by job_id)
    select round(avg(a), 6) as mean_min, round(avg(b), 6) as mean_max, round(avg(c), 6) as mean_mean, round(avg(d), 6) as mean_kinds from j""")
def label_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_spread(label_rows(spark, sf_dir))


@query("label_spread_summary", f"""{L}, j as (select min(final_label) as min_label, max(final_label) as max_label, avg(final_label) as mean_label, count(distinct final_label) as label_kinds from labelled group by job_id),
    l as (unpivot (select min_label::double as min_label, max_label::double as max_label, mean_label::double as mean_label, label_kinds::double as label_kinds from j) on min_label, max_label, mean_label, label_kinds into name feature value value)
    select feature, count(*) as rows, round(avg(value), 3) as mean, round(stddev_samp(value), 3) as std, round(min(value), 3) as min, round(quantile_cont(value, 0.25), 3) as p25,
    round(quantile_cont(value, 0.5), 3) as p50, round(quantile_cont(value, 0.75), 3) as p75, round(max(value), 3) as max from l group by feature""")
def label_spread_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_spread_summary(label_rows(spark, sf_dir))


@query("pair_summary", f"""with {fx.PAIRS_SQL}, n as (select count(*) as n from pairs group by job_id)
    select (select min(n) from n) as pairs_min, (select max(n) from n) as pairs_max, (select median(n) from n) as pairs_median, round(avg(embedding_cosine), 6) as mean_embedding_cosine,
    round(avg(skill_overlap_ratio), 6) as mean_skill_overlap_ratio, round(avg(title_overlap_ratio), 6) as mean_title_overlap_ratio, round(avg(years_gap), 6) as mean_years_gap from pairs""")
def pair_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.pair_summary(fx.pairs(spark, sf_dir))


SUMMARISED = ["embedding_cosine", "skill_overlap_count", "skill_overlap_ratio", "title_overlap_ratio", "years_gap", "experience_match_flag"]


@query("feature_summary", f"with {fx.PAIRS_SQL}, " + "l as (" + " union all ".join(f"select '{c}' as feature, {c}::double as value from pairs" for c in SUMMARISED) + """)
    select feature, count(*) as rows, round(avg(value), 3) as mean, round(stddev_samp(value), 3) as std, round(min(value), 3) as min, round(quantile_cont(value, 0.25), 3) as p25,
    round(quantile_cont(value, 0.5), 3) as p50, round(quantile_cont(value, 0.75), 3) as p75, round(max(value), 3) as max from l group by feature""")
def feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.feature_summary(fx.pairs(spark, sf_dir), SUMMARISED)


@query("usable_pairs", f"""{L}, u as (select * from labelled where resume_id % 9 <> 0 and job_id % 20 <> 10 or (job_id % 20 = 10 and final_label = 0)),
    k as (select job_id from u group by job_id having count(distinct final_label) >= 2) select job_id, resume_id, final_label from u where job_id in (select job_id from k)""")
def usable_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a ranker can be fitted on; some labels are lacking, and every second opening has but one."""
    kept = F.expr("case when (resume_id % 9 <> 0 and job_id % 20 <> 10) or (job_id % 20 = 10 and final_label = 0) then final_label end")
    return labels.usable_pairs(label_rows(spark, sf_dir).withColumn("final_label", kept)).select("job_id", "resume_id", "final_label")


@query("sample_jobs", f"{L}, c as (select job_id from (select distinct job_id from labelled) order by md5('42|' || job_id), job_id limit 3) select job_id, resume_id, ce_score, within_job_rank from labelled where job_id in (select job_id from c) and within_job_rank <= 10")
def sample_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.sample_jobs(label_rows(spark, sf_dir)).select("job_id", "resume_id", "ce_score", "within_job_rank")


@query("missing_text", f"""with {fx.PAIRS_SQL}, p as (select *, case when resume_id % 9 = 0 then null else ce_score_raw end as s from pairs)
    select count(*) as pairs, count(*) filter (s is null) as unscored, count(*) filter (coalesce(b.text, '') = '') as no_job_text, count(*) filter (coalesce(d.text, '') = '') as no_resume_text,
    count(*) filter (s is null) = 0 as reuse_scores from p left join benchmark b on b.item_id = p.job_id left join documents d on d.doc_id = p.resume_id""")
def missing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.pairs(spark, sf_dir).withColumn("ce_score_raw", F.when(F.col("resume_id") % 9 != 0, F.col("ce_score_raw")))
    return labels.missing_texts(rows, fx.table(spark, sf_dir, "benchmark").selectExpr("item_id as job_id", "text as job_text"), fx.table(spark, sf_dir, "documents").selectExpr("doc_id as resume_id", "text as resume_text"))


SPLIT_SQL = """r as (select job_id, row_number() over (order by md5('42|' || job_id), job_id) as k, count(*) over () as n from (select distinct job_id from labelled)),
splits as (select job_id, case when k <= ceil(round(n * 0.15, 9)) then 'test' when k <= ceil(round(n * 0.15, 9)) + ceil(round((n - ceil(round(n * 0.15, 9))) * (0.15::double / 0.85::double), 9)) then 'valid' else 'train' end as split from r)"""


@query("group_split", f"{L}, {SPLIT_SQL} select * from splits")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.group_split(label_rows(spark, sf_dir))


@query("split_summary", f"{L}, {SPLIT_SQL} select split, count(*) as rows, count(distinct job_id) as jobs from labelled join splits using (job_id) group by split")
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_rows(spark, sf_dir)
    return labels.split_summary(rows, labels.group_split(rows))


def _disc(place: str, k: int) -> str:
    return f"case when {place} <= {k} then 1 / log2({place} + 1) else 0 end"


def _ndcg_sql(rows: str) -> str:
    ks = metrics.CUTOFFS
    return f"""pl as (select *, row_number() over (partition by job_id order by pred desc, resume_id) as pos, row_number() over (partition by job_id order by final_label desc, resume_id) as ideal from {rows}),
    ti as (select job_id, pred, avg(final_label) as g, min(final_label) as lo, max(final_label) as hi, {", ".join(f"sum({_disc('pos', k)}) as d{k}, sum(final_label * {_disc('ideal', k)}) as i{k}" for k in ks)} from pl group by job_id, pred),
    nd as (select job_id, {", ".join(f"case when max(hi) > min(lo) then round(sum(g * d{k}) / sum(i{k}), 6) end as ndcg_{k}" for k in ks)} from ti group by job_id),
    ps as (select *, (final_label >= 1)::int as rel, sum((final_label >= 1)::int) over (partition by job_id order by pred desc, resume_id rows unbounded preceding) as seen from pl),
    hi as (select job_id, count(*) as rows, {", ".join(f"round(sum(case when pos <= {k} then rel else 0 end) / {k}, 6) as precision_{k}, round(coalesce(sum(case when pos <= {k} then rel else 0 end) / nullif(sum(rel), 0), 0), 6) as recall_{k}" for k in ks)},
        round(coalesce(sum(case when rel = 1 then seen / pos end) / nullif(sum(rel), 0), 0), 6) as map, round(coalesce(1 / min(case when rel = 1 then pos end), 0), 6) as mrr from ps group by job_id)"""


@query("ndcg", f"{L}, {_ndcg_sql('labelled')} select * from nd")
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(fx.labelled(spark, sf_dir))


@query("precision_recall_map_mrr", f"{L}, {_ndcg_sql('labelled')} select * from hi")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.hits(fx.labelled(spark, sf_dir))


@query("per_job_metrics", f"{L}, {_ndcg_sql('labelled')} select hi.*, nd.* exclude (job_id) from hi join nd using (job_id)")
def per_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_job_metrics(fx.labelled(spark, sf_dir))


MEANS = ", ".join(f"round(coalesce(avg({m}), 0), 6) as {m}" for m in [f"{m}_{k}" for m in ("ndcg", "precision", "recall") for k in metrics.CUTOFFS] + ["map", "mrr"])


@query("overall_metrics", f"{L}, {_ndcg_sql('labelled')} select {MEANS}, count(*) as groups, sum(rows)::bigint as rows from hi join nd using (job_id)")
def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.overall_metrics(fx.labelled(spark, sf_dir))


FUSED_SQL = f"""{L}, f as (select *, {RETRIEVAL_SQL} as ret, pred as rer from labelled),
m as (select *, round(case when max(ret) over w = min(ret) over w then 1 else (ret - min(ret) over w) / (max(ret) over w - min(ret) over w) end, 9) as rn,
    round(case when max(rer) over w = min(rer) over w then 1 else (rer - min(rer) over w) / (max(rer) over w - min(rer) over w) end, 9) as pn from f window w as (partition by job_id)),
s as (select *, round(0.3 * rn + 0.7 * pn, 9) as fused from m),
short as (select *, row_number() over (partition by job_id order by fused desc, pn desc, rn desc, resume_id)::int as final_rank from s qualify final_rank <= 20)"""


def _shortlisted(spark: SparkSession, sf_dir: str, scored: DataFrame | None = None) -> DataFrame:
    rows = fx.labelled(spark, sf_dir) if scored is None else scored
    rows = rows.withColumn("retrieval_score_raw", F.expr(RETRIEVAL_SQL)).withColumn("reranker_score_raw", F.col("pred"))
    return shortlist.final_order(shortlist.fuse(rows), 20)


@query("fused_shortlist", f"{FUSED_SQL} select job_id, resume_id, final_rank, round(fused, 6) as final_fusion_score, round(rn, 6) as retrieval_score_norm, round(pn, 6) as reranker_score_norm from short")
def fused_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("final_fusion_score", "retrieval_score_norm", "reranker_score_norm")
    return _shortlisted(spark, sf_dir).select("job_id", "resume_id", "final_rank", *[F.round(c, 6).alias(c) for c in columns])


@query("batch_shortlist", f"{FUSED_SQL} select job_id, (select count(*) from labelled l where l.job_id = short.job_id) as retrieved_count, count(*) as returned_count, 20 as top_k, 50 as num_candidates from short group by job_id")
def batch_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shortlist.run_rows(fx.pairs(spark, sf_dir), _shortlisted(spark, sf_dir), 20, fx.POOL)


#: A fixed linear scorer, so that scores and contributions can be checked in SQL.
FIXED = ranker.LinearRanker({"embedding_cosine": 2.0, "skill_overlap_ratio": -1.5, "title_overlap_ratio": 0.5, "years_gap": 0.1}, {"embedding_cosine": 0.3, "skill_overlap_ratio": 0.5, "title_overlap_ratio": 0.5, "years_gap": 3.0})
PARTS_SQL = ", ".join(f"({w} * ({f} - {FIXED.means[f]})) as c{i}" for i, (f, w) in enumerate(FIXED.weights.items()))
IMPACTS_SQL = f"{L}, e as (select job_id, resume_id, {PARTS_SQL} from labelled), i as (" + " union all ".join(f"select job_id, resume_id, '{f}' as feature, c{i} as impact from e" for i, f in enumerate(FIXED.weights)) + ")"


@query("ranker_contributions", f"{IMPACTS_SQL} select job_id, resume_id, feature, round(impact, 6) as impact from i")
def ranker_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = ranker.contributions(fx.labelled(spark, sf_dir), FIXED).select("job_id", "resume_id", F.explode("contributions").alias("c"))
    return explained.select("job_id", "resume_id", "c.feature", F.round("c.impact", 6).alias("impact"))


@query("shap_summary", f"{IMPACTS_SQL} select feature, round(avg(abs(impact)), 6) as mean_abs_impact, round(avg(impact), 6) as mean_impact, round(stddev_pop(impact), 6) as std_impact from i group by feature")
def shap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.contribution_summary(ranker.contributions(fx.labelled(spark, sf_dir), FIXED))


GLOSSARY = [("embedding_cosine", "Semantic match"), ("skill_overlap_ratio", "Skill coverage"), ("retrieval_rank", "Retrieval position")]


@query("global_explanation", f"""{IMPACTS_SQL}, s as (select feature, round(avg(abs(impact)), 6) as m from i group by feature), g(feature, label) as (values {", ".join(f"('{a}', '{b}')" for a, b in GLOSSARY)})
    select coalesce(g.feature, s.feature) as feature, coalesce(g.label, s.feature) as label, s.m is not null as used_in_model, coalesce(s.m, 0) as mean_abs_impact,
    round(coalesce(s.m, 0) / (select max(m) from s), 6) as relative from g full outer join s on g.feature = s.feature""")
def global_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.global_explanation(shap_summary(spark, sf_dir), spark.createDataFrame(GLOSSARY, "feature string, label string"))


@query("top_factors", f"""{IMPACTS_SQL}, r as (select *, impact > 0 as positive, row_number() over (partition by job_id, resume_id, impact > 0 order by abs(impact) desc, feature)::int as place from i where impact <> 0)
    select job_id, resume_id, positive, place, feature, round(impact, 6) as impact from r where place <= 3""")
def top_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    explained = ranker.contributions(fx.labelled(spark, sf_dir), FIXED)
    sides = [explained.select("job_id", "resume_id", F.lit(p).alias("positive"), F.posexplode(shortlist.top_factors(F.col("contributions"), p)).alias("place", "c")) for p in (True, False)]
    both = sides[0].unionByName(sides[1])
    return both.select("job_id", "resume_id", "positive", (F.col("place") + 1).alias("place"), "c.feature", F.round("c.impact", 6).alias("impact"))


#: A fixed small forest, so that scores and contributions of trees can be checked in SQL.
FOREST = TreeRanker(["embedding_cosine", "skill_overlap_ratio", "years_gap"], [
    Tree(*map(np.array, ([0, 1, 2, -1, -1, -1, -1], [0.2, 0.45, 3.5, 0, 0, 0, 0], [0, 0, 0, -0.4, 0.1, 0.2, 0.7], [100, 60, 40, 35, 25, 10, 30]))),
    Tree(*map(np.array, ([1, 0, -1, -1, -1, -1, -1], [0.5, 0.1, 0, 0, 0, 0, 0], [0, 0, 0.6, -0.5, 0.2, 0, 0], [100, 70, 30, 20, 50, 0, 0]))),
])


def _known_sql(tree: Tree, known: set[int], node: int = 0) -> str:
    """A tree's value where only some features are known: the others are averaged over both ways."""
    f = int(tree.feature[node])
    if f < 0:
        return f"({tree.value[node]}::double)"
    left, right = (_known_sql(tree, known, 2 * node + i) for i in (1, 2))
    if f in known:
        return f"case when {FOREST.features[f]} > {tree.threshold[node]} then {right} else {left} end"
    return f"(({tree.cover[2 * node + 1]} * {left} + {tree.cover[2 * node + 2]} * {right}) / {tree.cover[node]}::double)"


def _share_sql(feature: int) -> str:
    """The Shapley value of a feature by enumerating the sets of the others."""
    rest = [i for i in range(len(FOREST.features)) if i != feature]
    parts = []
    for n in range(len(rest) + 1):
        weight = math.factorial(n) * math.factorial(len(rest) - n) / math.factorial(len(rest) + 1)
        parts += [f"{weight} * ({_known_sql(t, {*s, feature})} - {_known_sql(t, set(s))})" for s in itertools.combinations(rest, n) for t in FOREST.trees]
    return " + ".join(parts)


TREE_IMPACTS_SQL = f"{L}, i as (" + " union all ".join(f"select job_id, resume_id, '{f}' as feature, {_share_sql(i)} as impact from labelled" for i, f in enumerate(FOREST.features)) + ")"


OTHER = ranker.LinearRanker({"embedding_cosine": -1.0, "skill_overlap_ratio": 1.0, "title_overlap_ratio": 2.0, "years_gap": -0.2}, FIXED.means)


def _linear_sql(model: ranker.LinearRanker) -> str:
    return f"round({' + '.join(f'({w}::double) * {c}' for c, w in model.weights.items())}, 9)"


@query("linear_scores", f"{L} select job_id, resume_id, round({_linear_sql(FIXED)}, 6) as pred, row_number() over (partition by job_id order by {_linear_sql(FIXED)} desc, resume_id)::int as final_rank from labelled")
def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranker.score_pairs(fx.labelled(spark, sf_dir).drop("pred"), FIXED)
    return scored.select("job_id", "resume_id", F.round("pred", 6).alias("pred"), "final_rank")


@query("linear_importance", f"{L} " + " union all ".join(f"select '{c}' as feature, {w}::double as weight, round(abs({w}::double) * stddev_pop({c}), 6) as importance from labelled" for c, w in FIXED.weights.items()))
def linear_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.feature_importance(spark, FIXED, fx.labelled(spark, sf_dir)).withColumn("importance", F.round("importance", 6))


@query("trial_metrics", f"""{L}, tried as ({" union all ".join(f"select concat('{i}|', job_id) as job_id, resume_id, final_label, {_linear_sql(m)} as pred from labelled" for i, m in enumerate((FIXED, OTHER)))}),
    {_ndcg_sql('tried')} select job_id[1]::int as trial, round(coalesce(avg(ndcg_10), 0), 6) as metric from nd group by 1""")
def trial_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search's metric of two given rankers, scored in one pass."""
    found = ranker.trial_metrics(fx.labelled(spark, sf_dir), {0: FIXED, 1: OTHER})
    return spark.createDataFrame(sorted(found.items()), "trial int, metric double")


@query("tree_scores", f"""{L}, s as (select job_id, resume_id, round({" + ".join(_known_sql(t, {0, 1, 2}) for t in FOREST.trees)}, 6) as pred from labelled)
    select *, row_number() over (partition by job_id order by pred desc, resume_id)::int as final_rank from s""")
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = ranker.score_pairs(fx.labelled(spark, sf_dir).drop("pred"), FOREST)
    return scored.select("job_id", "resume_id", F.round("pred", 6).alias("pred"), "final_rank")


@query("tree_contributions", f"{TREE_IMPACTS_SQL} select job_id, resume_id, feature, round(impact, 6) as impact from i")
def tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact Shapley values of the forest, against their definition."""
    explained = ranker.contributions(fx.labelled(spark, sf_dir), FOREST).select("job_id", "resume_id", F.explode("contributions").alias("c"))
    return explained.select("job_id", "resume_id", "c.feature", F.round("c.impact", 6).alias("impact"))


@query("tree_shap_summary", f"{TREE_IMPACTS_SQL} select feature, round(avg(abs(impact)), 6) as mean_abs_impact, round(avg(impact), 6) as mean_impact, round(stddev_pop(impact), 6) as std_impact from i group by feature")
def tree_shap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranker.contribution_summary(ranker.contributions(fx.labelled(spark, sf_dir), FOREST))


@query("feature_values", f"""{L} select job_id, resume_id, retrieval_rank::varchar as rank_text, printf('%.4f', skill_overlap_ratio) as skill_text, case when years_gap < 0 then 'n/a' else printf('%.4f', years_gap) end as gap_text,
    case when resume_id % 2 = 0 then 'sql, spark' else 'none' end as missing_text, case when resume_id % 2 = 0 then '2' else '0' end as missing_count from labelled""")
def feature_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    missing = F.when(F.col("resume_id") % 2 == 0, F.array(F.lit("sql"), F.lit("spark")))
    rows = fx.labelled(spark, sf_dir).withColumn("missing_skills", missing).withColumn("years_gap", F.when(F.col("years_gap") >= 0, F.col("years_gap")))
    m = shortlist.feature_values(["retrieval_rank", "skill_overlap_ratio", "years_gap"])
    shown = {"rank_text": "retrieval_rank", "skill_text": "skill_overlap_ratio", "gap_text": "years_gap", "missing_text": "missing_skills", "missing_count": "missing_skills_count"}
    return rows.withColumn("m", m).select("job_id", "resume_id", *[F.col("m")[k].alias(n) for n, k in shown.items()])


def _split_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training, validation and test rows with engineered features, which are worked out once."""
    rows = tables.written(engineered(spark, sf_dir), "engineered")
    split = rows.join(labels.group_split(rows), "job_id")
    return tuple(split.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test"))


@query("ranker_scores")
def ranker_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows scored by the pairwise ranker."""
    train, valid, test = _split_rows(spark, sf_dir)
    return ranker.predictions(test, ranker.refit(train, valid, {}))


@query("listwise_trees")
def listwise_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the test openings by boosted trees on NDCG gradients, fitted on the others."""
    train, valid, test = _split_rows(spark, sf_dir)
    return ranker.predictions(test, tree_ranker.fit_trees(train.unionByName(valid), trees=8, depth=3, rate=0.3))


@query("feature_importance")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _, _ = _split_rows(spark, sf_dir)
    return ranker.feature_importance(spark, ranker.fit_ranker(train), train)


@query("ranker_search")
def ranker_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trial table of a short seeded search."""
    train, valid, _ = _split_rows(spark, sf_dir)
    trials, _ = ranker.random_search(train, valid, 12)
    return spark.createDataFrame(trials, "trial int, regParam double, elasticNetParam double, maxIter int, metric double, error string")


#: The fixed scorer of the served shortlists: base and engineered features, as in serving.
SERVED = ranker.LinearRanker(
    {"embedding_cosine": 1.4983, "ce_score_x_skill": 2.0, "title_overlap_ratio": 0.5, "years_gap": 0.05, "skill_overlap_ratio_zscore_in_job": 0.25, "retrieval_rank_inv": 1.0},
    {"embedding_cosine": 0.5, "ce_score_x_skill": 0.1, "title_overlap_ratio": 0.1, "years_gap": 3.0, "skill_overlap_ratio_zscore_in_job": 0.0, "retrieval_rank_inv": 0.05},
)
SERVED_SCORED = 60


def _words_sql(text: str) -> str:
    return rf"list_distinct(list_filter(regexp_split_to_array(translate(lower({text}), '/-', '  '), '\s+'), lambda t: t <> ''))"


def served_sql(jobs: str = "jobs") -> str:
    """served: the shortlists of the pool's openings, 20 candidates each."""
    model = " + ".join(f"{w} * {f}::double" for f, w in SERVED.weights.items())
    return f"""cosined as (select p.*, coalesce({_DOT.format(a="job_vec.embedding", b="rv.embedding")}, retrieval_score_raw) as embedding_cosine,
    case when job_vec.embedding is not null and rv.embedding is not null then 'local_embedding' else 'elastic_score_fallback' end as embedding_source from pool p left join job_vec using (job_id) left join rv using (resume_id)),
sv as (select p.*, job_skills, resume_skills, j.text as jt, r.text as rt, len(list_intersect(job_skills, resume_skills))::int as skill_overlap_count, resume_years, job_years, resume_years - job_years as years_gap,
    {_words_sql("job_title")} as a, {_words_sql("resume_titles[1]")} as b from cosined p join {jobs} j using (job_id) join resumes r using (resume_id)),
sf as (select *, skill_overlap_count / greatest(len(job_skills), 1) as skill_overlap_ratio, case when len(a) > 0 then len(list_intersect(a, b)) / len(a) else 0 end as title_overlap_ratio,
    list_sort(list_intersect(job_skills, resume_skills))[1:10] as matched_skills, list_sort(list_filter(job_skills, lambda s: not list_contains(resume_skills, s)))[1:10] as missing_skills from sv),
sg as (select *, row_number() over (partition by job_id order by round(embedding_cosine + 0.5 * skill_overlap_ratio, 6) desc, retrieval_rank, resume_id) as turn, count(*) over (partition by job_id) as pool_size,
    {_token_set_sql("jt")} as ja, {_token_set_sql("rt")} as ra from sf),
sq as (select * exclude (ja, ra, jt, rt), case when turn <= {SERVED_SCORED} or pool_size <= {SERVED_SCORED} then {LEXICAL_SQL} else 0 end as ce_score from sg),
se as (select *, (ce_score * skill_overlap_ratio)::float as ce_score_x_skill, (1 / (retrieval_rank + 1))::float as retrieval_rank_inv, ({_z("skill_overlap_ratio")})::float as skill_overlap_ratio_zscore_in_job
    from sq window w as (partition by job_id)),
sm as (select *, round({model}, 9) as model_score from se),
sn as (select *, round(case when max(retrieval_score_raw) over w = min(retrieval_score_raw) over w then 1 else (retrieval_score_raw - min(retrieval_score_raw) over w) / (max(retrieval_score_raw) over w - min(retrieval_score_raw) over w) end, 9) as rn,
    round(case when max(model_score) over w = min(model_score) over w then 1 else (model_score - min(model_score) over w) / (max(model_score) over w - min(model_score) over w) end, 9) as pn from sm window w as (partition by job_id)),
so as (select *, round(0.3 * rn + 0.7 * pn, 9) as fused from sn),
served as (select *, row_number() over (partition by job_id order by fused desc, pn desc, rn desc, resume_id)::int as final_rank from so qualify final_rank <= 20)"""


def _half_up(value: str, digits: int) -> str:
    """Rounded as Spark rounds: half up of the decimal form."""
    return f"round(({value})::decimal(24, 12), {digits})::double"


SERVED_SHOWN = ", ".join(f"{_half_up(c, 5)} as {n}" for c, n in (("model_score", "model_score"), ("rn", "retrieval_score_norm"), ("pn", "reranker_score_norm"), ("fused", "final_fusion_score")))


def _served_numbers() -> list:
    return [F.round(c, 5).alias(c) for c in ("model_score", "retrieval_score_norm", "reranker_score_norm", "final_fusion_score")]


def served_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of every passage's shortlist, from pools to explanations."""
    jobs, resumes = fx.text_jobs(spark, sf_dir), _profiles(spark, sf_dir)
    asked, others = _hybrid_vectors(spark, sf_dir)
    shown = shortlist.served_shortlists(hybrid_retrieval(spark, sf_dir, resumes), jobs, resumes, asked, others, SERVED, 20, scored=SERVED_SCORED)
    return shortlist.candidate_records(shown, SERVED, resumes)


@query("served_shortlist", f"""with {fx.TEXT_SQL}, {BENCHMARK_VECTORS_SQL}, {pool_sql()}, {served_sql()}
    select job_id, resume_id, final_rank, retrieval_rank, embedding_source, skill_overlap_count, {SERVED_SHOWN}, array_to_string(matched_skills, ',') as matched, array_to_string(missing_skills, ',') as missing from served""")
def served_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortlist of every passage as one job: pool, cosines, features, pair scores, ranker, fusion."""
    return served_records(spark, sf_dir).select(
        "job_id", "resume_id", "final_rank", "retrieval_rank", "embedding_source", "skill_overlap_count", *_served_numbers(),
        F.array_join("explanation.matched_skills", ",").alias("matched"), F.array_join("explanation.missing_skills", ",").alias("missing"),
    )


_IMPACTS = ", ".join(f"({w} * ({f}::double - {SERVED.means[f]}))" for f, w in SERVED.weights.items())
_NAMES = ", ".join(f"'{f}'" for f in SERVED.weights)
_LABELS = "case f " + " ".join(f"when '{f}' then '{shortlist.FEATURE_LABELS[f][0]}'" for f in SERVED.weights if f in shortlist.FEATURE_LABELS) + " else f end"
_VALUES = ", ".join(f"printf('%.4f', {_half_up(f, 4)})" for f in SERVED.weights)


@query("candidate_factors", f"""with {fx.TEXT_SQL}, {BENCHMARK_VECTORS_SQL}, {pool_sql()}, {served_sql()},
    i as (select job_id, resume_id, unnest([{_NAMES}]) as f, unnest([{_IMPACTS}]) as impact, unnest([{_VALUES}]) as raw_value from served),
    k as (select *, impact > 0 as positive, row_number() over (partition by job_id, resume_id, impact > 0 order by abs(impact) desc, f)::int as place from i where impact <> 0)
    select job_id, resume_id, positive, place, f as feature, {_LABELS} as label, {_half_up('impact', 4)} as impact, raw_value from k where place <= 3""")
def candidate_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled factors of every candidate's record."""
    records = served_records(spark, sf_dir)
    sides = [records.select("job_id", "resume_id", F.lit(p).alias("positive"), F.posexplode(f"explanation.top_{side}_factors").alias("at", "c")) for p, side in ((True, "positive"), (False, "negative"))]
    both = sides[0].unionByName(sides[1])
    return both.select("job_id", "resume_id", "positive", (F.col("at") + 1).alias("place"), "c.feature", "c.label", F.round("c.impact", 4).alias("impact"), "c.raw_value")


_REQUEST_YEARS = "coalesce(list_max(list_filter(list_transform(regexp_extract_all(title || ' ' || description, '(?i)\\b(\\d{1,2})\\+?\\s*(?:years?|yrs?)\\b', 1), lambda x: x::double), lambda x: x <= 60)), 0)::double"


@query("vacancy_shortlist", f"""with {fx.TEXT_SQL}, {texts.ADHOC_SQL}, {texts.PROXY_SQL},
    vjobs as (select d.vacancy_id as job_id, p.job_id as proxy_job_id, title || ' ' || description as text, title as job_title, skills as job_skills, {_REQUEST_YEARS} as job_years from derived d join proxy p using (vacancy_id)),
    job_vec as (select v.job_id, embedding from vjobs v join embeddings e on e.vec_id = v.proxy_job_id), {pool_sql("vjobs")}, {served_sql("vjobs")}
    select job_id, proxy_job_id, resume_id, final_rank, retrieval_rank, {SERVED_SHOWN} from served join vjobs using (job_id)""")
def vacancy_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlists of ad-hoc vacancies: derived skills and years, the vector of the proxy opening, then as for openings."""
    resumes, (asked, others) = _profiles(spark, sf_dir), _hybrid_vectors(spark, sf_dir)
    vacancies = tables.written(texts.adhoc_with_skills(spark, sf_dir), "vacancies")
    # read by the search, the clauses and the features
    openings = tables.written(shortlist.vacancy_openings(vacancies, fx.text_jobs(spark, sf_dir), asked), "openings")
    vectors = openings.where("embedding is not null").select("job_id", "embedding")
    pool = retrieval.hybrid_retrieval(retrieval.topk_cosine(vectors, others, 100), openings, resumes, 100)
    shown = shortlist.served_shortlists(pool, openings, resumes, vectors, others, SERVED, 20, scored=SERVED_SCORED)
    numbered = shown.withColumnRenamed("reranker_score_raw", "model_score").join(openings.select("job_id", "proxy_job_id"), "job_id")
    return numbered.select("job_id", "proxy_job_id", "resume_id", "final_rank", "retrieval_rank", *_served_numbers())
