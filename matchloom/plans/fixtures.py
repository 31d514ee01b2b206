"""The given tables in the roles of openings, profiles, runs and feedback; each as a DataFrame and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators import retrieval

POOL = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def job_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 10 = 0").selectExpr("vec_id as job_id", "embedding")


def resume_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 10 <> 0").selectExpr("vec_id as resume_id", "embedding")


COSINE_SQL = """cosines as (select j.vec_id as job_id, r.vec_id as resume_id,
    round(list_sum(list_transform(list_zip(j.embedding, r.embedding), lambda p: p[1]::double * p[2]::double)), 6) as embedding_cosine
    from embeddings j join embeddings r on j.vec_id % 10 = 0 and r.vec_id % 10 <> 0),
nearest as (select *, row_number() over (partition by job_id order by embedding_cosine desc, resume_id)::int as retrieval_rank
    from cosines qualify retrieval_rank <= 50)"""

_PAIR_FIELDS = """job_id, resume_id, retrieval_rank, embedding_cosine, cast((resume_id * 7 + job_id) % 11 as int) as skill_overlap_count,
    ((resume_id * 7 + job_id) % 11) / cast(10 as double) as skill_overlap_ratio, ((resume_id * 3 + job_id) % 5) / cast(4 as double) as title_overlap_ratio,
    cast(resume_id % 15 as double) as resume_years_experience, cast(floor(job_id / 10) % 8 as double) as job_years_required,
    cast(resume_id % 15 as double) - cast(floor(job_id / 10) % 8 as double) as years_gap,
    case when resume_id % 15 >= floor(job_id / 10) % 8 then 1 else 0 end as experience_match_flag, cast(1.6 as double) * embedding_cosine + cast(0.0000003 as double) as ce_score_raw"""
_LABEL = "case when ce_score_raw >= 0 and ce_score_raw < 1.01 then case when ce_score_raw >= 0.65 then 4 when ce_score_raw >= 0.5 then 3 when ce_score_raw >= 0.35 then 2 when ce_score_raw >= 0.25 then 1 else 0 end else 0 end"
_PRED = "round(0.5 * embedding_cosine + 0.03 * skill_overlap_count + 0.1 * title_overlap_ratio, 2)"

PAIRS_SQL = f"{COSINE_SQL}, pairs as (select {_PAIR_FIELDS} from nearest)"
LABELLED_SQL = f"""{PAIRS_SQL}, labelled as (select *, round(ce_score_raw, 4) as ce_score, {_LABEL} as final_label,
    row_number() over (partition by job_id order by round(ce_score_raw, 4) desc, retrieval_rank, resume_id)::int as within_job_rank, {_PRED} as pred from pairs)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest profiles of every opening with base features; overlaps and years are derived from the ids."""
    near = retrieval.topk_cosine(job_vectors(spark, sf_dir), resume_vectors(spark, sf_dir), POOL)
    return near.selectExpr(*[x.strip() for x in _split_fields(_PAIR_FIELDS)])


def _split_fields(fields: str) -> list[str]:
    parts, depth, at = [], 0, 0
    for i, c in enumerate(fields):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(fields[at:i])
            at = i + 1
    return [*parts, fields[at:]]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    from matchloom.operators.labels import label_pairs

    return label_pairs(pairs(spark, sf_dir)).withColumn("pred", F.expr(_PRED))


_TOKENS = "regexp_extract_all(lower(text), '[a-z]+', 0)"


def text_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings from benchmark passages: the first three words are the title, long words the skills."""
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("job_id"), "text", F.expr(_TOKENS).alias("tokens"))
    return rows.selectExpr("job_id", "text", "array_join(slice(tokens, 1, 3), ' ') as job_title", "text as job_description", "array_distinct(filter(tokens, x -> length(x) >= 9)) as job_skills", "cast(job_id % 8 as double) as job_years")


def text_resumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles from documents: long words are the skills, the first two words a past title."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resume_id"), "text", F.expr(_TOKENS).alias("tokens"))
    return rows.selectExpr("resume_id", "text", "array_distinct(filter(tokens, x -> length(x) >= 9)) as resume_skills", "array(array_join(slice(tokens, 1, 3), ' ')) as resume_titles", "cast(resume_id % 15 as double) as resume_years")


TEXT_SQL = """jt as (select item_id as job_id, text, regexp_extract_all(lower(text), '[a-z]+') as tokens from benchmark),
jobs as (select job_id, text, array_to_string(tokens[1:3], ' ') as job_title, list_distinct(list_filter(tokens, lambda x: length(x) >= 9)) as job_skills, (job_id % 8)::double as job_years from jt),
rt as (select doc_id as resume_id, text, regexp_extract_all(lower(text), '[a-z]+') as tokens from documents),
resumes as (select resume_id, text, list_distinct(list_filter(tokens, lambda x: length(x) >= 9)) as resume_skills, [array_to_string(tokens[1:3], ' ')] as resume_titles, (resume_id % 15)::double as resume_years from rt)"""

_CELL = """case p_partkey % 5 when 0 then concat('[', chr(39), p_brand, chr(39), ', "', p_type, '", ', chr(39), upper(p_brand), chr(39), ']')
    when 1 then concat(p_type, '|', p_brand, ';', lower(p_brand), ', ', p_name) when 2 then ' nan ' when 3 then concat('[', p_type, ' ', p_brand, ']')
    else concat('  ', p_name, '/', lower(p_type), '|object-oriented ', p_name, ' using the design of ', p_brand, '|https://x.org/', p_name) end"""


def part_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with a list cell in each of its forms."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_name", "p_type", "p_brand", "p_size", f"{_CELL} as cell")


CELL_SQL = f"cells as (select p_partkey, p_name, p_type, p_brand, p_size, {_CELL} as cell from part)"

#: One-row tables that grow with the data, by name: vacancies, runs, and a quarter of the events, so that some come to the same run.
_COUNTS = {"vacancies": ("part", "count(*)"), "runs": ("orders", "count(*)"), "groups": ("events", "cast(floor(count(*) / 4) as bigint)")}
_RUN = "o_orderkey as run_id, cast(floor(o_custkey / 16) as bigint) as user_id, case when o_orderkey % 7 = 0 then null else o_orderkey % vacancies end as vacancy_id, o_orderdate as created_at, o_orderstatus as status"
_VACANCY = "p_partkey as vacancy_id, cast(floor(p_partkey / 60) as bigint) as owner_user_id, p_name as title, concat(p_name, ' ', p_type, ' ', repeat(concat(p_brand, ' '), 30)) as description, cast('2024-01-01' as timestamp) + p_size * interval '1' day as created_at"
_SNAPSHOT = """case when resume_id % 13 = 0 then null when resume_id % 17 = 0 then '{bad' else concat('{"resume_years_experience": ', resume_id % 15, ', "skill_overlap_count": ', resume_id % 14,
    ', "experience_match_flag": ', resume_id % 2, ', "embedding_cosine": 0.', resume_id % 9, ', "skill_overlap_ratio": 0.5, "title_overlap_ratio": 0.25, "years_gap": ', resume_id % 4,
    case when resume_id % 11 = 0 then '' else concat(', "job_years_required": ', resume_id % 5) end, '}') end"""


def counted(spark: SparkSession, sf_dir: str, name: str, *counts: str) -> DataFrame:
    """A table with columns of one value each, named in _COUNTS."""
    rows = table(spark, sf_dir, name)
    for c in counts:
        of, number = _COUNTS[c]
        rows = rows.crossJoin(F.broadcast(table(spark, sf_dir, of).selectExpr(f"{number} as {c}")))
    return rows


def counted_sql(name: str, *counts: str) -> str:
    return f"(select *, {', '.join(f'(select {number} from {of}) as {c}' for c, (of, number) in _COUNTS.items() if c in counts)} from {name})"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counted(spark, sf_dir, "orders", "vacancies").selectExpr(*_split_fields(_RUN))


def vacancies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*_split_fields(_VACANCY))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of runs from order lines, one per run and part, ranked by price."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.max("l_extendedprice").alias("score"))
    ranked = lines.selectExpr(
        "l_orderkey as run_id", "l_partkey as resume_id", "l_orderkey * 1000000 + l_partkey as candidate_id", "cast(floor(l_orderkey / 300) as bigint) as user_id", "score",
        "cast(row_number() over (partition by l_orderkey order by score desc, l_partkey) as int) as final_rank",
    )
    return ranked.selectExpr("*", f"{_SNAPSHOT} as feature_snapshot")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback from events: the type is the decision; the run and rank come from the event's number."""
    made = counted(spark, sf_dir, "events", "runs", "groups").where("event_type <> 'click'").selectExpr(
        "event_id as feedback_id", "event_id % groups * 7 % runs as run_id", "cast(1 + event_id % 3 as int) as final_rank",
        "case event_type when 'purchase' then 'interview' when 'signup' then 'accept' when 'view' then 'maybe' else 'reject' end as decision",
        "cast(1 + event_id % 5 as int) as rating", "concat('note ', event_id) as note", "concat('job ', event_id % 5) as job_title", "ts as updated_at",
    )
    shown = candidates(spark, sf_dir).select("run_id", "final_rank", "candidate_id", "resume_id", "user_id", "score", "feature_snapshot")
    return made.join(shown, ["run_id", "final_rank"])


HISTORY_SQL = f"""runs as (select {_RUN} from {counted_sql("orders", "vacancies")}), vacancies as (select {_VACANCY} from part),
lines as (select l_orderkey as run_id, l_partkey as resume_id, l_orderkey * 1000000 + l_partkey as candidate_id, cast(floor(l_orderkey / 300) as bigint) as user_id, max(l_extendedprice) as score from lineitem group by l_orderkey, l_partkey),
candidates as (select *, {_SNAPSHOT} as feature_snapshot, row_number() over (partition by run_id order by score desc, resume_id)::int as final_rank from lines),
feedback as (select event_id as feedback_id, c.run_id, c.final_rank, candidate_id, resume_id, c.user_id, score, feature_snapshot,
    case event_type when 'purchase' then 'interview' when 'signup' then 'accept' when 'view' then 'maybe' else 'reject' end as decision,
    (1 + event_id % 5)::int as rating, concat('note ', event_id) as note, concat('job ', event_id % 5) as job_title, ts as updated_at
    from {counted_sql("events", "runs", "groups")} e join candidates c on e.event_id % e.groups * 7 % e.runs = c.run_id and 1 + e.event_id % 3 = c.final_rank where event_type <> 'click')"""

_REQUEST = "event_id, ts, user_id, 'GET' as method, concat('/', event_type) as path, case when event_type = 'error' then 500 else 200 end as status_code, value as latency_ms"


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split_fields(_REQUEST))


REQUEST_SQL = f"requests as (select {_REQUEST} from events)"
