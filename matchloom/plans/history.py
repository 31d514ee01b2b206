"""Queries on history, feedback, boards, fairness and request metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as tx
from matchloom.functions.snapshots import parsed_snapshots, snapshot_fields
from matchloom.operators import feedback as fb
from matchloom.operators import quantiles, reports, shortlist
from matchloom.plans import fixtures as fx
from matchloom.sources import tables
from matchloom.sources.tables import written
from matchloom.streaming import jobs as st
from matchloom.streaming import sketches, versions

QUERIES, ORACLES = {}, {}
H = f"with {fx.HISTORY_SQL}"


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


PREVIEW = "case when length(description) > 180 then regexp_replace(description[1:180], '^\\s+|\\s+$', '', 'g') || '...' else regexp_replace(description, '^\\s+|\\s+$', '', 'g') end"


@query("run_list", f"""{H}, r as (select *, row_number() over (partition by user_id order by created_at desc, run_id desc)::int as position from runs qualify position <= 20)
    select run_id, user_id, r.vacancy_id, r.created_at, status, position, title, {PREVIEW} as preview from r left join vacancies v on r.vacancy_id = v.vacancy_id""")
def run_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.run_list(fx.runs(spark, sf_dir), fx.vacancies(spark, sf_dir), 20)


@query("vacancy_list", f"""{H}, p as (select vacancy_id, count(*) as run_count, max(created_at) as last_run_at from runs group by vacancy_id),
    v as (select *, row_number() over (partition by owner_user_id order by created_at desc, vacancy_id desc)::int as position from vacancies qualify position <= 50)
    select v.*, coalesce(run_count, 0) as run_count, last_run_at from v left join p using (vacancy_id)""")
def vacancy_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.vacancy_list(fx.vacancies(spark, sf_dir), fx.runs(spark, sf_dir), 50)


_ANALYSIS = "event_id as analysis_id, event_id % groups * 11 % runs as run_id, case when event_id % 2 = 0 then 'explain' else 'compare' end as mode, concat('text ', event_id) as content, ts as created_at"
ANALYSES_SQL = f"analyses as (select {_ANALYSIS} from {fx.counted_sql('events', 'runs', 'groups')}), latest as (select * from analyses qualify row_number() over (partition by run_id, mode order by created_at desc, analysis_id desc) = 1)"


def _analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.counted(spark, sf_dir, "events", "runs", "groups").selectExpr(*fx._split_fields(_ANALYSIS))


@query("run_detail", f"""{H}, {ANALYSES_SQL}, c as (select run_id, string_agg(final_rank || ':' || resume_id, ',' order by final_rank) as shown from candidates group by run_id)
    select runs.run_id, status, shown, e.content as explain_text, k.content as compare_text from runs left join c using (run_id)
    left join latest e on e.run_id = runs.run_id and e.mode = 'explain' left join latest k on k.run_id = runs.run_id and k.mode = 'compare'""")
def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    detail = reports.run_detail(fx.runs(spark, sf_dir), fx.candidates(spark, sf_dir), _analyses(spark, sf_dir))
    shown = F.array_join(F.transform("candidates", lambda c: F.concat(c["final_rank"].cast("string"), F.lit(":"), c["resume_id"].cast("string"))), ",")
    return detail.select("run_id", "status", shown.alias("shown"), F.try_element_at("analyses", F.lit("explain")).alias("explain_text"), F.try_element_at("analyses", F.lit("compare")).alias("compare_text"))


@query("analyses_latest", f"with {ANALYSES_SQL} select run_id, mode, content, created_at from latest")
def analyses_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.latest_analyses(_analyses(spark, sf_dir))


LATEST_SQL = "latest as (select *, min(updated_at) over (partition by user_id, candidate_id) as created_at from feedback qualify row_number() over (partition by user_id, candidate_id order by updated_at desc, feedback_id desc) = 1)"


@query("feedback_latest", f"{H}, {LATEST_SQL} select user_id, candidate_id, decision, rating, note, created_at, updated_at from latest")
def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.feedback_latest(fx.feedback(spark, sf_dir))


@query("upserted_feedback", f"{H}, {LATEST_SQL} select user_id, candidate_id, decision, rating, note, created_at, updated_at from latest")
def upserted_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows from a table that three batches, out of order, have been merged into."""
    path = tables.scratch_path(spark, "feedback")
    rows = fx.feedback(spark, sf_dir).select("user_id", "candidate_id", "decision", "rating", "note", F.col("updated_at").alias("created_at"), "updated_at", "feedback_id")
    write = versions.versioned_upserts(path, ["user_id", "candidate_id"], ["updated_at", "feedback_id"], {"created_at": "updated_at"}, bucket_rows=20_000)
    for epoch in range(3):
        write(rows.where(F.col("feedback_id") % 3 == 2 - epoch), epoch)
    return versions.read_upserts(spark, path).drop("feedback_id")


@query("feedback_by_run", f"{H}, {LATEST_SQL} select l.user_id, l.candidate_id, l.decision, c.run_id, c.final_rank from latest l join candidates c using (candidate_id) where l.candidate_id % 4 <> 0")
def feedback_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = feedback_latest(spark, sf_dir)
    listed = reports.feedback_by_run(latest, fx.candidates(spark, sf_dir), latest.where("candidate_id % 4 = 0").select("user_id", "candidate_id"))
    return listed.select("user_id", "candidate_id", "decision", "run_id", "final_rank")


_SNAPSHOT_TEXT = "'{' || " + " || ',' || ".join(f"""'"{k}":' || (json_extract_string(snap, '$.{k}')::double)::varchar""" for k in ("skill_overlap_ratio", "resume_years_experience", "embedding_cosine", "title_overlap_ratio")) + " || '}'"
BOARD_SQL = f"""entries as (select user_id, run_id, resume_id, first_value(job_title) over f as job_title, first_value(final_rank) over f as final_rank, first_value(score) over f as score,
    case decision when 'accept' then 'screened' when 'interview' then 'interview' when 'reject' then 'rejected' else 'new' end as kanban_status, note, first_value(feature_snapshot) over f as snap,
    min(updated_at) over (partition by user_id, run_id, resume_id) as created_at, updated_at
    from feedback window f as (partition by user_id, run_id, resume_id order by updated_at, feedback_id)
    qualify row_number() over (partition by user_id, run_id, resume_id order by updated_at desc, feedback_id desc) = 1)"""


@query("board", f"{H}, {BOARD_SQL} select * exclude (snap), case when json_valid(snap) then {_SNAPSHOT_TEXT} else '{{}}' end as candidate_snapshot from entries")
def board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.board(fx.feedback(spark, sf_dir).withColumn("created_at", F.col("updated_at")))


@query("board_counts", f"""{H}, {BOARD_SQL}, s as (select unnest(['new', 'screened', 'interview', 'offer', 'hired', 'rejected']) as kanban_status)
    select user_id, s.kanban_status, count(e.run_id) as entries from (select distinct user_id from entries) u cross join s left join entries e using (user_id, kanban_status) group by user_id, s.kanban_status""")
def board_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.board_counts(board(spark, sf_dir))


@query("job_catalogue", f"""with {fx.TEXT_SQL} select job_id, job_title, case when length(text) > 220 then regexp_replace(text[1:220], '^\\s+|\\s+$', '', 'g') || '...' else regexp_replace(text, '^\\s+|\\s+$', '', 'g') end as preview, len(job_skills)::int as skills from jobs where len(job_skills) >= 2""")
def job_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.job_catalogue(fx.text_jobs(spark, sf_dir).withColumnRenamed("job_skills", "job_skills_norm"))


@query("totals", "select (select count(*) from benchmark) as total_jobs, (select count(*) from documents) as total_resumes")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.totals(fx.table(spark, sf_dir, "benchmark"), fx.table(spark, sf_dir, "documents"))


def _json(field: str) -> str:
    return f"case when feature_snapshot is not null and json_valid(feature_snapshot) then json_extract_string(feature_snapshot, '$.{field}')::double end"


BUCKET = {
    "experience": "case when years is null then 'unknown' when years < 1 then '0-1y' when years < 3 then '1-3y' when years < 6 then '3-6y' when years < 10 then '6-10y' else '10y+' end",
    "skill": "case when skills is null then 'unknown' when skills <= 0 then '0' when skills <= 2 then '1-2' when skills <= 5 then '3-5' when skills <= 10 then '6-10' else '11+' end",
    "match": "case when fits is null then 'unknown' when fits = 1 then 'meets' else 'below' end",
}


def _fairness_sql(by: str, source: str = "candidates") -> str:
    return f"""{LATEST_SQL}, s as (select *, {_json("resume_years_experience")} as years, {_json("skill_overlap_count")} as skills, {_json("experience_match_flag")} as fits, {_json("embedding_cosine")} as cosine from {source}),
    g as (select s.*, {BUCKET[by]} as group_value, l.decision from s left join latest l on s.candidate_id = l.candidate_id and s.user_id = l.user_id),
    groups as (select group_value, count(*) as candidates_total, count(*) filter (final_rank <= 2) as candidates_selected, round(count(*) filter (final_rank <= 2) / count(*), 6) as selection_rate,
    round(avg(score), 4) as mean_score, round(avg(cosine), 4) as mean_cosine, round(avg(years), 4) as mean_years, count(*) filter (decision in ('accept', 'interview')) as feedback_positive,
    count(*) filter (decision = 'reject') as feedback_negative, round(count(*) filter (decision in ('accept', 'interview')) / nullif(count(decision), 0), 6) as positive_rate from g group by group_value)"""


def _fairness(by: str):
    @query(f"fairness_{by}", f"{H}, {_fairness_sql(by)} select * from groups")
    def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
        return reports.fairness(fx.candidates(spark, sf_dir), feedback_latest(spark, sf_dir), 2, by)

    return groups


GROUPS = {by: _fairness(by) for by in BUCKET}


@query("fairness_stored", H + " " + " union all ".join(f"select '{by}' as grouping, * from (with {_fairness_sql(by)} select * from groups)" for by in BUCKET))
def fairness_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three groupings of candidates whose snapshots were stored as VARIANT."""
    stored = written(parsed_snapshots(fx.candidates(spark, sf_dir)), "candidates")
    return reports.fairness_groupings(stored, feedback_latest(spark, sf_dir), 2)


@query("parity_ratio", f"""{H}, {_fairness_sql("experience")}, able as (select * from groups where group_value <> 'unknown' and candidates_total >= 5)
    select count(*) as eligible_groups, case when count(*) >= 2 and max(selection_rate) > 0 then round(min(selection_rate) / max(selection_rate), 6) end as parity_ratio,
    case when count(*) >= 2 and max(selection_rate) > 0 then (select group_value from able order by selection_rate desc, group_value limit 1) end as reference_group,
    coalesce(case when count(*) >= 2 and max(selection_rate) > 0 then round(min(selection_rate) / max(selection_rate), 6) end < 0.8, false) as below_threshold from able""")
def parity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.parity(GROUPS["experience"](spark, sf_dir))


@query("audit_scope", f"""{H}, k as (select run_id from runs qualify row_number() over (partition by user_id order by created_at desc, run_id desc) <= 30), scoped as (select * from candidates where run_id in (select run_id from k)),
    {_fairness_sql("experience", "scoped")} select * from groups""")
def audit_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = reports.audit_scope(fx.candidates(spark, sf_dir), fx.runs(spark, sf_dir), 30)
    return reports.fairness(scoped, feedback_latest(spark, sf_dir), 2, "experience")


KEYS = fb.REQUIRED_KEYS
PAIRS_SQL = f"""{LATEST_SQL}, fp as (select coalesce(nullif(case when l.run_id % 3 = 0 then '' else (l.run_id // 8)::varchar end, ''), r.vacancy_id::varchar, l.run_id::varchar) as job_id, resume_id::varchar as resume_id,
    case decision when 'reject' then 0 when 'maybe' then 2 when 'accept' then 3 when 'interview' then 4 end as final_label, {", ".join(f"{_json(k)} as {k}" for k in KEYS)}, 0.5::double as ce_score, final_rank as retrieval_rank, 'feedback' as origin
    from latest l join runs r using (run_id)), fpairs as (select * from fp where {" and ".join(f"{k} is not null" for k in KEYS)})"""


def _feedback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = fx.feedback(spark, sf_dir).drop("created_at")
    last = st.latest_rows(latest.select("user_id", "candidate_id", "feedback_id", "run_id", "resume_id", "decision", "final_rank", "feature_snapshot", "updated_at"), ["user_id", "candidate_id"], ["updated_at", "feedback_id"])
    keyed = last.join(fx.runs(spark, sf_dir).select("run_id", "vacancy_id"), "run_id").withColumn("existing_job_id", F.expr("case when run_id % 3 = 0 then '' else cast(run_id div 8 as string) end"))
    return fb.feedback_pairs(keyed)


@query("feedback_pairs", f"{H}, {PAIRS_SQL} select * from fpairs")
def feedback_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _feedback_pairs(spark, sf_dir)


MERGED_SQL = f"""{PAIRS_SQL}, teacher as (select (run_id // 8)::varchar as job_id, resume_id::varchar as resume_id, (run_id % 5)::int as final_label from (select * from candidates where final_rank <= 3)),
merged as (select job_id, resume_id, final_label, 'teacher' as origin, 1.0::double as weight from teacher t where not exists (select 1 from fpairs f where f.job_id = t.job_id and f.resume_id = t.resume_id)
    union all select job_id, resume_id, final_label, origin, 4.0::double from fpairs)"""


@query("merged_training", f"{H}, {MERGED_SQL} select * from merged")
def merged_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    teacher = fx.candidates(spark, sf_dir).where("final_rank <= 3").selectExpr("cast(run_id div 8 as string) as job_id", "cast(resume_id as string) as resume_id", "cast(run_id % 5 as int) as final_label")
    return fb.merge_pairs(teacher, _feedback_pairs(spark, sf_dir)).select("job_id", "resume_id", "final_label", "origin", "weight")


@query("origin_summary", f"{H}, {MERGED_SQL} select origin, final_label, count(*) as rows, sum(weight) as weight from merged group by origin, final_label")
def origin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fb.origin_summary(merged_training(spark, sf_dir))


@query("replayed_hits", """with p as (select l_orderkey as job_id, l_partkey as resume_id, row_number() over (partition by l_orderkey order by l_partkey, l_linenumber, l_suppkey)::int as position,
    case when l_partkey % 7 = 0 then null when l_partkey % 5 = 0 then 'x' else (l_partkey % 4)::varchar end as retrieval_rank from lineitem),
    r as (select *, case when retrieval_rank is null then position else coalesce(try_cast(retrieval_rank as int), 999999) end as replay_rank from p)
    select job_id, resume_id, replay_rank, row_number() over (partition by job_id order by replay_rank, position)::int as replay_order from r qualify replay_order <= 3""")
def replayed_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    saved = fx.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as job_id", "l_partkey as resume_id", "cast(row_number() over (partition by l_orderkey order by l_partkey, l_linenumber, l_suppkey) as int) as position",
        "case when l_partkey % 7 = 0 then null when l_partkey % 5 = 0 then 'x' else cast(l_partkey % 4 as string) end as retrieval_rank",
    )
    return tables.replay_hits(saved, 3).select("job_id", "resume_id", "replay_rank", "replay_order")


def _prompt_sql(mode: str) -> str:
    """Whole prompts: the vacancy's first 400 characters, trimmed, a card for each of the first three, heading and task."""
    heading, task = (t.replace("'", "''") for t in shortlist.TASKS[mode])
    return f"""{H}, k as (select c.*, r.vacancy_id, {_json("resume_years_experience")} as years, {_json("skill_overlap_ratio")} as ratio, {_json("job_years_required")} as asked
        from candidates c join runs r using (run_id) where final_rank <= 3),
    c as (select k.*, coalesce(v.title, 'open vacancy') as title, v.description, printf('Candidate #%d  (score: %.1f%%)', final_rank, (100 - final_rank)::double)
        || case when years is not null and asked is not null then chr(10) || printf('  Experience: %.1f yrs  (required: %.1f yrs)', years, asked) else '' end
        || case when ratio is not null then chr(10) || printf('  Skill coverage: %.0f%%', ratio * 100) else '' end
        || chr(10) || '  Matched skills: sql, spark' || case when resume_id % 2 = 0 then chr(10) || '  Missing skills: go' else '' end
        || case when resume_id % 3 = 0 then chr(10) || '  Fits.' else '' end || case when resume_id % 5 = 0 then chr(10) || '  Strengths: a, b, c' || chr(10) || '  Weaknesses: d' else '' end as card
        from k left join vacancies v on v.vacancy_id = k.vacancy_id)
    select run_id, 'Vacancy: ' || any_value(title) || chr(10) || 'Description: ' || coalesce(any_value(regexp_replace(description[1:400], '^\\s+|\\s+$', '', 'g')), '') || chr(10) || chr(10)
        || replace('{heading}', '{{n}}', count(*)::varchar) || chr(10) || chr(10) || string_agg(card, chr(10) || chr(10) order by final_rank) || chr(10) || chr(10) || replace('{task}', '{{n}}', count(*)::varchar) as prompt
    from c group by run_id"""


def _prompts(mode: str):
    @query("prompts" if mode == "compare" else f"prompts_{mode}", _prompt_sql(mode))
    def made(spark: SparkSession, sf_dir: str) -> DataFrame:
        words = F.array().cast("array<string>")
        vacancies = fx.vacancies(spark, sf_dir).select("vacancy_id", "title", "description")
        about = fx.runs(spark, sf_dir).select("run_id", "vacancy_id").join(vacancies, "vacancy_id", "left").select("run_id", F.coalesce("title", F.lit("open vacancy")).alias("job_title"), F.col("description").alias("job_description"))
        shown = fx.candidates(spark, sf_dir).where("final_rank <= 3")
        snapshot = snapshot_fields(shown, "resume_years_experience double, job_years_required double, skill_overlap_ratio double")
        cards = shown.withColumn("s", snapshot).join(about, "run_id").select(
            "run_id", "job_title", "job_description", "final_rank", ((100 - F.col("final_rank")) / 100.0).alias("final_fusion_score"), "s.*", F.array(F.lit("sql"), F.lit("spark")).alias("matched_skills"),
            F.when(F.col("resume_id") % 2 == 0, F.array(F.lit("go"))).otherwise(words).alias("missing_skills"), F.when(F.col("resume_id") % 3 == 0, F.lit("Fits.")).alias("experience_summary"),
            F.when(F.col("resume_id") % 5 == 0, F.array(*map(F.lit, "abcx"))).alias("strengths"), F.when(F.col("resume_id") % 5 == 0, F.array(F.lit("d"))).alias("weaknesses"),
        )
        return shortlist.prompts(cards, mode)

    return made


PROMPTS = {mode: _prompts(mode) for mode in shortlist.TASKS}


@query("loaded_feedback", f"""{H} select candidate_id, f.user_id, decision, rating, f.updated_at, f.run_id, resume_id, final_rank, case when f.run_id % 3 = 0 then '' else (f.run_id // 8)::varchar end as existing_job_id, r.vacancy_id
    from feedback f join runs r using (run_id) where decision in ('accept', 'interview')""")
def loaded_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feedback of two decisions with its candidate and run, read from the three tables."""
    runs = fx.runs(spark, sf_dir).selectExpr("run_id as id", "case when run_id % 3 = 0 then '' else cast(run_id div 8 as string) end as existing_job_id", "vacancy_id")
    shown = fx.candidates(spark, sf_dir).withColumnRenamed("candidate_id", "id")
    return tables.read_feedback(fx.feedback(spark, sf_dir), shown, runs, ["accept", "interview"]).drop("feature_snapshot")


@query("search_documents", """select vec_id as resume_id, text as resume_text, len(regexp_extract_all(text, '[a-z]{9,}'))::int as skills, (vec_id % 15)::double as resume_years_experience, len(embedding)::int as size
    from embeddings join documents on doc_id = vec_id""")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search documents of the profiles that have a vector."""
    vectors = fx.table(spark, sf_dir, "embeddings").selectExpr("vec_id as resume_id", "embedding")
    profiles = fx.table(spark, sf_dir, "documents").selectExpr(
        "doc_id as resume_id", "text as resume_text", "regexp_extract_all(text, '[a-z]{9,}', 0) as resume_skills_norm", "array(lang) as resume_titles_norm", "cast(doc_id % 15 as double) as resume_years_experience"
    ).join(vectors.select("resume_id"), "resume_id", "left_semi")
    found = tables.search_documents(profiles, vectors)
    return found.select("resume_id", "resume_text", F.size("resume_skills_norm").alias("skills"), "resume_years_experience", F.size("embedding").alias("size"))


def _measures(rows: str) -> str:
    return f"count(*) as requests, round(avg(case when status_code >= 500 then 1.0::double else 0 end), 6) as error_rate, round(quantile_cont(latency_ms, 0.5), 6) as latency_ms_p50, round(quantile_cont(latency_ms, 0.95), 6) as latency_ms_p95 from {rows}"


@query("request_metrics", f"with {fx.REQUEST_SQL} select method || ' ' || path as endpoint, {_measures('requests')} group by 1 union all select '*', {_measures('requests')}")
def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.request_metrics(fx.requests(spark, sf_dir))


@query("request_metrics_recent", f"""with {fx.REQUEST_SQL}, n as (select * from requests order by ts desc, event_id desc limit 5000)
    select count(*) as requests, round(avg(case when status_code >= 500 then 1.0::double else 0 end), 6) as error_rate, (select round(quantile_cont(latency_ms, 0.5), 6) from n) as latency_ms_p50,
    (select round(quantile_cont(latency_ms, 0.95), 6) from n) as latency_ms_p95 from requests""")
def request_metrics_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.recent_request_metrics(fx.requests(spark, sf_dir))


_RECORDED = "event_id, ts, method, case when event_id % 7 = 0 then '/ui/page' else path end as path, case when event_id % 11 = 0 then null else status_code end as status_code, latency_ms"


@query("request_metrics_recorded", f"""with {fx.REQUEST_SQL}, raw as (select {_RECORDED} from requests), r as (select * replace (coalesce(status_code, 500) as status_code) from raw where not starts_with(path, '/ui'))
    select method || ' ' || path as endpoint, {_measures('r')} group by 1 union all select '*', {_measures('r')}""")
def request_metrics_recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of pages among them, and some that ended by an exception."""
    return st.request_metrics(fx.requests(spark, sf_dir).selectExpr(*fx._split_fields(_RECORDED)))


@query("latency_quantiles", f"""with {fx.REQUEST_SQL}, p(point) as (values (0.01::double), (0.5), (0.95), (0.999)), l as (select path, list(latency_ms order by latency_ms) as x from requests where latency_ms is not null group by path)
    select path, point, round(x[1 + floor(point * (len(x) - 1))::int] * (1 - (point * (len(x) - 1) - floor(point * (len(x) - 1)))) + x[1 + ceil(point * (len(x) - 1))::int] * (point * (len(x) - 1) - floor(point * (len(x) - 1))), 6) as latency_ms from l, p""")
def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of every path by narrowing ranges."""
    rows = written(fx.requests(spark, sf_dir).select("path", "latency_ms"), "latencies")
    found = quantiles.exact_quantiles(rows, "latency_ms", [0.01, 0.5, 0.95, 0.999], "path")
    return found.select("path", "point", F.round("value", 6).alias("latency_ms"))


@query("request_rollup", f"""with {fx.REQUEST_SQL} select method || ' ' || path as endpoint, date_trunc('day', ts)::date as day, count(*) as requests, round(avg(case when status_code >= 500 then 1.0::double else 0 end), 6) as error_rate,
    true as p50_near, true as p95_near from requests group by all""")
def request_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day's measures of every endpoint, merged from stored hours; whether the percentiles' ranks are within 3 % (or two requests) of exact ones."""
    requests = fx.requests(spark, sf_dir)
    stored = written(sketches.latency_sketches(requests, "1 hour"), "hours")
    days = sketches.sketched_metrics(sketches.rolled_up(stored, "endpoint", F.to_date("start").alias("day")))
    ranked = requests.select(F.concat_ws(" ", "method", "path").alias("endpoint"), F.to_date("ts").alias("day"), "latency_ms").join(days, ["endpoint", "day"])
    near = [
        (F.abs(F.avg((F.col("latency_ms") <= F.col(c)).cast("double")) - p) <= F.greatest(F.lit(0.03), 2 / F.count("*"))).alias(n)
        for c, p, n in (("latency_ms_p50", 0.5, "p50_near"), ("latency_ms_p95", 0.95, "p95_near"))
    ]
    return ranked.groupBy("endpoint", "day", "requests", F.round("error_rate", 6).alias("error_rate")).agg(*near)


# a request's log is that of the request before it in its user's order, so the oracle goes through them one by one
def limiter_sql(window: int, source: str = fx.REQUEST_SQL) -> str:
    return f"""with recursive {source}, o as (select user_id, event_id, epoch_us(ts) / 1000000 as moment, row_number() over (partition by user_id order by ts, event_id) as turn from requests),
step as (select user_id, event_id, turn, [moment] as log, true as allowed, 4 as remaining, 0.0::double as retry_after from o where turn = 1
    union all select user_id, event_id, turn, case when len(log) < 5 then list_append(log, moment) else log end, len(log) < 5, greatest(4 - len(log), 0), case when len(log) < 5 then 0 else greatest(0, log[1] + {window} - moment) end
    from (select o.user_id, o.event_id, o.turn, o.moment, list_filter(s.log, lambda t: t >= o.moment - {window}) as log from step s join o on o.user_id = s.user_id and o.turn = s.turn + 1))
select user_id, event_id, allowed, remaining::int as remaining, round(retry_after, 6) as retry_after from step"""


_BURST_MICROS = "1704067200000000 + event_id * 400000 + event_id % 5 * 7000000"


@query("limiter_log_180", limiter_sql(180, f"requests as (select event_id, event_id % 64 as user_id, make_timestamp({_BURST_MICROS}) as ts from events)"))
def limiter_log_180(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five admissions in three minutes, over all events as requests of 64 users about 26 seconds apart."""
    return st.limiter_log(fx.table(spark, sf_dir, "events").selectExpr("event_id", "event_id % 64 as user_id", f"timestamp_micros({_BURST_MICROS}) as ts"))


@query("limiter_log", limiter_sql(86_400))
def limiter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five admissions a day and user."""
    return st.limiter_log(fx.requests(spark, sf_dir), 5, 86_400.0)


@query("clean_numbers", "select event_id, coalesce(try_cast(case when event_id % 4 = 0 then 'n/a' when event_id % 4 = 1 then value::varchar else null end as double), 0) as number from events")
def clean_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = F.expr("case when event_id % 4 = 0 then 'n/a' when event_id % 4 = 1 then cast(value as string) end")
    return fx.table(spark, sf_dir, "events").select("event_id", tx.number_or(cell).alias("number"))
