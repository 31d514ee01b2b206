"""History, boards, catalogues and the fairness audit: joins and grouped aggregates over runs and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.snapshots import snapshot_fields
from matchloom.functions.text import preview

# Limits, statuses, buckets and thresholds of the reports.
STATUS_OF = {"accept": "screened", "interview": "interview", "reject": "rejected", "maybe": "new"}
STATUSES = ["new", "screened", "interview", "offer", "hired", "rejected"]
SNAPSHOT_FIELDS = "resume_years_experience double, skill_overlap_count double, experience_match_flag int, embedding_cosine double"
BOARD_FIELDS = "skill_overlap_ratio double, resume_years_experience double, embedding_cosine double, title_overlap_ratio double"
LEAST_GROUP, PARITY_LIMIT = 5, 0.8
MAX_RUNS_LISTED, MAX_VACANCIES_LISTED, MAX_RUNS_AUDITED = 200, 500, 1000


def clamp(value: int, most: int) -> int:
    return max(1, min(most, value))


def run_list(runs: DataFrame, vacancies: DataFrame, limit: int) -> DataFrame:
    """Each user's newest runs with the vacancy's title and a preview, newest first. Ties in time go to the larger id."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    kept = runs.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= clamp(limit, MAX_RUNS_LISTED))
    shown = vacancies.select("vacancy_id", "title", preview(F.col("description"), 180).alias("preview"))
    return kept.join(shown, "vacancy_id", "left")


def vacancy_list(vacancies: DataFrame, runs: DataFrame, limit: int) -> DataFrame:
    """Each owner's newest vacancies with the number of runs and the last run (0 and null for none)."""
    per = runs.groupBy("vacancy_id").agg(F.count("*").alias("run_count"), F.max("created_at").alias("last_run_at"))
    newest = Window.partitionBy("owner_user_id").orderBy(F.desc("created_at"), F.desc("vacancy_id"))
    listed = vacancies.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= clamp(limit, MAX_VACANCIES_LISTED))
    return listed.join(per, "vacancy_id", "left").withColumn("run_count", F.coalesce("run_count", F.lit(0)))


def run_detail(runs: DataFrame, candidates: DataFrame, analyses: DataFrame) -> DataFrame:
    """Runs with an array of their candidates by rank and a map of analyses by mode."""
    shown = candidates.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("final_rank", "resume_id", "score"))).alias("candidates"))
    texts = latest_analyses(analyses).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("mode", "content"))).alias("analyses"))
    return runs.join(shown, "run_id", "left").join(texts, "run_id", "left")


def latest_analyses(analyses: DataFrame) -> DataFrame:
    """The latest analysis of each run and mode."""
    return analyses.groupBy("run_id", "mode").agg(F.max_by(F.struct("content", "created_at"), F.struct("created_at", "analysis_id")).alias("last")).select("run_id", "mode", "last.*")


def feedback_latest(feedback: DataFrame) -> DataFrame:
    """One row per user and candidate: the last decision, rating and note, the first creation time."""
    moment = F.struct("updated_at", "feedback_id")
    rows = feedback.groupBy("user_id", "candidate_id").agg(
        F.max_by(F.struct("decision", "rating", "note", "updated_at"), moment).alias("last"), F.min("updated_at").alias("created_at")
    )
    return rows.select("user_id", "candidate_id", "last.decision", "last.rating", "last.note", "created_at", "last.updated_at")


def feedback_by_run(feedback: DataFrame, candidates: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Feedback with the run and rank of its candidate, without the deleted keys (user_id, candidate_id)."""
    kept = feedback if deleted is None else feedback.join(deleted, ["user_id", "candidate_id"], "left_anti")
    return kept.join(candidates.select("candidate_id", "run_id", "final_rank"), "candidate_id")


def status_of(decision: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_OF.items() for x in kv]), decision)


def board(feedback: DataFrame) -> DataFrame:
    """One entry per user, run and profile: status and note of the last feedback; score, rank, title and snapshot of the first.

    The snapshot holds the BOARD_FIELDS of the feedback's feature_snapshot, {} if it has none that can be read.
    """
    first, last = F.struct("created_at", "feedback_id"), F.struct("updated_at", "feedback_id")
    kept = F.coalesce(F.to_json(snapshot_fields(feedback, BOARD_FIELDS)), F.lit("{}")).alias("candidate_snapshot")
    rows = feedback.groupBy("user_id", "run_id", "resume_id").agg(
        F.min_by(F.struct("score", "final_rank", "job_title", "feature_snapshot"), first).alias("first"), F.max_by(F.struct("decision", "note", "updated_at"), last).alias("last"), F.min("created_at").alias("created_at"),
    )
    flat = rows.select("user_id", "run_id", "resume_id", "first.*", status_of(F.col("last.decision")).alias("kanban_status"), "last.note", "created_at", "last.updated_at")
    return flat.select("user_id", "run_id", "resume_id", "job_title", "final_rank", "score", "kanban_status", "note", kept, "created_at", "updated_at")


def board_counts(entries: DataFrame) -> DataFrame:
    """Entries of each user in each of the six statuses, zeros included."""
    counts = entries.groupBy("user_id").pivot("kanban_status", STATUSES).count()
    filled = counts.select("user_id", *[F.coalesce(F.col(s), F.lit(0)).alias(s) for s in STATUSES])
    return filled.select("user_id", F.explode(F.array(*[F.struct(F.lit(s).alias("kanban_status"), F.col(s).alias("entries")) for s in STATUSES])).alias("e")).select("user_id", "e.*")


def job_catalogue(jobs: DataFrame) -> DataFrame:
    """Openings with two skills or more, with a preview."""
    return jobs.where(F.size("job_skills_norm") >= 2).select("job_id", "job_title", preview(F.col("job_description"), 220).alias("preview"), F.size("job_skills_norm").alias("skills"))


def totals(jobs: DataFrame, resumes: DataFrame) -> DataFrame:
    return jobs.agg(F.count("*").alias("total_jobs")).crossJoin(resumes.agg(F.count("*").alias("total_resumes")))


def experience_bucket(years: Column) -> Column:
    return F.when(years.isNull(), "unknown").when(years < 1, "0-1y").when(years < 3, "1-3y").when(years < 6, "3-6y").when(years < 10, "6-10y").otherwise("10y+")


def skill_bucket(count: Column) -> Column:
    whole = F.floor(count)
    return F.when(count.isNull(), "unknown").when(whole <= 0, "0").when(whole <= 2, "1-2").when(whole <= 5, "3-5").when(whole <= 10, "6-10").otherwise("11+")


def match_bucket(flag: Column) -> Column:
    return F.when(flag.isNull(), "unknown").when(flag == 1, "meets").otherwise("below")


def bucketed(candidates: DataFrame, by: str) -> DataFrame:
    """Candidates with the snapshot parsed once and group_value of the grouping: experience, skill or match."""
    parsed = candidates.withColumn("s", snapshot_fields(candidates, SNAPSHOT_FIELDS))
    return parsed.withColumn("group_value", _buckets()[by]).selectExpr(*_AUDITED, "group_value")


_AUDITED = ["run_id", "candidate_id", "user_id", "final_rank", "score", "s.embedding_cosine as cosine", "s.resume_years_experience as years"]


def _buckets() -> dict[str, Column]:
    return {"experience": experience_bucket(F.col("s.resume_years_experience")), "skill": skill_bucket(F.col("s.skill_overlap_count")), "match": match_bucket(F.col("s.experience_match_flag"))}


def fairness(candidates: DataFrame, feedback: DataFrame, cutoff: int, by: str) -> DataFrame:
    """Selection and feedback by group. feedback: candidate_id, user_id, decision (one row each)."""
    joined = bucketed(candidates, by).join(feedback.select("candidate_id", "user_id", "decision"), ["candidate_id", "user_id"], "left")
    return _audited(joined, cutoff, "group_value")


def fairness_groupings(candidates: DataFrame, feedback: DataFrame, cutoff: int) -> DataFrame:
    """Selection and feedback by all three groupings at once, named in `grouping`: snapshots are read, and feedback joined, once."""
    parsed = candidates.withColumn("s", snapshot_fields(candidates, SNAPSHOT_FIELDS))
    groups = F.array(*[F.struct(F.lit(name).alias("grouping"), value.alias("group_value")) for name, value in _buckets().items()])
    joined = parsed.selectExpr(*_AUDITED, "s").withColumn("groups", groups).drop("s")
    joined = joined.join(feedback.select("candidate_id", "user_id", "decision"), ["candidate_id", "user_id"], "left")
    return _audited(joined.select("*", F.inline("groups")), cutoff, "grouping", "group_value")


def _audited(joined: DataFrame, cutoff: int, *keys: str) -> DataFrame:
    good, bad = F.col("decision").isin("accept", "interview"), F.col("decision") == "reject"
    chosen = F.count_if(F.col("final_rank") <= cutoff)
    return joined.groupBy(*keys).agg(
        F.count("*").alias("candidates_total"), chosen.alias("candidates_selected"), F.round(chosen / F.count("*"), 6).alias("selection_rate"),
        F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.avg("cosine"), 4).alias("mean_cosine"), F.round(F.avg("years"), 4).alias("mean_years"),
        F.count_if(good).alias("feedback_positive"), F.count_if(bad).alias("feedback_negative"),
        F.round(F.count_if(good) / F.nullif(F.count("decision"), F.lit(0)), 6).alias("positive_rate"),
    )


def parity(groups: DataFrame) -> DataFrame:
    """Least over largest selection rate of the known groups with enough rows; null for one group or a largest rate of 0."""
    able = groups.where((F.col("group_value") != "unknown") & (F.col("candidates_total") >= LEAST_GROUP))
    sums = able.agg(F.count("*").alias("groups"), F.min("selection_rate").alias("lo"), F.max("selection_rate").alias("hi"), F.min_by("group_value", F.struct(-F.col("selection_rate"), "group_value")).alias("best"))
    fine = (F.col("groups") >= 2) & (F.col("hi") > 0)
    ratio = F.when(fine, F.round(F.col("lo") / F.nullif(F.col("hi"), F.lit(0.0)), 6))
    return sums.select(F.col("groups").alias("eligible_groups"), ratio.alias("parity_ratio"), F.when(fine, F.col("best")).alias("reference_group"), F.coalesce(ratio < PARITY_LIMIT, F.lit(False)).alias("below_threshold"))


def audit_scope(candidates: DataFrame, runs: DataFrame, newest_runs: int) -> DataFrame:
    """Candidates of each user's newest runs."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("run_id"))
    kept = runs.withColumn("_turn", F.row_number().over(newest)).where(F.col("_turn") <= clamp(newest_runs, MAX_RUNS_AUDITED))
    return candidates.join(kept, "run_id", "left_semi")
