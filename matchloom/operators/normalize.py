"""Normalised opening and profile tables, duplicate ids, clean-up report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import dedup_segments, list_cell, number_or, skill_bag

JOB_COLUMNS = ["job_id", "job_title", "job_description", "job_text", "job_skills_norm", "job_years_required"]
RESUME_COLUMNS = ["resume_id", "resume_text", "resume_skills_norm", "resume_titles_norm", "resume_years_experience"]


def first_rows(rows: DataFrame, key: str, position: Column) -> DataFrame:
    """One row for each key, the one that comes first by position."""
    order = Window.partitionBy(key).orderBy(position)
    return rows.withColumn("_turn", F.row_number().over(order)).where("_turn = 1").drop("_turn")


def _text_or_empty(rows: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in rows.columns else F.lit("")


def normalize_jobs(jobs: DataFrame, position: Column) -> DataFrame:
    """The six columns of openings, one row per job_id (the first by position); missing columns get defaults."""
    if "job_id" not in jobs.columns:
        raise ValueError("openings need a job_id column")
    title, body = _text_or_empty(jobs, "job_title"), _text_or_empty(jobs, "job_description")
    text = F.col("job_text").cast("string") if "job_text" in jobs.columns else F.concat_ws(" ", title, body)
    kept = first_rows(jobs, "job_id", position)
    return kept.select(
        F.col("job_id").cast("string").alias("job_id"), title.alias("job_title"), body.alias("job_description"), F.coalesce(text, F.lit("")).alias("job_text"),
        list_cell(_text_or_empty(jobs, "job_skills_norm")).alias("job_skills_norm"),
        number_or(_text_or_empty(jobs, "job_years_required")).cast("float").alias("job_years_required"),
    )


def normalize_resumes(resumes: DataFrame, position: Column) -> DataFrame:
    """The five columns of profiles, one row per id; the source's own column names are understood."""
    names = {"person_id": "resume_id", "total_years_experience": "resume_years_experience", "skills": "resume_skills_norm", "past_titles": "resume_titles_norm"}
    for old, new in names.items():
        if old in resumes.columns and new not in resumes.columns:
            resumes = resumes.withColumnRenamed(old, new)
    if "resume_id" not in resumes.columns:
        raise ValueError("profiles need a resume_id or person_id column")
    kept = first_rows(resumes, "resume_id", position)
    return kept.select(
        F.col("resume_id").cast("string").alias("resume_id"), _text_or_empty(resumes, "resume_text").alias("resume_text"),
        skill_bag(list_cell(_text_or_empty(resumes, "resume_skills_norm"))).alias("resume_skills_norm"),
        list_cell(_text_or_empty(resumes, "resume_titles_norm")).alias("resume_titles_norm"),
        number_or(_text_or_empty(resumes, "resume_years_experience")).cast("float").alias("resume_years_experience"),
    )


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Ids that come more than once, and how often."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str, label: str) -> None:
    """Fail with up to ten of the repeated ids."""
    found = [str(r[0]) for r in duplicate_ids(rows, key).orderBy(key).limit(10).collect()]
    if found:
        raise ValueError(f"{label}: repeated ids {', '.join(found)}")


def dedup_report(texts: DataFrame, column: str) -> DataFrame:
    """Rows changed by removing repeated segments, characters before, after and removed, percentage removed."""
    cleaned = texts.select(F.col(column).alias("old"), dedup_segments(F.col(column)).alias("new"))
    sums = cleaned.agg(
        F.count("*").alias("rows"), F.count_if(F.col("new") != F.col("old")).alias("rows_changed"),
        F.coalesce(F.sum(F.length("old")), F.lit(0)).alias("chars_before"), F.coalesce(F.sum(F.length("new")), F.lit(0)).alias("chars_after"),
    )
    removed = F.col("chars_before") - F.col("chars_after")
    share = F.when(F.col("chars_before") > 0, F.round(removed * 100.0 / F.col("chars_before"), 2)).otherwise(0.0)
    return sums.withColumn("chars_removed", removed).withColumn("percent_removed", share)
