"""Reviewers' feedback as training pairs, merged with the scored ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.snapshots import snapshot_fields

# Labels of decisions, snapshot keys a training pair must have, weights and the least number of rows.
DECISION_LABEL = {"reject": 0, "maybe": 2, "accept": 3, "interview": 4}
REQUIRED_KEYS = [
    "embedding_cosine", "skill_overlap_count", "skill_overlap_ratio", "title_overlap_ratio", "years_gap", "experience_match_flag",
    "resume_years_experience", "job_years_required",
]
DEFAULT_SCORE, FEEDBACK_WEIGHT, TEACHER_WEIGHT, LEAST_ROWS = 0.5, 4.0, 1.0, 20
SNAPSHOT_SCHEMA = ", ".join(f"{k} double" for k in REQUIRED_KEYS)


def decision_label(decision: Column) -> Column:
    """The label of a decision; null for an unknown one."""
    return reduce(lambda c, kv: c.when(decision == kv[0], kv[1]), DECISION_LABEL.items(), F.when(F.lit(False), 0))


def group_key(*columns: str) -> Column:
    """The first of the columns that is not empty."""
    return F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])


def feedback_pairs(feedback: DataFrame) -> DataFrame:
    """Training pairs from feedback rows with a feature_snapshot (JSON or VARIANT); rows lacking a required key or a label go.

    feedback: run_id, vacancy_id, existing_job_id, resume_id, decision, final_rank, feature_snapshot.
    """
    parsed = feedback.withColumn("snapshot", snapshot_fields(feedback, SNAPSHOT_SCHEMA))
    pairs = parsed.select(
        group_key("existing_job_id", "vacancy_id", "run_id").alias("job_id"), F.col("resume_id").cast("string").alias("resume_id"),
        decision_label(F.col("decision")).alias("final_label"), *[F.col(f"snapshot.{k}").alias(k) for k in REQUIRED_KEYS],
        F.lit(DEFAULT_SCORE).alias("ce_score"), F.coalesce(F.col("final_rank").cast("int"), F.lit(0)).alias("retrieval_rank"), F.lit("feedback").alias("origin"),
    )
    return pairs.dropna(subset=["job_id", "resume_id", "final_label", *REQUIRED_KEYS])


def merge_pairs(teacher: DataFrame, feedback: DataFrame, feedback_weight: float = FEEDBACK_WEIGHT) -> DataFrame:
    """Both sets with row weights; feedback stands for a pair that both have. Columns of one side only are null on the other."""
    rest = teacher.join(feedback.select("job_id", "resume_id").distinct(), ["job_id", "resume_id"], "left_anti").withColumn("origin", F.lit("teacher"))
    both = rest.unionByName(feedback, allowMissingColumns=True)
    return both.withColumn("weight", F.when(F.col("origin") == "feedback", feedback_weight).otherwise(TEACHER_WEIGHT))


def require_feedback(feedback: DataFrame, least: int = LEAST_ROWS) -> None:
    """Refuse to retrain on fewer rows than `least`."""
    found = feedback.limit(least).count()
    if found < least:
        raise ValueError(f"{found} feedback rows, {least} are needed")


def origin_summary(merged: DataFrame) -> DataFrame:
    """Rows and weight by origin and label."""
    return merged.groupBy("origin", "final_label").agg(F.count("*").alias("rows"), F.sum("weight").alias("weight"))
