"""Reading openings, profiles and vectors; writing tables, search documents and shortlist runs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT_KEYS = [
    "embedding_cosine", "skill_overlap_count", "skill_overlap_ratio", "title_overlap_ratio", "resume_years_experience", "job_years_required",
    "years_gap", "experience_match_flag", "retrieval_score_raw", "retrieval_score_norm", "reranker_score_raw", "reranker_score_norm",
]
SEARCH_COLUMNS = ["resume_id", "resume_text", "resume_skills_norm", "resume_titles_norm", "resume_years_experience", "embedding"]
LAST_RANK = 999_999


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header whose texts may hold line breaks and doubled quotes."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')


_own_roots: dict[str, str] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); on one machine, a temporary folder where it is unset."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        root = _own_roots[app] = _own_roots.get(app) or "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder and read again: worked out once, its size known to the planner, safe from lost executors."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in the file system that Spark reads it from."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def read_first(spark: SparkSession, parquet: list[str], csv: list[str], label: str, schema: str | None = None) -> DataFrame:
    """The first table that exists, Parquet before CSV; an error that names every candidate if none does."""
    for path in parquet:
        if path_exists(spark, path):
            return spark.read.parquet(path)
    for path in csv:
        if path_exists(spark, path):
            return read_csv(spark, path, schema) if schema else spark.read.csv(path, header=True, multiLine=True, escape='"')
    raise FileNotFoundError(f"{label}: none of {', '.join([*parquet, *csv])} exists")


def attach_vectors(rows: DataFrame, vectors: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """Rows with their vectors; fails when a row has none, or when vectors differ in length."""
    missing = rows.join(vectors, key, "left_anti").count()
    if missing:
        raise ValueError(f"{missing} rows have no vector")
    sizes = vectors.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if sizes[0] != sizes[1]:
        raise ValueError(f"vectors have {sizes[0]} to {sizes[1]} components")
    return rows.join(vectors, key)


def write_table(rows: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Overwrite a table as Parquet, CSV (with a header) or JSON lines."""
    writer = rows.write.mode("overwrite").format(kind).partitionBy(*(partition_by or []))
    (writer.option("header", True).option("escape", '"') if kind == "csv" else writer).save(path)


def search_documents(resumes: DataFrame, vectors: DataFrame) -> DataFrame:
    """One search document per profile: text, skills, titles, years and vector."""
    return attach_vectors(resumes, vectors, "resume_id").select(*SEARCH_COLUMNS)


def replay_hits(saved: DataFrame, top_k: int, group: str = "job_id") -> DataFrame:
    """A saved retrieval in rank order, the first top_k of each group.

    saved has `position` (its row number), and perhaps retrieval_rank: a missing rank is the row number,
    one that is no number comes last.
    """
    if "retrieval_rank" in saved.columns:
        rank = F.when(F.col("retrieval_rank").isNull(), F.col("position")).otherwise(F.coalesce(F.col("retrieval_rank").try_cast("int"), F.lit(LAST_RANK)))
    else:
        rank = F.col("position")
    order = Window.partitionBy(group).orderBy("replay_rank", "position")
    ranked = saved.withColumn("replay_rank", rank.cast("int"))
    return ranked.withColumn("replay_order", F.row_number().over(order)).where(F.col("replay_order") <= top_k)


def append_run(runs: DataFrame, candidates: DataFrame, runs_path: str, candidates_path: str) -> None:
    """Append runs and their candidates, with the snapshot as VARIANT, which reports read by path, and the explanation as JSON text."""
    runs.write.mode("append").parquet(runs_path)
    kept = ["run_id", "final_rank", "resume_id", "final_fusion_score", "model_score", "retrieval_rank"]
    rows = candidates.select(*kept, F.to_variant_object(F.struct(*SNAPSHOT_KEYS)).alias("feature_snapshot"), F.to_json("explanation").alias("explanation_json"))
    rows.write.mode("append").parquet(candidates_path)


def read_feedback(feedback: DataFrame, candidates: DataFrame, runs: DataFrame, decisions: list[str]) -> DataFrame:
    """Feedback of the given decisions with its candidate and run; also for tables read with spark.read.jdbc."""
    chosen = feedback.where(F.col("decision").isin(decisions)).select("candidate_id", "user_id", "decision", "rating", "updated_at")
    shown = candidates.select(F.col("id").alias("candidate_id"), "run_id", "resume_id", "final_rank", "feature_snapshot")
    of_run = runs.select(F.col("id").alias("run_id"), "existing_job_id", "vacancy_id")
    return chosen.join(shown, "candidate_id").join(of_run, "run_id")
