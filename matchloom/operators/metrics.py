"""Ranking metrics of each opening and their means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (5, 10, 15, 20)
RELEVANT = 1


def _discount(position: str, k: int) -> Column:
    return F.when(F.col(position) <= k, 1 / F.log2(F.col(position) + 1.0)).otherwise(0.0)


def ndcg(pairs: DataFrame, pred: str = "pred", ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """job_id and ndcg_k: gain is the label, ties of the prediction share their mean; null for one distinct label.

    One sort by prediction and one by label serve all cut-offs.
    """
    job = Window.partitionBy("job_id")
    placed = pairs.withColumn("place", F.row_number().over(job.orderBy(F.desc(pred), "resume_id"))).withColumn("ideal", F.row_number().over(job.orderBy(F.desc("final_label"), "resume_id")))
    ties = placed.groupBy("job_id", pred).agg(
        F.avg("final_label").alias("gain"), *[F.sum(_discount("place", k)).alias(f"d{k}") for k in ks], *[F.sum(F.col("final_label") * _discount("ideal", k)).alias(f"i{k}") for k in ks],
        F.min("final_label").alias("lo"), F.max("final_label").alias("hi"),
    )
    ratio = [F.when(F.max("hi") > F.min("lo"), F.round(F.sum(F.col("gain") * F.col(f"d{k}")) / F.sum(f"i{k}"), 6)).alias(f"ndcg_{k}") for k in ks]
    return ties.groupBy("job_id").agg(*ratio)


def hits(pairs: DataFrame, pred: str = "pred", ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """job_id, rows, precision_k (over k), recall_k, map, mrr; 0 where nothing is relevant. Ties go to the smaller resume_id."""
    order = Window.partitionBy("job_id").orderBy(F.desc(pred), "resume_id")
    rel = F.when(F.col("final_label") >= RELEVANT, 1).otherwise(0)
    placed = pairs.withColumn("rel", rel).withColumn("place", F.row_number().over(order))
    placed = placed.withColumn("seen", F.sum("rel").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    found = {k: F.sum(F.when(F.col("place") <= k, F.col("rel")).otherwise(0)) for k in ks}
    relevant = F.sum("rel")
    return placed.groupBy("job_id").agg(
        F.count("*").alias("rows"), *[F.round(found[k] / F.lit(float(k)), 6).alias(f"precision_{k}") for k in ks],
        *[F.round(F.coalesce(found[k] / F.nullif(relevant, F.lit(0)), F.lit(0.0)), 6).alias(f"recall_{k}") for k in ks],
        F.round(F.coalesce(F.sum(F.when(F.col("rel") == 1, F.col("seen") / F.col("place"))) / F.nullif(relevant, F.lit(0)), F.lit(0.0)), 6).alias("map"),
        F.round(F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("place"))), F.lit(0.0)), 6).alias("mrr"),
    )


def per_job_metrics(pairs: DataFrame, pred: str = "pred", ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """One row per opening with all metrics."""
    return hits(pairs, pred, ks).join(ndcg(pairs, pred, ks), "job_id")


def overall_metrics(pairs: DataFrame, pred: str = "pred", ks: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Means over openings (null NDCG left out), numbers of openings and rows."""
    names = [f"{m}_{k}" for m in ("ndcg", "precision", "recall") for k in ks] + ["map", "mrr"]
    means = [F.round(F.coalesce(F.avg(n), F.lit(0.0)), 6).alias(n) for n in names]
    return per_job_metrics(pairs, pred, ks).agg(*means, F.count("*").alias("groups"), F.sum("rows").alias("rows"))
