"""Graded labels from pair scores, filters, reports, samples and group-safe splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least score of labels 1 to 4, and the score from which none holds.
LABEL_FROM = (0.25, 0.35, 0.50, 0.65)
LABEL_END = 1.01
SEED, TEST_SHARE, VALID_SHARE = 42, 0.15, 0.15


def assign_label(score: Column) -> Column:
    """0 to 4 by the score; 0 outside all buckets, as for null."""
    label = F.lit(0)
    for value, least in enumerate(LABEL_FROM, 1):
        label = F.when(score >= least, value).otherwise(label)
    return F.when((score >= 0) & (score < LABEL_END), label).otherwise(0)


def label_pairs(pairs: DataFrame, score: str = "ce_score_raw") -> DataFrame:
    """Pairs with ce_score (4 places), final_label (of the unrounded score) and within_job_rank (of the rounded one)."""
    order = Window.partitionBy("job_id").orderBy(F.desc("ce_score"), "retrieval_rank", "resume_id")
    scored = pairs.withColumn("ce_score", F.round(score, 4)).withColumn("final_label", assign_label(F.col(score)))
    return scored.withColumn("within_job_rank", F.row_number().over(order))


def label_span(pairs: DataFrame) -> DataFrame:
    """Least, largest and distinct labels of each opening, and whether it can train a ranker."""
    span = pairs.groupBy("job_id").agg(F.min("final_label").alias("label_min"), F.max("final_label").alias("label_max"), F.count_distinct("final_label").alias("label_kinds"))
    return span.withColumn("trainable", (F.col("label_max") >= 3) & (F.col("label_min") <= 1))


def trainable_pairs(pairs: DataFrame, keep_all: bool = False) -> DataFrame:
    """Pairs of the openings that can train a ranker, or all."""
    return pairs if keep_all else pairs.join(label_span(pairs).where("trainable"), "job_id", "left_semi")


def degenerate_report(pairs: DataFrame) -> DataFrame:
    """Openings without good, without bad, with one label; those that can train; the percentage of rows they keep."""
    per_job = label_span(pairs).join(pairs.groupBy("job_id").agg(F.count("*").alias("n")), "job_id")
    return per_job.agg(
        F.count("*").alias("jobs"), F.count_if(F.col("label_max") < 3).alias("no_positive"), F.count_if(F.col("label_min") > 1).alias("no_negative"),
        F.count_if(F.col("label_kinds") == 1).alias("single_label"), F.count_if("trainable").alias("trainable"),
        F.round(100.0 * F.sum(F.when(F.col("trainable"), F.col("n")).otherwise(0)) / F.sum("n"), 2).alias("rows_kept_percent"),
    )


def label_distribution(pairs: DataFrame) -> DataFrame:
    counts = pairs.groupBy("final_label").agg(F.count("*").alias("rows"))
    total = counts.agg(F.sum("rows").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("final_label", "rows", F.round(100.0 * F.col("rows") / F.col("total"), 2).alias("percent"))


def summary(rows: DataFrame, column: str, exact: bool = True) -> DataFrame:
    """count, mean, std, min, percentiles and max of a column. Exact percentiles keep all distinct values in one state; approximate ones do not."""
    points = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    quantile = F.percentile if exact else F.approx_percentile
    return rows.agg(
        F.count(column).alias("rows"), F.round(F.avg(column), 6).alias("mean"), F.round(F.stddev_samp(column), 6).alias("std"),
        F.min(column).alias("min"), *[F.round(quantile(column, q), 6).alias(name) for name, q in points.items()], F.max(column).alias("max"),
    )


def feature_summary(rows: DataFrame, columns: list[str], exact: bool = True) -> DataFrame:
    """One row per column: count, mean, std, min, quartiles, max, to three places; one aggregate over unpivoted rows."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.*")
    quantile = F.percentile if exact else F.approx_percentile
    measures = {"mean": F.avg("value"), "std": F.stddev_samp("value"), "min": F.min("value"), **{f"p{int(q * 100)}": quantile("value", q) for q in (0.25, 0.5, 0.75)}, "max": F.max("value")}
    return long.groupBy("feature").agg(F.count("value").alias("rows"), *[F.round(m, 3).alias(n) for n, m in measures.items()])


def label_spread(pairs: DataFrame) -> DataFrame:
    """Means over openings of their least, largest, mean and number of labels."""
    per_job = pairs.groupBy("job_id").agg(
        F.min("final_label").alias("lo"), F.max("final_label").alias("hi"), F.avg("final_label").alias("mid"), F.count_distinct("final_label").alias("kinds")
    )
    return per_job.agg(*[F.round(F.avg(c), 6).alias(n) for c, n in (("lo", "mean_min"), ("hi", "mean_max"), ("mid", "mean_mean"), ("kinds", "mean_kinds"))])


def label_spread_summary(pairs: DataFrame, exact: bool = True) -> DataFrame:
    """The distributions over openings of their least, largest, mean and number of labels: one row each, as in feature_summary."""
    per_job = pairs.groupBy("job_id").agg(
        F.min("final_label").alias("min_label"), F.max("final_label").alias("max_label"), F.avg("final_label").alias("mean_label"), F.count_distinct("final_label").alias("label_kinds")
    )
    return feature_summary(per_job, ["min_label", "max_label", "mean_label", "label_kinds"], exact)


def pair_summary(pairs: DataFrame) -> DataFrame:
    """Pairs of an opening: least, most, median; and the means of the base features over all pairs."""
    per_job = pairs.groupBy("job_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("pairs_min"), F.max("n").alias("pairs_max"), F.median("n").alias("pairs_median"))
    means = pairs.agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("embedding_cosine", "skill_overlap_ratio", "title_overlap_ratio", "years_gap")])
    return per_job.crossJoin(means)


def seeded_key(group: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), group.cast("string")).cast("binary"))


def sample_jobs(pairs: DataFrame, jobs: int = 3, rows: int = 10, seed: int = SEED) -> DataFrame:
    """The best rows of a few openings, chosen by a seeded order."""
    chosen = pairs.select("job_id").distinct().orderBy(seeded_key(F.col("job_id"), seed), "job_id").limit(jobs)
    return pairs.join(chosen, "job_id", "left_semi").where(F.col("within_job_rank") <= rows)


def missing_texts(pairs: DataFrame, job_texts: DataFrame, resume_texts: DataFrame) -> DataFrame:
    """How many pairs lack a score, an opening's text, a profile's text; scores are reused only if none is lacking."""
    joined = pairs.join(job_texts, "job_id", "left").join(resume_texts, "resume_id", "left")
    return joined.agg(
        F.count("*").alias("pairs"), F.count_if(F.col("ce_score_raw").isNull()).alias("unscored"),
        F.count_if(F.coalesce("job_text", F.lit("")) == "").alias("no_job_text"), F.count_if(F.coalesce("resume_text", F.lit("")) == "").alias("no_resume_text"),
    ).withColumn("reuse_scores", F.col("unscored") == 0)


def usable_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs without null keys or label, of openings with two labels or more."""
    whole = pairs.dropna(subset=["job_id", "resume_id", "final_label"])
    return whole.join(whole.groupBy("job_id").agg(F.count_distinct("final_label").alias("kinds")).where("kinds >= 2"), "job_id", "left_semi")


def group_split(pairs: DataFrame, seed: int = SEED, test_share: float = TEST_SHARE, valid_share: float = VALID_SHARE) -> DataFrame:
    """job_id, split: test takes ceil(share of all), valid ceil(its share of the rest); no opening is in two.

    Openings are ranked by a seeded digest within its first three digits, and the ranks of those buckets
    added up, so that no task sorts all openings.
    """
    keyed = pairs.select("job_id").distinct().withColumn("key", seeded_key(F.col("job_id"), seed)).withColumn("bucket", F.substring("key", 1, 3))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = keyed.groupBy("bucket").agg(F.count("*").alias("n"))
    total = buckets.agg(F.sum("n").alias("total"))
    buckets = buckets.withColumn("ahead", F.coalesce(F.sum("n").over(before), F.lit(0))).crossJoin(F.broadcast(total))
    ranked = keyed.join(buckets, "bucket").withColumn("rank", F.col("ahead") + F.row_number().over(Window.partitionBy("bucket").orderBy("key", "job_id")))
    test = F.ceil(F.round(F.col("total") * test_share, 9))
    valid = F.ceil(F.round((F.col("total") - test) * (valid_share / (1 - test_share)), 9))
    split = F.when(F.col("rank") <= test, "test").when(F.col("rank") <= test + valid, "valid").otherwise("train")
    return ranked.select("job_id", split.alias("split"))


def split_summary(pairs: DataFrame, splits: DataFrame) -> DataFrame:
    return pairs.join(splits, "job_id").groupBy("split").agg(F.count("*").alias("rows"), F.count_distinct("job_id").alias("jobs"))
