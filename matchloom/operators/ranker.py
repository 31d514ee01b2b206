"""A pairwise ranker: training, search, scores, contributions and importance.

The loss is the logistic loss of pairs within an opening, each weighted by what swapping the two would
change in DCG (gain of the labels times discount of the positions), on standardised features. Its model
is linear, so that the contributions w * (x - mean) add up to the score exactly.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.operators.features import FEATURES
from matchloom.operators.metrics import overall_metrics, per_job_metrics
from matchloom.sources.tables import written

# Gain of labels 0 to 4.
LABEL_GAIN = [0.0, 1.0, 2.0, 4.0, 8.0]
SEARCH_SPACE = {"regParam": [0.001, 0.01, 0.1, 1.0], "elasticNetParam": [0.0, 0.2, 0.5], "maxIter": [20, 40]}
SEARCH_METRIC = "ndcg_10"
#: Rows of a block of openings, and pairs (of any rows of an opening) that are looked at together.
BLOCK_ROWS, PAIRS = 20_000, 1 << 18


@dataclass
class LinearRanker:
    """Weights by feature in the feature's own units, and the means that contributions are measured from."""

    weights: dict[str, float]
    means: dict[str, float]

    @property
    def features(self) -> list[str]:
        return list(self.weights)

    def impacts(self) -> Column:
        """array<double> of contributions in the order of the features."""
        return F.array(*map(self.contribution, self.weights))

    def contribution(self, feature: str) -> Column:
        return F.lit(self.weights[feature]) * (F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) - F.lit(self.means[feature]))

    @property
    def base(self) -> float:
        return sum(w * self.means[f] for f, w in self.weights.items())

    def score(self) -> Column:
        return sum((F.lit(w) * F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f, w in self.weights.items()), F.lit(0.0))


class Ranker(Protocol):
    """What scoring and explaining need of a model: its columns, its score, the parts of the score and the base they start from."""

    features: list[str]
    base: float

    def score(self) -> Column: ...

    def impacts(self) -> Column: ...


def gain(label: Column) -> Column:
    return F.try_element_at(F.array(*map(F.lit, LABEL_GAIN)), label.cast("int") + 1)


def training_pairs(rows: DataFrame, columns: list[str], scales: dict[str, float]) -> DataFrame:
    """diff (scaled features, better minus worse) and weight of every pair within an opening with different labels.

    A column `weight` of rows, if there is one, multiplies the weights of their pairs. Pools of an opening are bounded (a few hundred rows), so the self join on job_id is bounded by pool size times rows.
    """
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("retrieval_rank", "resume_id"))
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / scales[c] for c in columns])
    own = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    slim = rows.select("job_id", own.alias("own"), gain(F.col("final_label")).alias("gain"), (1 / F.log2(place + 1.0)).alias("discount"), vector.alias("x"))
    worse = slim.select("job_id", *[F.col(c).alias(f"{c}_w") for c in ("own", "gain", "discount", "x")])
    pairs = slim.join(worse, "job_id").where("gain > gain_w")
    return pairs.select(
        F.zip_with("x", "x_w", lambda a, b: a - b).alias("diff"), (F.col("own") * F.col("own_w") * F.abs((F.col("gain") - F.col("gain_w")) * (F.col("discount") - F.col("discount_w")))).alias("weight")
    ).where("weight > 0")


def opening_blocks(rows: DataFrame, columns: list[str], scales: dict[str, float]) -> DataFrame:
    """Whole openings in blocks of about BLOCK_ROWS rows, written: sizes (rows of each opening), scaled features, gains, discounts, weights, as bytes.

    From them training_pairs follow where they are needed; the pairs themselves, many times the rows, are never written.
    """
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("retrieval_rank", "resume_id"))
    vector = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) / scales[c] for c in columns])
    own = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    slim = rows.where("job_id is not null").select("job_id", vector.alias("x"), gain(F.col("final_label")).alias("gain"), (1 / F.log2(place + 1.0)).alias("discount"), own.alias("weight"))
    grouped = slim.sortWithinPartitions("job_id").select(F.col("job_id").cast("string").alias("job"), "x", "gain", "discount", "weight")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held)
            names = np.array(whole["job"].to_pylist(), object)
            sizes = np.diff(np.r_[np.flatnonzero(np.r_[True, names[1:] != names[:-1]]), len(names)])
            x = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in whole["x"].chunks])
            others = [whole[c].to_numpy().astype(float) for c in ("gain", "discount", "weight")]
            return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (sizes.astype(np.int64), x, *others)], ["sizes", "x", "gains", "discounts", "weights"])

        for batch in batches:
            names = batch.column(0).to_pylist()
            if held and size >= BLOCK_ROWS:
                # the opening that the last batch ended with goes on to the end of its rows
                last = held[-1].column(0)[-1].as_py()
                ends = next((i for i, n in enumerate(names) if n != last), len(names))
                if ends:
                    held.append(batch.slice(0, ends))
                if ends < len(names):
                    yield block()
                    held, size, batch = [], 0, batch.slice(ends)
                else:
                    continue
            if len(batch):
                held.append(batch)
                size += len(batch)
        if held:
            yield block()

    return written(grouped.mapInArrow(packed, "sizes binary, x binary, gains binary, discounts binary, weights binary"), "opening-blocks")


def pair_places(sizes: np.ndarray, gains: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows (better, worse) of the pairs within openings with different gains, PAIRS or so at a time; openings lie one behind the other."""
    starts = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        own = starts[sizes == size]
        step = max(1, PAIRS // int(size) ** 2)
        for first in range(0, len(own), step):
            rows = own[first : first + step, None] + np.arange(size)
            y = gains[rows]
            opening, better, worse = np.nonzero(y[:, :, None] > y[:, None, :])
            if len(opening):
                yield rows[opening, better], rows[opening, worse]


def pair_sums(blocks: DataFrame, shape: tuple[int, int], function: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all pairs of function(x, better, worse, weights), a small matrix; x: the features of a block's rows, better and worse: the rows of some of its pairs."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                sizes, x, gains, discounts, own = (np.frombuffer(c.as_py(), kind) for c, kind in zip(row, (np.int64, *[float] * 4), strict=True))
                x = x.reshape(len(gains), -1)
                for better, worse in pair_places(sizes, gains):
                    weights = own[better] * own[worse] * np.abs((gains[better] - gains[worse]) * (discounts[better] - discounts[worse]))
                    used = weights > 0
                    total += function(x, better[used], worse[used], weights[used])
        i, j = np.indices(shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "value"])

    out = np.zeros(shape)
    for r in blocks.mapInArrow(summed, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r["i"], r["j"]] = r["value"]
    return out


def _moments(x: np.ndarray, better: np.ndarray, worse: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Second moments of the pairs' differences, and in the last row the weights' sum."""
    diffs = x[better] - x[worse]
    return np.vstack([diffs.T @ (diffs * weights[:, None]), np.full(x.shape[1], weights.sum())])


def _slopes(x: np.ndarray, better: np.ndarray, worse: np.ndarray, weights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The gradient of the pairs' loss at every column of weights `at`: what each row adds, by its scores, times its features."""
    rows, place = np.unique(np.r_[better, worse], return_inverse=True)
    own, other = np.split(place, 2)
    x = x[rows]
    scores = (x @ at).T
    out = np.empty(at.shape)
    for n, s in enumerate(scores):
        pull = -weights / (1 + np.exp(np.clip(s[own] - s[other], -50, 50)))
        out[:, n] = (np.bincount(own, pull, len(rows)) - np.bincount(other, pull, len(rows))) @ x
    return out


def fit_rankers(rows: DataFrame, settings: list[dict], columns: list[str] = FEATURES) -> list[LinearRanker]:
    """One ranker for each setting (regParam, elasticNetParam, maxIter), all fitted in the same passes.

    rows: job_id, resume_id, retrieval_rank, final_label, the feature columns, and perhaps row weights (weight). Openings are
    packed once, and their pairs made in the task that needs them; an iteration adds up the gradients of all settings in one aggregate. Steps are accelerated proximal
    ones, as long as the pairs' second moments allow; a setting stands still after its maxIter steps. Only sums over pairs, columns times settings, come to the driver.
    """
    values = {c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns}
    stats = rows.agg(*[F.avg(v).alias(f"m_{c}") for c, v in values.items()], *[F.stddev_pop(v).alias(f"s_{c}") for c, v in values.items()]).first()
    scales = {c: stats[f"s_{c}"] or 1.0 for c in columns}

    blocks = opening_blocks(rows, columns, scales)
    width = len(columns)
    moments = pair_sums(blocks, (width + 1, width), _moments)
    total = moments[-1, 0] or 1.0
    reach = float(np.linalg.eigvalsh(moments[:-1] / total)[-1]) / 4
    options = [{"maxIter": 40, "regParam": 0.01, "elasticNetParam": 0.0} | s for s in settings]
    reg, mix, most = (np.array([o[k] for o in options], float) for k in ("regParam", "elasticNetParam", "maxIter"))
    step = 1 / (reach + reg * (1 - mix) + 1e-12)
    now, ahead, momentum = np.zeros((width, len(options))), np.zeros((width, len(options))), 1.0
    for turn in range(int(most.max(initial=0))):
        slope = pair_sums(blocks, ahead.shape, partial(_slopes, at=ahead)) / total + reg * (1 - mix) * ahead
        moved = ahead - step * slope
        shrunk = np.sign(moved) * np.maximum(np.abs(moved) - step * reg * mix, 0)
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        live = turn < most
        now, ahead = np.where(live, shrunk, now), np.where(live, shrunk + (momentum - 1) / following * (shrunk - now), ahead)
        momentum = following
    means = {c: float(stats[f"m_{c}"] or 0.0) for c in columns}
    return [LinearRanker({c: float(w) / scales[c] for c, w in zip(columns, own, strict=True)}, means) for own in now.T]


def fit_ranker(rows: DataFrame, columns: list[str] = FEATURES, **params) -> LinearRanker:
    """The ranker of one setting; see fit_rankers."""
    return fit_rankers(rows, [params], columns)[0]


def score_pairs(rows: DataFrame, ranker: Ranker, score: str = "pred") -> DataFrame:
    """Rows with the score and final_rank within the opening; every feature column must be there."""
    missing = [c for c in ranker.features if c not in rows.columns]
    if missing:
        raise ValueError(f"missing feature columns: {', '.join(missing)}")
    order = Window.partitionBy("job_id").orderBy(F.desc(score), "resume_id")
    return rows.withColumn(score, F.round(ranker.score(), 9)).withColumn("final_rank", F.row_number().over(order))


def contributions(rows: DataFrame, ranker: Ranker) -> DataFrame:
    """Rows with an array `contributions` of (feature, impact) and the base value; they add up to the score."""
    parts = F.arrays_zip(F.array(*map(F.lit, ranker.features)).alias("feature"), ranker.impacts().alias("impact"))
    return rows.withColumn("contributions", parts).withColumn("base_value", F.lit(ranker.base))


def contribution_summary(explained: DataFrame) -> DataFrame:
    """feature, mean of the absolute impact, mean and population deviation of the impact."""
    parts = explained.select(F.explode("contributions").alias("c")).groupBy("c.feature")
    return parts.agg(
        F.round(F.avg(F.abs("c.impact")), 6).alias("mean_abs_impact"), F.round(F.avg("c.impact"), 6).alias("mean_impact"), F.round(F.stddev_pop("c.impact"), 6).alias("std_impact")
    )


def global_explanation(summary: DataFrame, glossary: DataFrame) -> DataFrame:
    """The summary with labels from the glossary (feature, label), a used-in-model flag, and bars relative to the largest.

    Features of the glossary alone come with no impact. The table has one row a feature.
    """
    joined = glossary.join(summary, "feature", "full_outer")
    most = joined.agg(F.max("mean_abs_impact").alias("most"))
    share = F.when(F.col("most") > 0, F.round(F.coalesce("mean_abs_impact", F.lit(0.0)) / F.col("most"), 6)).otherwise(0.0)
    return joined.crossJoin(F.broadcast(most)).select(
        "feature", F.coalesce("label", "feature").alias("label"), F.col("mean_abs_impact").isNotNull().alias("used_in_model"),
        F.coalesce("mean_abs_impact", F.lit(0.0)).alias("mean_abs_impact"), share.alias("relative"),
    )


def feature_importance(spark: SparkSession, ranker: LinearRanker, rows: DataFrame) -> DataFrame:
    """feature, weight and importance (weight times the feature's deviation), one row a feature."""
    deviations = rows.agg(*[F.stddev_pop(F.col(c).cast("double")).alias(c) for c in ranker.weights]).first()
    table = [(c, float(w), abs(w) * float(deviations[c] or 0.0)) for c, w in ranker.weights.items()]
    return spark.createDataFrame(table, "feature string, weight double, importance double")


def trial_metrics(rows: DataFrame, rankers: dict[int, LinearRanker], metric: str = SEARCH_METRIC) -> dict[int, float]:
    """The metric of every ranker on rows, in one pass: each opening comes once for every trial."""
    scores = F.array(*[F.struct(F.lit(n).alias("trial"), F.round(r.score(), 9).alias("pred")) for n, r in rankers.items()])
    scored = rows.select("job_id", "resume_id", "final_label", F.explode(scores).alias("s")).select(F.concat_ws("|", "s.trial", "job_id").alias("job_id"), "resume_id", "final_label", "s.pred")
    per_job = per_job_metrics(scored).withColumn("trial", F.substring_index("job_id", "|", 1).cast("int"))
    return {r["trial"]: r["metric"] for r in per_job.groupBy("trial").agg(F.round(F.coalesce(F.avg(metric), F.lit(0.0)), 6).alias("metric")).collect()}


def random_search(train: DataFrame, valid: DataFrame, trials: int, columns: list[str] = FEATURES, seed: int = 42, space: dict[str, list] | None = None) -> tuple[list[dict], dict]:
    """Seeded random search: (all trials, best parameters by ndcg_10 on valid), all trials fitted and scored together.

    A trial with settings that cannot be fitted, or without finite weights, is recorded and skipped.
    """
    chooser, table, rankers, space = random.Random(seed), [], {}, space or SEARCH_SPACE
    for number in range(trials):
        params = {k: chooser.choice(v) for k, v in space.items()}
        fits = params["regParam"] >= 0 and 0 <= params["elasticNetParam"] <= 1 and params["maxIter"] > 0
        table.append({"trial": number, **params, "metric": None, "error": None if fits else f"no such setting: {params}"})
    usable = [t for t in table if t["error"] is None]
    for t, ranker in zip(usable, fit_rankers(train, [{k: t[k] for k in space} for t in usable], columns) if usable else [], strict=True):
        if np.isfinite(list(ranker.weights.values())).all():
            rankers[t["trial"]] = ranker
        else:
            t["error"] = "the weights are not finite"
    found = trial_metrics(valid, rankers) if rankers else {}
    for t in table:
        t["metric"] = found.get(t["trial"])
    done = [t for t in table if t["metric"] is not None]
    if not done:
        raise RuntimeError("every trial failed")
    best = max(done, key=lambda t: (t["metric"], -t["trial"]))
    return table, {k: best[k] for k in space}


def refit(train: DataFrame, valid: DataFrame, params: dict, columns: list[str] = FEATURES) -> LinearRanker:
    """The ranker of the best parameters on training and validation rows together."""
    return fit_ranker(train.unionByName(valid), columns, **params)


def refit_report(train: DataFrame, valid: DataFrame, test: DataFrame, params: dict, columns: list[str] = FEATURES) -> tuple[LinearRanker, dict]:
    """The refitted ranker and its metadata: parameters, rows and openings of the splits, labels, weights, and the metrics of
    valid (by a ranker that has not seen it) and of test."""
    final = refit(train, valid, params, columns)
    parts = {"train": train, "valid": valid, "test": test}
    sizes = {f"{name}_{what}": n for name, part in parts.items() for what, n in zip(("rows", "jobs"), part.agg(F.count("*"), F.count_distinct("job_id")).first(), strict=True)}
    labels = reduce(DataFrame.unionByName, [p.select("final_label") for p in parts.values()]).groupBy("final_label").count().orderBy("final_label")
    metadata = {
        "model_type": "pairwise logistic", "label_gain": LABEL_GAIN, "feature_columns": columns, "best_params": params, **sizes,
        "label_distribution": {str(r["final_label"]): r["count"] for r in labels.collect()}, "weights": final.weights,
        "valid_metrics": overall_metrics(score_pairs(valid, fit_ranker(train, columns, **params))).first().asDict(), "test_metrics": overall_metrics(score_pairs(test, final)).first().asDict(),
    }
    return final, metadata


def write_metadata(spark: SparkSession, metadata: dict, path: str) -> None:
    """Metadata as one JSON line."""
    spark.createDataFrame([(json.dumps(metadata, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def predictions(rows: DataFrame, ranker: Ranker) -> DataFrame:
    return score_pairs(rows, ranker).select("job_id", "resume_id", "final_label", "pred")
