"""Latencies of requests as mergeable sketches: stored once a window, merged upwards without reading requests again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.streaming.jobs import recorded

#: Size of a sketch: 200 keeps the rank of a percentile within about 1.7 %, whatever the number of requests.
SKETCH_K = 200


def latency_sketches(requests: DataFrame, window: str = "1 minute", late: str | None = None) -> DataFrame:
    """start, endpoint, requests, errors and a sketch of the latencies of each window and endpoint; a table or (with late, the watermark) a stream."""
    rows = recorded(requests)
    rows = rows.withWatermark("ts", late) if late else rows
    grouped = rows.groupBy(F.window("ts", window).alias("w"), F.concat_ws(" ", "method", "path").alias("endpoint"))
    failed = F.when(F.col("status_code") >= 500, 1).otherwise(0)
    return grouped.agg(F.count("*").alias("requests"), F.sum(failed).alias("errors"), F.kll_sketch_agg_double("latency_ms", SKETCH_K).alias("latencies")).select(
        F.col("w.start").alias("start"), "endpoint", "requests", "errors", "latencies"
    )


def rolled_up(stored: DataFrame, *keys: Column | str) -> DataFrame:
    """Stored windows merged by any keys, such as a longer window, the endpoint, or none: requests, errors, latencies."""
    return stored.groupBy(*keys).agg(F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), F.kll_merge_agg_double("latencies").alias("latencies"))


def sketched_metrics(stored: DataFrame) -> DataFrame:
    """The measures of stored or merged windows: error_rate and percentiles beside the other columns."""
    at = {"latency_ms_p50": 0.5, "latency_ms_p95": 0.95}
    quantiles = [F.kll_sketch_get_quantile_double("latencies", F.lit(p)).alias(n) for n, p in at.items()]
    kept = [c for c in stored.columns if c not in ("errors", "latencies")]
    return stored.select(*kept, (F.col("errors") / F.col("requests")).alias("error_rate"), *quantiles)
