"""Request metrics, keyed upserts and the sliding-log limiter, as streams and over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

# Endpoints reported, samples that percentiles look at, the limiter's admissions and window.
TOP_ENDPOINTS, NEWEST_SAMPLES = 20, 5000
LIMIT, WINDOW_SECONDS = 5, 180.0
DECISIONS = "user_id long, event_id long, allowed boolean, remaining int, retry_after double"


def _measures(exact: bool = True) -> list[Column]:
    quantile = F.percentile if exact else F.approx_percentile
    failed = F.when(F.col("status_code") >= 500, 1.0).otherwise(0.0)
    return [
        F.count("*").alias("requests"), F.round(F.avg(failed), 6).alias("error_rate"),
        F.round(quantile("latency_ms", 0.5), 6).alias("latency_ms_p50"), F.round(quantile("latency_ms", 0.95), 6).alias("latency_ms_p95"),
    ]


def recorded(requests: DataFrame, hidden: str = "/ui") -> DataFrame:
    """The requests that are measured: not those of pages (paths that begin with hidden); without a status, as an exception leaves one, it is 500."""
    shown = F.coalesce(~F.startswith("path", F.lit(hidden)), F.lit(True))
    return requests.where(shown).withColumn("status_code", F.coalesce("status_code", F.lit(500)))


def request_metrics(requests: DataFrame, top: int = TOP_ENDPOINTS, exact: bool = True) -> DataFrame:
    """Requests, error rate and percentiles by endpoint (the busiest), and of all requests as endpoint '*'.

    Exact percentiles keep an endpoint's distinct latencies in one state; exact=False bounds it.
    """
    requests = recorded(requests)
    by_endpoint = requests.groupBy(F.concat_ws(" ", "method", "path").alias("endpoint")).agg(*_measures(exact))
    busiest = by_endpoint.orderBy(F.desc("requests"), "endpoint").limit(top)
    return busiest.unionByName(requests.agg(*_measures(exact)).withColumn("endpoint", F.lit("*")))


def recent_request_metrics(requests: DataFrame, newest: int = NEWEST_SAMPLES) -> DataFrame:
    """Totals over everything, percentiles over the newest samples only. The newest are taken by a distributed top-n."""
    requests = recorded(requests)
    last = requests.orderBy(F.desc("ts"), F.desc("event_id")).limit(newest)
    return requests.agg(*_measures()[:2]).crossJoin(last.agg(*_measures()[2:]))


def streamed_request_metrics(requests: DataFrame, window: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """The same measures by event-time window and endpoint, with approximate percentiles."""
    grouped = recorded(requests).withWatermark("ts", late).groupBy(F.window("ts", window), F.concat_ws(" ", "method", "path").alias("endpoint"))
    failed = F.when(F.col("status_code") >= 500, 1.0).otherwise(0.0)
    return grouped.agg(
        F.count("*").alias("requests"), F.avg(failed).alias("error_rate"), F.approx_percentile("latency_ms", 0.5).alias("latency_ms_p50"),
        F.approx_percentile("latency_ms", 0.95).alias("latency_ms_p95"),
    )


def latest_rows(rows: DataFrame, keys: list[str], order: list[str], first: dict[str, str] | None = None) -> DataFrame:
    """One row per key, the last by `order`; `first` maps columns kept from the first row to their names there."""
    others = [c for c in rows.columns if c not in keys]
    moment = F.struct(*order)
    kept = {new: F.min_by(F.col(old), moment) for new, old in (first or {}).items()}
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), moment).alias("_last"), *[c.alias(f"_first_{n}") for n, c in kept.items()])
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others if c not in kept], *[F.col(f"_first_{n}").alias(n) for n in kept])


def upsert_batch(path: str, keys: list[str], order: list[str], first: dict[str, str] | None = None, buckets: int = 16) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key in a Parquet table of hash buckets.

    first maps columns that keep the value of the key's first row to the columns they are taken from there
    (created_at from updated_at; score from score). Only the buckets that a batch touches are rewritten. The
    merged buckets are written beside the table first, so a run that ends between the two writes loses
    nothing; a batch that is replayed changes nothing. Any Parquet reader reads the table, but may meet half a
    batch, and the buckets do not grow in number: versioned_upserts has neither limit.
    """
    first = first or {}

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        table = batch_rows(batch, keys, order, first).withColumn("bucket", bucket).persist()
        touched = [r["bucket"] for r in table.select("bucket").distinct().collect()]  # `buckets` numbers at most
        jvm = spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        files = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        result, staged = table, f"{path}-staged-{epoch}"
        if files.exists(hadoop_path):
            old = spark.read.schema(table.schema).parquet(path).where(F.col("bucket").isin(touched))
            result = newest_stored(old.unionByName(table), keys, order, list(first)).withColumn("bucket", bucket)
            # a table can't be overwritten while it is read
            result.write.mode("overwrite").parquet(staged)
            result = spark.read.schema(result.schema).parquet(staged)
        result.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
        files.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
        table.unpersist()

    return write


def batch_rows(batch: DataFrame, keys: list[str], order: list[str], first: dict[str, str]) -> DataFrame:
    """One row per key of a batch as the table stores it: the last by order, the columns of `first` from the first row, and its moment."""
    firsts = {c: f"_first_{i}" for i, c in enumerate(first)}
    moment = F.struct(*order)
    others = [c for c in batch.columns if c not in keys and c not in first]
    rows = batch.select(*batch.columns, *[F.col(old).alias(firsts[c]) for c, old in first.items()])
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), moment).alias("_last"), *[F.min_by(n, moment).alias(c) for c, n in firsts.items()], F.min(moment).alias("_moment"))
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others], *first, F.col("_moment").alias("_first_moment"))


def newest_stored(rows: DataFrame, keys: list[str], order: list[str], first: list[str]) -> DataFrame:
    """One row per key of stored rows: the last by order, the columns of `first` from the one with the earliest first moment."""
    others = [c for c in rows.columns if c not in (*keys, *first, "bucket", "_first_moment")]
    kept = F.min_by(F.struct(*first), "_first_moment").alias("_kept")
    out = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last"), *([kept] if first else []), F.min("_first_moment").alias("_first_moment"))
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in others], *[F.col(f"_kept.{c}").alias(c) for c in first], "_first_moment")


def _admit(log: list[float], moment: float, limit: int, window: float) -> tuple[list[float], bool, int, float]:
    """The log after a request, whether it is admitted, how many more would be, and when to come back."""
    log = [t for t in log if t >= moment - window]
    if len(log) >= limit:
        return log, False, 0, max(0.0, log[0] + window - moment)
    return [*log, moment], True, limit - len(log) - 1, 0.0


def _decide(frame: pd.DataFrame, log: list[float], limit: int, window: float) -> tuple[pd.DataFrame, list[float]]:
    rows = []
    for user, event, moment in frame.sort_values(["moment", "event_id"])[["user_id", "event_id", "moment"]].itertuples(index=False):
        log, allowed, remaining, retry = _admit(log, moment, limit, window)
        rows.append((user, event, allowed, remaining, round(retry, 6)))
    return pd.DataFrame(rows, columns=["user_id", "event_id", "allowed", "remaining", "retry_after"]), log


def _timed(requests: DataFrame) -> DataFrame:
    return requests.select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("moment"))


def limiter_log(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS) -> DataFrame:
    """Admissions of a batch, in time order within each user: only admitted requests count, and a hit exactly a window ago does.

    A gap longer than the window empties the log, so each user's requests are cut there and the pieces are
    dealt to tasks apart. A task reads its pieces in time order, sorted by Spark, and keeps no more than the
    log of `limit` admissions of the piece it is in, however busy a user is.
    """
    order = Window.partitionBy("user_id").orderBy("moment", "event_id")
    gap = F.col("moment") - F.lag("moment").over(order) > window
    pieces = _timed(requests).withColumn("piece", F.sum(F.when(gap, 1).otherwise(0)).over(order))
    keys = ["user_id", "piece"]

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, log = None, []
        for batch in batches:
            out = []
            for user, piece, moment in zip(*[batch.column(c).to_pylist() for c in (*keys, "moment")], strict=True):
                if (user, piece) != now:
                    now, log = (user, piece), []
                log, allowed, remaining, retry = _admit(log, moment, limit, window)
                out.append((allowed, remaining, round(retry, 6)))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.bool_(), pa.int32(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column("user_id"), batch.column("event_id"), *columns], ["user_id", "event_id", "allowed", "remaining", "retry_after"])

    dealt = pieces.select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "moment", "piece")
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "moment", "event_id").mapInArrow(decided, DECISIONS)


class _Limiter(StatefulProcessor):
    """A user's requests wait until the watermark has passed them, and are then decided in time order."""

    def __init__(self, limit: int, window: float):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "event_id long, moment double")
        self.log = handle.getListState("log", "moment double")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for event, moment in zip(frame["event_id"].tolist(), frame["moment"].tolist(), strict=True):
                self.waiting.appendValue((event, moment))
            for due in sorted(set((frame["moment"] * 1000).astype("int64") + 1)):
                self.handle.registerTimer(due)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() / 1000
        held = list(self.waiting.get()) if self.waiting.exists() else []
        log = [m for (m,) in self.log.get()] if self.log.exists() else []
        due = [(key[0], e, m) for e, m in held if m < passed]
        if due:
            rest = [x for x in held if x[1] >= passed]
            self.waiting.put(rest) if rest else self.waiting.clear()
            out, log = _decide(pd.DataFrame(due, columns=["user_id", "event_id", "moment"]), log, self.limit, self.window)
            yield out
        log = [m for m in log if m >= passed - self.window]
        if log:
            self.log.put([(m,) for m in log])
            # a user who does not come back leaves no state
            self.handle.registerTimer(int((log[-1] + self.window) * 1000) + 2)
        else:
            self.log.clear()

    def close(self) -> None:
        pass


def streamed_limiter(requests: DataFrame, limit: int = LIMIT, window: float = WINDOW_SECONDS, late: str = "1 minute") -> DataFrame:
    """The same over a stream whose rows come up to `late` out of order: a decision is made once the watermark has passed its request.

    A user's state is what waits for the watermark and the log of at most `limit` admitted moments; both go
    when the window has passed. Later rows than the watermark allows are dropped. Needs the RocksDB state store, which this sets.
    """
    requests.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    moment = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("moment")
    timed = requests.withWatermark("ts", late).select(F.col("user_id").cast("long").alias("user_id"), F.col("event_id").cast("long").alias("event_id"), "ts", moment)
    return timed.groupBy("user_id").transformWithStateInPandas(_Limiter(limit, window), DECISIONS, "Append", "EventTime")
