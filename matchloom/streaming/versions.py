"""Keyed upserts into a table of which readers see whole batches only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from matchloom.sources.tables import path_exists, written
from matchloom.streaming.jobs import batch_rows, newest_stored

HEAD, BUCKET = "head.json", "upsert_bucket"
#: Rows of a bucket, which one task rewrites.
BUCKET_ROWS = 1_000_000


def _head(spark: SparkSession, path: str) -> dict | None:
    """What the table consists of: number of buckets, folder and rows of each, schema, and the folders that the last batch replaced."""
    if not path_exists(spark, f"{path}/{HEAD}"):
        return None
    return json.loads(spark.read.text(f"{path}/{HEAD}", wholetext=True).first()[0])


def _switch(spark: SparkSession, path: str, head: dict, gone: list[str]) -> None:
    """Put a new head in the old one's place by one rename; then delete `gone`, and what ended runs have left behind."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = hadoop.Path(path)
    files = root.getFileSystem(conf)
    made = files.makeQualified(hadoop.Path(root, f"next-{uuid.uuid4().hex}"))
    out = files.create(made)
    out.write(bytearray(json.dumps(head), "utf-8"))
    out.close()
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(files.getUri(), conf).rename(made, files.makeQualified(hadoop.Path(root, HEAD)), over)
    used = {f.split("/")[0] for f in [*head["folders"].values(), *head["replaced"]]} | {HEAD}
    left = [s.getPath().getName() for s in files.listStatus(root)]
    for name in [*gone, *[n for n in left if n not in used and n.startswith(("version-", "next-"))]]:
        files.delete(hadoop.Path(root, name), True)


def versioned_upserts(
    path: str, keys: list[str], order: list[str], first: dict[str, str] | None = None, bucket_rows: int = BUCKET_ROWS
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that keeps the last row of each key by `order`; `first` as in upsert_batch. read_upserts reads the table.

    Keys lie in hash buckets. Their number doubles when they would hold more than bucket_rows each, so a batch
    rewrites as many rows as the buckets that it touches hold, in tasks of bounded size; the batch that doubles
    it rewrites all. New buckets go to a folder of their own and count when one file, the head, is renamed:
    readers see the table before or after a batch. Replaced folders stay until the next batch, for readers that have begun.
    A batch that is replayed, and a run that ends before the rename, change nothing. One writer at a time. The
    driver holds a name and a count for each bucket, no row.
    """
    first = first or {}

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = written(batch_rows(batch, keys, order, first), "upserts")
        arrived = rows.count()
        if not arrived:
            return
        head = _head(spark, path) or {"buckets": 1, "folders": {}, "rows": {}, "replaced": []}
        buckets = head["buckets"]
        while buckets * bucket_rows < sum(head["rows"].values()) + arrived:
            buckets *= 2
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
        folders = head["folders"]
        if buckets == head["buckets"]:
            touched = {str(r["b"]) for r in rows.select(bucket.alias("b")).distinct().collect()}
            folders = {b: f for b, f in folders.items() if b in touched}
        if folders:
            stored = spark.read.schema(rows.schema).parquet(*[f"{path}/{f}" for f in folders.values()])
            rows = newest_stored(stored.unionByName(rows), keys, order, list(first))
        version = f"version-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{version}")
        counts = {str(r[BUCKET]): r["count"] for r in spark.read.parquet(f"{path}/{version}").groupBy(BUCKET).count().collect()}
        new = {
            "buckets": buckets, "schema": rows.schema.jsonValue(), "replaced": list(folders.values()),
            "folders": {b: f for b, f in head["folders"].items() if b not in folders} | {b: f"{version}/{BUCKET}={b}" for b in counts},
            "rows": {b: n for b, n in head["rows"].items() if b not in folders} | counts,
        }
        _switch(spark, path, new, head["replaced"])

    return write


def read_upserts(spark: SparkSession, path: str) -> DataFrame:
    """The table as the last whole batch left it, one row per key."""
    head = _head(spark, path)
    if head is None:
        raise FileNotFoundError(f"no batch has been written to {path}")
    table = spark.read.schema(StructType.fromJson(head["schema"])).parquet(*[f"{path}/{f}" for f in head["folders"].values()])
    return table.drop("_first_moment")
