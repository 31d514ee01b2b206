"""Shared helpers of the corpus operators: scratch tables in the shared folder, hashing, ASCII words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"

_own_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one temporary folder where it is unset and all runs on one machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_roots:
        _own_roots[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own_roots[app]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialize, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if scratch_root(spark).split(":")[-1].strip("/") in folder.toString():
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _limit_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def batch_predicate(spark: SparkSession, function: Callable[[Iterator[pa.Array]], Iterator[pa.Array]]) -> Callable[[str], Column]:
    """A filter on one column: only that column travels to Python, in batches of about BATCH_BYTES, and only the answers come back."""
    _limit_batches(spark)

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from function(columns)
        pa.default_memory_pool().release_unused()

    return F.arrow_udf(run, "boolean")


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow over batches of about BATCH_BYTES, unless the session sets its own limit: some rows hold very long texts."""
    _limit_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_size(text: Column) -> Column:
    """UTF-8 bytes of a text; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
