"""Vectors that belong to rows by position: a matrix file read by byte ranges, and row numbers without a global sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ROWS_PER_TASK, ROWS_PER_BATCH = 65_536, 4096


class Rows(InputPartition):
    """Rows of the file from first to end - 1."""

    def __init__(self, first: int, end: int):
        super().__init__(first)
        self.first, self.end = first, end


def matrix_shape(path: str) -> tuple[int, int, np.dtype, int]:
    """(rows, columns, number type, bytes before the first row) of an .npy file of two dimensions, row by row."""
    with open(path, "rb") as file:
        version = np.lib.format.read_magic(file)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, by_columns, kind = read(file)
        if len(shape) != 2 or by_columns or kind.kind not in "fiu":
            raise ValueError(f"{path} holds no matrix of numbers stored by rows")
        return shape[0], shape[1], kind, file.tell()


class MatrixReader(DataSourceReader):
    def __init__(self, path: str, rows_per_task: int):
        self.path, self.rows_per_task = path, rows_per_task

    def partitions(self) -> list[InputPartition]:
        rows = matrix_shape(self.path)[0]
        return [Rows(i, min(i + self.rows_per_task, rows)) for i in range(0, rows, self.rows_per_task)]

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a file without rows has no parts
            return
        _, width, kind, start = matrix_shape(self.path)
        with open(self.path, "rb") as file:
            file.seek(start + partition.first * width * kind.itemsize)
            for first in range(partition.first, partition.end, ROWS_PER_BATCH):
                count = min(ROWS_PER_BATCH, partition.end - first)
                data = file.read(count * width * kind.itemsize)
                if len(data) < count * width * kind.itemsize:
                    raise ValueError(f"{self.path} is cut off in row {first + len(data) // max(width * kind.itemsize, 1)}")
                values = np.frombuffer(data, kind).astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(count + 1, dtype=np.int32) * width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + count)), lists], ["position", "embedding"])


class MatrixSource(DataSource):
    """Format `matrix`: the rows of an .npy file on a path that driver and executors share, as (position, embedding)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "position long, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options["path"], int(self.options.get("rowsPerTask", ROWS_PER_TASK)))


def read_matrix(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """position (from 0) and embedding of every row; a task reads its own range of the file."""
    spark.dataSource.register(MatrixSource)
    return spark.read.format("matrix").option("rowsPerTask", rows_per_task).load(path)


def read_with_positions(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table with `position`: the row's number in its file, after all files of smaller names. Only counts by file are put in order."""
    rows = spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg(F.count("*").alias("held"))
    before = F.coalesce(F.sum("held").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("_file", before.alias("_start"))
    return rows.join(starts, "_file").withColumn("position", F.col("_row") + F.col("_start")).drop("_file", "_row", "_start")


def attach_by_position(rows: DataFrame, matrix: DataFrame) -> DataFrame:
    """Rows (with position) and the vectors of the same positions; fails where their numbers differ."""
    counts = rows.count(), matrix.count()
    if counts[0] != counts[1]:
        raise ValueError(f"{counts[0]} rows, but {counts[1]} vectors")
    return rows.join(matrix, "position")
