"""Feature snapshots of candidates: JSON text, or VARIANT that was parsed once when it was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType


def snapshot_fields(rows: DataFrame, fields: str, column: str = "feature_snapshot") -> Column:
    """Fields of a snapshot as a struct: looked up by path in a VARIANT, parsed from a text. Null where a snapshot, or a field, can't be read."""
    if not isinstance(rows.schema[column].dataType, VariantType):
        return F.from_json(column, fields)
    wanted = StructType.fromDDL(fields)
    return F.struct(*[F.try_variant_get(F.col(column), f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in wanted])


def parsed_snapshots(rows: DataFrame, column: str = "feature_snapshot") -> DataFrame:
    """Rows with the text of a snapshot as VARIANT, for storing; null where it is no JSON."""
    return rows.withColumn(column, F.try_parse_json(column))
