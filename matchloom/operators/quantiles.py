"""Exact quantiles by narrowing: count values by ranges, go on in the range that holds the rank, until few values are left.

A quantile between two ranks lies between two values; both are found. Every pass is one aggregate over counts
(groups x points x RANGES at most), so no state grows with the number of different values, and a group that
holds a third of all rows is counted like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.sources.tables import written

RANGES, FEW, MOST_PASSES = 1024, 1000, 40


def exact_quantiles(rows: DataFrame, column: str, points: list[float], group: str) -> DataFrame:
    """group, point, value: what percentile(column, point) gives, for every group and point.

    Nulls, and values that are no numbers, are left out; a group without values has no row. Rows are read once a pass (about one
    for every factor of RANGES between a group's span and the distance of neighbouring values), so they should be a written table.
    """
    values = rows.select(F.col(group).alias("g"), F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    at = F.array(*[F.lit(float(p)) for p in points])
    spans = values.groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).withColumn("point", F.explode(at))
    exact = F.col("point") * (F.col("n") - 1)
    spans = spans.withColumn("rank", F.explode(F.array(F.floor(exact), F.ceil(exact))))
    # of a range [low, high]: the rank sought within it, and how many values it holds
    spans = written(spans.select("g", "point", exact.alias("exact"), F.col("rank").alias("whole"), "rank", F.col("n").alias("held"), "low", "high").distinct(), "spans")
    for _ in range(MOST_PASSES):
        wide = spans.where((F.col("held") > FEW) & (F.col("low") < F.col("high")))
        if not wide.head(1):
            break
        met = values.join(wide, values.g.eqNullSafe(wide.g)).drop(values.g).where("x between low and high")
        place = F.least(F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * RANGES), F.lit(RANGES - 1))
        keys = ["g", "point", "exact", "whole", "rank"]
        counted = met.groupBy(*keys, place.alias("place")).agg(F.count("*").alias("held"), F.min("x").alias("low"), F.max("x").alias("high"))
        before = Window.partitionBy("g", "point", "whole").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
        told = counted.withColumn("before", F.coalesce(F.sum("held").over(before), F.lit(0))).where("rank >= before and rank < before + held")
        narrowed = told.select("g", "point", "exact", "whole", (F.col("rank") - F.col("before")).alias("rank"), "held", "low", "high")
        spans = written(narrowed.unionByName(spans.where((F.col("held") <= FEW) | (F.col("low") == F.col("high")))), "spans")
    # a range of one value gives it; of few values, those are sorted
    few = spans.where("low < high")
    met = values.join(few, values.g.eqNullSafe(few.g)).drop(values.g).where("x between low and high")
    order = Window.partitionBy("g", "point", "whole").orderBy("x")
    sought = met.withColumn("turn", F.row_number().over(order) - 1).where("turn = rank").select("g", "point", "exact", "whole", "x")
    found = sought.unionByName(spans.where("low = high").select("g", "point", "exact", "whole", F.col("low").alias("x")))
    share = F.first("exact") - F.floor(F.first("exact"))
    return found.groupBy("g", "point").agg((F.min("x") * (1 - share) + F.max("x") * share).alias("value")).withColumnRenamed("g", group)
