"""Global positions without a single-task window."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a range, about; a range is numbered by one task.
RANGE_ROWS, MOST_RANGES = 200_000, 5_000


def positions(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with 0-based positions in order of a unique key, a null one first.

    Keys are cut at sampled quantiles into ranges, as many as the rows ask for, and found there by bisection; counts of
    ranges give offsets, a window numbers each range.
    """
    ranges = min(MOST_RANGES, 1 + df.count() // RANGE_ROWS)
    cuts = sorted(set(df.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    if cuts:
        found = Bucketizer(splits=[-float("inf"), *cuts, float("inf")], inputCol="_key", outputCol="_found").transform(df.withColumn("_key", F.coalesce(F.col(key).cast("double"), F.lit(-float("inf")))))
        ranged = found.withColumn("_range", F.col("_found").cast("int")).drop("_key", "_found")
    else:
        ranged = df.withColumn("_range", F.lit(0))
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first())) - 1
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside).drop("_range", "_before")
