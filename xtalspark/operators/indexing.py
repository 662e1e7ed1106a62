"""Dense indices and prefix sums without a task that holds a whole frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_index(df: DataFrame, by: list[str], bucket: str, order: list[str], out: str, few: bool = False) -> DataFrame:
    """Append out: the 0-based row number within by, in the order of (bucket, order).

    Rows are numbered within each (by, bucket) and moved by a prefix sum over
    the buckets' counts, so only one number for each bucket comes together; few
    buckets' are broadcast, and rows dealt by (by, bucket) then stay where they are.
    """
    keys = [*by, bucket]
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    moves = counts.select(*(F.col(k).alias(f"__{k}") for k in keys), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__move"))
    own = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    joined = df.withColumn("__own", own).join(F.broadcast(moves) if few else moves, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return joined.withColumn(out, F.col("__own") + F.col("__move")).drop("__own", "__move", *(f"__{k}" for k in keys))


def exclusive_prefix_sum(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Append out: the sum of value over the rows before, within by."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
