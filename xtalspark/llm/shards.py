"""Sharding by proportional stratified interleaving.

Within each source rows take the order of a seeded hash; the row of rank r
among n gets the place (r - 1 + u) / n, u in [0, 1) being a seeded hash of the
source. Rows sorted by place are cut into runs of equal length, so each shard
holds each source in the mixture's proportion.

Ranks come without a task that holds a whole source: rows fall into buckets of
the hash, a source's bucket counts are summed up in order, and only the rows of
one (source, bucket) are ever sorted together. The global order is made the
same way from buckets of the place. With N rows there are about sqrt(N) buckets
of about sqrt(N) rows, whatever the sources' sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


def _hex_fraction(h: Column) -> Column:
    """The first 13 hex digits as a number in [0, 1), exact in a double."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") / F.lit(float(16**13))


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[str], out: str) -> DataFrame:
    """Append out, the 0-based rank within group by (bucket, order)."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*group, bucket, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order)) - 1
    starts = starts.select(*(F.col(c).alias(f"__r_{c}") for c in (*group, bucket)), "__start")
    on = [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in (*group, bucket)]
    joined = rows.withColumn("__local", local).join(starts, on)
    return joined.withColumn(out, F.col("__start") + F.col("__local")).drop("__start", "__local", *(f"__r_{c}" for c in (*group, bucket)))


def interleave(df: DataFrame, n_shards: int = 8, key: str = "doc_id", source: str = "source", seed: int = 17) -> DataFrame:
    """df's rows with `shard` (0 to n_shards - 1) and `slot` (gapless from 0).

    Counts of shards differ by one row at most. A null source is a source of its
    own; a null key hashes as an empty string. Rows equal in the key keep
    separate places, in an order among them that is not stated. Columns named
    shard or slot in df are replaced; an empty df gives an empty result.
    """
    df = df.drop("shard", "slot")
    rows = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))))
    u = _hex_fraction(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(source).cast("string"), F.lit("")))))
    total = df.count()
    n_buckets = max(1, math.isqrt(total))
    bucketed = rows.withColumn("__b", F.floor(_hex_fraction(F.col("__h")) * n_buckets)).withColumn("__src", F.col(source))
    sizes = bucketed.groupBy("__src").agg(F.count("*").alias("__size")).withColumnRenamed("__src", "__key")
    ranked = _ranked(bucketed, ["__src"], "__b", ["__h", key], "__rank")
    # Sources are few or, if many, small: the join is on the source's key and
    # Spark may split its hot side.
    placed = ranked.join(sizes, F.col("__src").eqNullSafe(F.col("__key"))).withColumn("__at", (F.col("__rank") + u) / F.col("__size"))
    placed = stored(placed.drop("__key", "__size", "__b", "__rank"), "shards")
    placed = placed.withColumn("__b", F.least(F.floor(F.col("__at") * n_buckets), F.lit(n_buckets - 1))).withColumn("__one", F.lit(0))
    ordered = _ranked(placed, ["__one"], "__b", ["__at", "__src", "__h", key], "__g")
    shard = F.expr(f"cast((__g * {n_shards}) div {max(total, 1)} as int)")
    start = F.expr(f"(cast(shard as bigint) * {total} + {n_shards - 1}) div {n_shards}")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col("__g") - start).select(*df.columns, "shard", "slot")
