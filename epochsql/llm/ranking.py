"""Ranks and running sums inside groups of any size, without one task per group.

Rows are ordered by a pseudo-random text key. Its first hex digits cut every group into up to 4,096 buckets that lie
in the key's order, so a rank is a rank inside the bucket plus the totals of the buckets before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096


def shuffle_key(seed: int, doc_id: Column, text: Column) -> Column:
    """md5 of "seed:id:md5 of the text": a fixed shuffled order that any SQL engine can repeat. Rows without an id, or with
    one id, have keys of their own as long as their texts differ."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.md5(text.cast("binary")), F.lit(""))))


def key_bucket(key: Column) -> Column:
    return F.conv(F.substring(key, 1, 3), 16, 10).cast("int")


def running(df: DataFrame, group: str, bucket: str, order: list, size: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``size`` over the group's rows before this one. ``bucket`` must follow ``order``."""
    sums = df.groupBy(group, bucket).agg(F.sum(size).alias("__sum"))
    before = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(group, bucket, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("__inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return out.join(sums, [group, bucket]).withColumn(name, (F.col("__before") + F.col("__inside")).cast("long")).drop("__before", "__inside")
