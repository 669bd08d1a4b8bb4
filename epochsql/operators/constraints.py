"""Constraint checks as plans: each returns the rows that break the constraint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(rows: DataFrame, columns: list[str]) -> DataFrame:
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull()
    return rows.where(bad)


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that occur more than once. Keys with a null in them are never equal."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return rows.where(present).groupBy(*columns).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def already_there(rows: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose key a live row has. Semi joins need no distinct keys, so live rows aren't shuffled for it."""
    return rows.join(live.select(*columns), columns, "left_semi")


def clashes(rows: DataFrame, live: DataFrame, columns: list[str]) -> DataFrame:
    """Keys that occur twice among the new rows, or among them and the live ones. The new rows are the side that is
    broadcast if it is small, so that a small insert only scans the live keys."""
    return live.select(*columns).join(rows.select(*columns), columns, "left_semi").unionByName(duplicates(rows, columns).select(*columns))


def failing(rows: DataFrame, check: Column) -> DataFrame:
    """Rows for which a check is false; an unknown result passes, as in SQL."""
    return rows.where(~F.coalesce(check, F.lit(True)))


def orphans(rows: DataFrame, columns: list[str], parent: DataFrame, ref_columns: list[str]) -> DataFrame:
    """Rows whose foreign key has no parent. A null in the key makes it no reference."""
    keys = parent.select(*[F.col(r).alias(c) for r, c in zip(ref_columns, columns, strict=True)]).distinct()
    for c in columns:
        rows = rows.where(F.col(c).isNotNull())
    return rows.join(keys, columns, "left_anti")


def fill_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), v) for c, v in defaults.items()})


def auto_increment(rows: DataFrame, column: str, start: int, order: list[str], scratch: str) -> DataFrame:
    """Numbers the rows whose ``column`` is null from start + 1 on, in order, without gaps and without one task for all.

    The rows are sorted into ranges and *written*, each with its range and its place in it; both are then facts of the
    files. The counts of the ranges come from those files, and a row's number is its place behind the ranges before it.
    (Sorted twice, a frame has other ranges each time, as their bounds are sampled.) ``scratch`` is a folder that all
    executors share; the result reads the files there. Ties go by a hash of the row, equal rows in any order.
    """
    spark, kind = rows.sparkSession, rows.schema[column].dataType
    tie = F.xxhash64(*[F.col(c) for c in rows.columns])
    ranged = rows.where(F.col(column).isNull()).withColumn("__tie", tie).repartitionByRange(*order, "__tie").sortWithinPartitions(*order, "__tie").drop("__tie")
    placed = ranged.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    placed.write.parquet(f"{scratch}/unnumbered")
    placed = spark.read.schema(placed.schema).parquet(f"{scratch}/unnumbered")
    sums, before = [], start
    for r in placed.groupBy("__part").agg(F.count(F.lit(1))).orderBy("__part").collect():  # a row per range
        sums.append((r[0], before))
        before += r[1]
    offsets = F.broadcast(spark.createDataFrame(sums, "__part int, __before long"))  # as many rows as the write had tasks
    numbered = placed.join(offsets, "__part").withColumn(column, (F.col("__before") + F.col("__at") + 1).cast(kind))
    return rows.where(F.col(column).isNotNull()).unionByName(numbered.select(*rows.columns))
