"""Time travel over a change log.

A log has a row per change: ``_rid`` (which row), ``_seq`` (order), ``_op`` (I, U or D), ``row`` (after) and ``pre``
(before; null for I). All functions are plain DataFrame plans: one aggregation by row id, with partial aggregation
before the shuffle, and an anti-join on the reverse path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward(log: DataFrame, until: Column) -> DataFrame:
    """_rid and row of the rows alive after all changes for which ``until`` holds: the latest change of each row wins."""
    last = log.where(until).groupBy("_rid").agg(F.max_by(F.struct("_op", "row"), "_seq").alias("c"))
    return last.where(F.col("c._op") != "D").select("_rid", F.col("c.row").alias("row"))


def reverse(live: DataFrame, log: DataFrame, after: Column) -> DataFrame:
    """The same from the live rows: rows touched by changes for which ``after`` holds go back to before the first one."""
    first = log.where(after).groupBy("_rid").agg(F.min_by(F.struct("pre"), "_seq").alias("c")).select("_rid", F.col("c.pre").alias("row"))
    return live.select("_rid", "row").join(first, "_rid", "left_anti").unionByName(first.where("row is not null"))


def choose(records_before: int, records_after: int) -> str:
    """The direction that reads fewer changes; at a tie the reverse one, which starts from rows that are there."""
    return "forward" if records_before < records_after else "reverse"


def diff(now: DataFrame, then: DataFrame) -> DataFrame:
    """The changes (_rid, _op, row, pre) that turn ``now`` into ``then``."""
    a, b = now.select("_rid", F.col("row").alias("pre")), then.select("_rid", "row")
    both = a.join(b, "_rid", "full")
    op = F.when(F.col("pre").isNull(), "I").when(F.col("row").isNull(), "D").otherwise("U")
    return both.where(~F.col("row").eqNullSafe(F.col("pre"))).select("_rid", op.alias("_op"), "row", "pre")


def states_from_events(events: DataFrame, key: list[str], order: list[str], deletes: Column) -> DataFrame:
    """A log for forward replay alone: an event is the new row of its key, or its end where ``deletes`` holds.

    Forward replay asks only whether a change is a deletion, not what was before it, so no row has to see the one before:
    a filter on ``_ts`` reaches the scan, and replay costs one exchange.
    """
    gone = F.coalesce(deletes, F.lit(False))
    row = F.struct(*events.columns)
    return events.select(F.struct(*key).alias("_rid"), F.struct(*order).alias("_seq"), F.col(order[0]).alias("_ts"), F.when(gone, "D").otherwise("U").alias("_op"), F.when(~gone, row).alias("row"))


def log_from_events(events: DataFrame, key: list[str], order: list[str], deletes: Column) -> DataFrame:
    """A full change log out of events, with what was before each change (one window over each key's events)."""
    row = F.struct(*events.columns)
    w = Window.partitionBy(*key).orderBy(*order)
    gone = F.coalesce(deletes, F.lit(False))
    before = F.lag(F.struct(gone.alias("gone"), row.alias("row"))).over(w)
    df = events.select(F.struct(*key).alias("_rid"), F.struct(*order).alias("_seq"), F.col(order[0]).alias("_ts"), gone.alias("__gone"), row.alias("row"), before.alias("__before"))
    pre = F.when(F.col("__before").isNotNull() & ~F.col("__before.gone"), F.col("__before.row"))
    df = df.withColumn("pre", pre)
    op = F.when(F.col("__gone"), "D").when(F.col("pre").isNull(), "I").otherwise("U")
    return df.select("_rid", "_seq", "_ts", op.alias("_op"), F.when(~F.col("__gone"), F.col("row")).alias("row"), "pre")


def history(log: DataFrame) -> DataFrame:
    """Every version of every row with the interval [_from, _to) in which it held; _to is null for live ones."""
    w = Window.partitionBy("_rid").orderBy("_seq")
    return log.withColumn("_to", F.lead("_ts").over(w)).where("_op != 'D'").select("_rid", F.col("_ts").alias("_from"), "_to", "row")
