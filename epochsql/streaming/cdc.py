"""Commits as a stream: each micro-batch holds the changes of the commits that came since the last one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.changelog import Database


def change_stream(db: Database, table: str, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Calls sink(changes, batch id) with _commit, _ts, _rid, _seq, _op, row and pre of each new commit, in whole commits.

    The source is the folder of commit files, so staged and rolled-back changes are never seen; Spark's checkpoint keeps
    which commits were delivered.
    """
    db.files.mkdirs(f"{db.path}/commits")
    commits = db.spark.readStream.schema("value string").format("text").option("wholetext", "true").load(f"{db.path}/commits")
    named = commits.select(F.regexp_extract("_metadata.file_name", r"(\d+)\.json", 1).cast("long").alias("n"))

    def batch(new: DataFrame, batch_id: int) -> None:
        numbers = sorted(r["n"] for r in new.collect())  # commit numbers of one micro-batch
        known, out = db.commits(), None
        for n in numbers:
            paths = known[n]["tables"].get(table, {}).get("paths")
            if paths:
                part = db.spark.read.schema(db.meta(table).log_type).parquet(*paths).select(F.lit(n).alias("_commit"), F.lit(known[n]["ts"]).alias("_ts"), "*")
                out = part if out is None else out.unionByName(part)
        if out is not None:
            sink(out, batch_id)

    writer = named.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
