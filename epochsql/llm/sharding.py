"""Proportional stratified interleaving: every shard gets the mixture of the whole.

Rows are shuffled by a seeded key and ranked inside their source; row r of n has the fractional rank (r + 1/2) / n.
In the order of fractional ranks every stretch holds all sources in proportion, and equal cuts of that order are the
shards. Only ids, sources, sizes and checksums are moved, never texts. Everything is built of DataFrame functions.

The seeded shuffle is one of texts: rows of a source with equal texts get neighbouring ranks, so they lie in one shard unless
a cut, whose place the row counts fix, falls among them, or unless they are more than a shard holds of their source. Groups
of more than one row in HOT_SHARE are ranked in parts, so no task sees one of them as a whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, n_bytes, table
from .ranking import BUCKETS, running

SHARDS = 40
ROW_OVERHEAD = 16
HOT_SHARE = 4096


def assign_shards(spark: SparkSession, docs: DataFrame, n_shards: int = SHARDS, seed: int = 9) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: the shards' row counts differ by one at most; within that, equal texts of a source are kept
    together. Slots count from 0 in each shard, in training order. Null texts count as empty (size 16, checksum 0); null
    sources are a source of their own; null ids are shuffled as an empty id; repeated rows are placed as rows of their own;
    ties in the shuffled order go by id; an empty table gives no rows; other columns are ignored. Very long texts are read
    once, for their size and checksums.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("-")).alias("__source"),
        (n_bytes(F.col("text")) + ROW_OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary")).alias("__key"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("__own"),
    )
    scratch = Scratch(spark, "shards")
    rows = scratch.write(rows, "rows")
    total = rows.count()
    hot = rows.groupBy("__source", "__key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > max(BUCKETS, total // HOT_SHARE))
    hot = F.broadcast(hot.select("__source", "__key", F.lit(True).alias("__hot")))  # fewer than HOT_SHARE groups
    # buckets lie in the order of keys; those of a hot group follow the bucket that its key would have, by ids
    head = F.substring("__key", 1, 3)
    bucket = F.when(F.col("__hot"), F.concat(head, F.lit("~"), F.col("__key"), F.substring("__own", 1, 3))).otherwise(head)
    rows = rows.join(hot, ["__source", "__key"], "left").withColumn("__bucket", bucket).drop("__hot")
    order = [F.col(c).asc_nulls_last() for c in ("__key", "__own", "doc_id")]
    ranked = running(rows, "__source", "__bucket", order, F.lit(1), "__rank")
    counts = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__n"))
    fraction = (2 * F.col("__rank") + 1) / (2 * F.col("__n"))
    placed = ranked.join(counts, "__source").withColumn("__fraction", fraction)
    placed = placed.withColumn("__all", F.lit(0)).withColumn("__cell", F.least(F.lit(BUCKETS - 1), F.floor(F.col("__fraction") * BUCKETS)).cast("int"))
    placed = scratch.write(placed.drop("__bucket", "__n", "__key", "__own"), "placed")
    order = [F.col(c).asc_nulls_last() for c in ("__fraction", "__source", "__rank")]
    placed = running(placed, "__all", "__cell", order, F.lit(1), "__at")
    placed = placed.withColumn("__shard", F.expr(f"__at * {n_shards} div {max(total, 1)}"))
    first = F.expr(f"(__shard * {total} + {n_shards - 1}) div {n_shards}")
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").cast("int").alias("shard"),
        (F.col("__at") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``assign_shards`` of documents; what it says of nulls, ties, repeats and empty tables holds here."""
    return assign_shards(spark, table(spark, sf_dir, "documents"))
