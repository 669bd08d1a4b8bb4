"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's documents, shuffled by a seeded key, form one stream of words that is cut into blocks of equal length.
Slot k of the training order takes one block: van der Corput's point k (its bits mirrored behind the binary point)
falls into the interval of one source on the line of cumulative target weights. A source's slots take its blocks in
turn, from the start again once the stream is used up. Everything is built of DataFrame functions; texts are never moved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, n_words, table
from .ranking import key_bucket, running, shuffle_key

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 128
BITS = 40
CELLS = 1024
CHUNK = 1 << 16


def source_key(source: Column) -> Column:
    """Sorts as the source does by code point, with null last; never null itself."""
    return F.coalesce(F.concat(F.lit("+"), source.cast("string")), F.lit("\U0010ffff"))


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """__source, source_size, target and the interval [__from, __to) of each source.

    Targets are weight shares of ``share`` times all words, stopped at ``most`` times the source's words. Resharing the
    excess until none is above ends where every source without a stop gets its weight times one common level. Sources
    in the order of stop over weight reach their stops first, so the level comes from running sums. A row per source.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = rows.groupBy("__source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy("__source")) - 1) % len(weights)
    per = per.withColumn("__w", F.array(*map(F.lit, weights))[turn]).withColumn("__stop", most * F.col("source_size").cast("double"))
    by_stop = Window.orderBy((F.col("__stop") / F.col("__w")).asc(), "__source")
    spent = F.coalesce(F.sum("__stop").over(by_stop.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("__w").over(by_stop.rowsBetween(0, Window.unboundedFollowing))
    budget = share * F.sum("source_size").over(every).cast("double")
    per = per.withColumn("__level", (budget - spent) / left)
    level = F.max(F.when(F.col("__stop") > F.col("__w") * F.col("__level"), F.col("__level"))).over(every)
    per = per.withColumn("target", F.least("__stop", F.coalesce(F.col("__w") * level, F.col("__stop"))))
    upto = F.sum("target").over(Window.orderBy("__source").rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum("target").over(every)
    per = per.withColumn("__to", F.when(whole > 0, upto / whole).otherwise(0.0))
    per = per.withColumn("__from", F.coalesce(F.lag("__to").over(Window.orderBy("__source")), F.lit(0.0)))
    last = F.col("__source") == F.max("__source").over(every)
    return per.withColumn("__to", F.when(last, F.lit(2.0)).otherwise(F.col("__to"))).drop("__w", "__stop", "__level")


class Mix:
    """The plan of a mix: ``rows`` (a row per document with its place in its source's stream), ``targets`` and ``schedule``."""

    def __init__(self, spark: SparkSession, docs: DataFrame, seed: int = 7, block: int = BLOCK_WORDS, weights=WEIGHTS, share: float = SHARE, most: float = MOST):
        self.spark, self.block = spark, block
        scratch = self.scratch = Scratch(spark, "mix")
        rows = docs.select("doc_id", source_key(F.col("source")).alias("__source"), n_words(F.col("text")).alias("size"), shuffle_key(seed, F.col("doc_id"), F.col("text")).alias("__key"))
        rows = scratch.write(rows.withColumn("__bucket", key_bucket(F.col("__key"))), "rows")
        targets = source_targets(rows, weights, share, most)
        targets = targets.withColumn("__take", F.least(F.round("target"), most * F.col("source_size").cast("double")).cast("long"))
        blocks = F.expr(f"(source_size + {block - 1}) div {block}")
        targets = targets.withColumn("__blocks", blocks)
        passes, rest = F.expr("__take div nullif(source_size, 0)"), F.expr("__take % nullif(source_size, 0)")
        need = F.coalesce(passes * F.col("__blocks") + F.ceil(rest / block), F.lit(0)).cast("long")
        self.targets = scratch.write(targets.withColumn("__need", need), "targets")
        order = [F.col(c).asc_nulls_last() for c in ("__key", "doc_id", "size")]
        self.rows = scratch.write(running(rows, "__source", "__bucket", order, F.col("size"), "__at").drop("__bucket", "__key"), "placed")
        scratch.drop(rows)
        self.slots = scratch.write(self._slots(), "slots")
        self.schedule = self._schedule()

    def _slots(self) -> DataFrame:
        """slot, __source and __turn: which of its source's slots it is. A source stops when its target is met; the few
        slots that a source is short of (its points are within a logarithm of its share) come behind all others."""
        total = self.targets.agg(F.coalesce(F.sum("__need"), F.lit(0))).first()[0]
        if total > 1 << BITS:
            raise ValueError(f"{total} slots are more than points of {BITS} bits can order")
        point = F.conv(F.reverse(F.lpad(F.bin("slot"), BITS, "0")), 2, 10).cast("double") / float(1 << BITS)
        points = self.spark.range(total).select(F.col("id").alias("slot")).withColumn("__u", point).withColumn("__cell", F.floor(F.col("__u") * CELLS).cast("int"))
        top = F.lit(CELLS - 1)
        cells = F.sequence(F.least(top, F.floor(F.col("__from") * CELLS).cast("int")), F.least(top, F.floor(F.col("__to") * CELLS).cast("int")))
        spans = self.targets.where("__to > __from").select("__source", "__from", "__to", F.explode(cells).alias("__cell"))
        found = points.join(spans, "__cell").where("__u >= __from and __u < __to").select("slot", "__source").withColumn("__chunk", F.expr(f"slot div {CHUNK}"))
        found = self.scratch.write(found, "points")  # read several times below
        found = running(found, "__source", "__chunk", [F.col("slot")], F.lit(1), "__turn").drop("__chunk")
        have = found.groupBy("__source").agg(F.count(F.lit(1)).alias("__have"))
        short = self.targets.join(have, "__source", "left").select("__source", "__need", F.coalesce("__have", F.lit(0)).alias("__have")).where("__have < __need")
        more = short.select("__source", F.explode(F.sequence(F.col("__have"), F.col("__need") - 1)).alias("__turn"))
        more = more.withColumn("slot", F.lit(total - 1) + F.row_number().over(Window.orderBy("__turn", "__source")))
        kept = found.join(self.targets.select("__source", "__need"), "__source").where("__turn < __need").drop("__need")
        return kept.select("slot", "__source", "__turn").unionByName(more.select(F.col("slot").cast("long"), "__source", F.col("__turn").cast("long")))

    def _schedule(self) -> DataFrame:
        """slot, __source, pass, block, doc_id, __at, start (first word in the document), n_words."""
        b = self.block
        pieces = self.rows.where("size > 0").select("doc_id", "__source", "__at", "size", F.explode(F.sequence(F.expr(f"__at div {b}"), F.expr(f"(__at + size - 1) div {b}"))).alias("block"))
        slots = self.slots.join(self.targets.select("__source", "source_size", "__blocks", "__take"), "__source")
        slots = slots.select("slot", "__source", F.expr("__turn div __blocks").alias("pass"), F.expr("__turn % __blocks").alias("block"), "source_size", "__take")
        stop = F.least(F.col("__at") + F.col("size"), (F.col("block") + 1) * b, F.col("__take") - F.col("pass") * F.col("source_size"))
        start = F.greatest(F.col("__at"), F.col("block") * b)
        both = slots.join(pieces, ["__source", "block"]).withColumn("n_words", stop - start).where("n_words > 0")
        return both.select("slot", "__source", "pass", "block", "doc_id", "__at", (start - F.col("__at")).alias("start"), "n_words")

    def taken(self) -> DataFrame:
        """A row per document: doc_id, size, source_size, target, taken, and the first slot that takes words of it."""
        sums = self.schedule.groupBy("__source", F.col("__at").alias("__from_at")).agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
        rows = self.rows.withColumn("__from_at", F.when(F.col("size") > 0, F.col("__at")))
        rows = rows.join(sums, ["__source", "__from_at"], "left").join(self.targets.select("__source", "source_size", "target"), "__source")
        return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot of every document.

    Null texts and texts without words have size 0 and are never taken; null sources are one source, the last; null ids
    are shuffled as an empty id; repeated rows are documents of their own; an empty table gives no rows; other columns
    are ignored. A source's taken words are its target, rounded. first_slot is the first place of the schedule that takes
    words of the document, null if none does; ties are none, as a slot takes one block of one source. Very long texts are
    counted whole and lie in as many blocks as they need.
    """
    return Mix(spark, table(spark, sf_dir, "documents")).taken()


def mix_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as the mix takes it: taken words over size, rounded to whole copies.

    Rows that share an id, or have none, are taken alike. All columns of ``docs`` stay as they are, whatever their names.
    Null texts and texts without words are never taken; null sources are one source; an empty table stays empty.
    """
    key, copy = fresh(docs, "__id"), fresh(docs, "__copy")
    taken = Mix(spark, docs).taken().groupBy(F.col("doc_id").alias("__id")).agg(F.sum("taken").alias("__taken"), F.sum("size").alias("__size"))
    copies = taken.select(F.col("__id").alias(key), F.when(F.col("__size") > 0, F.round(F.col("__taken") / F.col("__size"))).otherwise(0).cast("int").alias(copy))
    copies = copies.where(copies[copy] > 0)
    both = docs.join(copies, docs["doc_id"].eqNullSafe(copies[key]))
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), both[copy]))).select(*[docs[c] for c in docs.columns])


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS k
  FROM documents),
s AS (
  SELECT source, source IS NULL AS none, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s)
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size / w, none, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(w) OVER (ORDER BY source_size / w, none, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (
  SELECT source, none, source_size, least(2.0::DOUBLE * source_size, coalesce(w * (SELECT max(level) FROM l WHERE 2.0::DOUBLE * source_size > w * level), 2.0::DOUBLE * source_size))::DOUBLE AS target
  FROM l),
n AS (
  SELECT source, none, source_size, target, round(target)::BIGINT AS take, (source_size + 127) // 128 AS blocks,
         CASE WHEN source_size = 0 THEN 0 ELSE round(target)::BIGINT // source_size * ((source_size + 127) // 128) + (round(target)::BIGINT % source_size + 127) // 128 END AS need,
         CASE WHEN row_number() OVER (ORDER BY none DESC, source DESC) = 1 THEN 2.0::DOUBLE
              ELSE sum(target) OVER (ORDER BY none, source ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / nullif(sum(target) OVER (), 0) END AS upto
  FROM t),
i AS (SELECT *, coalesce(lag(upto) OVER (ORDER BY none, source), 0.0::DOUBLE) AS since FROM n),
u AS (
  SELECT slot, list_sum(list_transform(range(0, 40), lambda b: ((slot >> b::INTEGER) & 1)::DOUBLE / (1::BIGINT << (b::INTEGER + 1))::DOUBLE)) AS u
  FROM (SELECT unnest(range(0, (SELECT coalesce(sum(need), 0)::BIGINT FROM n))) AS slot)),
f AS (SELECT slot, source, none, row_number() OVER (PARTITION BY none, source ORDER BY slot) - 1 AS turn FROM u JOIN i ON u >= since AND u < upto),
h AS (SELECT i.source, i.none, i.need, count(f.slot) AS have FROM i LEFT JOIN f ON f.none = i.none AND f.source IS NOT DISTINCT FROM i.source GROUP BY i.source, i.none, i.need),
m AS (SELECT source, none, unnest(range(have, need)) AS turn FROM h WHERE have < need),
k AS (
  SELECT f.slot, f.source, f.none, f.turn FROM f JOIN n ON f.none = n.none AND f.source IS NOT DISTINCT FROM n.source WHERE f.turn < n.need
  UNION ALL SELECT (SELECT sum(need)::BIGINT FROM n) - 1 + row_number() OVER (ORDER BY turn, none, source), source, none, turn FROM m),
p AS (
  SELECT row_number() OVER () AS r, doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_it
  FROM d),
b AS (SELECT r, source, size, before_it, unnest(range(before_it // 128, (before_it + size - 1) // 128 + 1)) AS block FROM p WHERE size > 0),
z AS (
  SELECT b.r, min(k.slot)::BIGINT AS first_slot
  FROM k JOIN n ON k.none = n.none AND k.source IS NOT DISTINCT FROM n.source JOIN b ON b.source IS NOT DISTINCT FROM k.source AND b.block = k.turn % n.blocks
  WHERE least(b.before_it + b.size, (b.block + 1) * 128, n.take - k.turn // n.blocks * n.source_size) > greatest(b.before_it, b.block * 128)
  GROUP BY b.r)
SELECT p.doc_id, p.size, n.source_size, n.target,
       CASE WHEN n.source_size = 0 THEN 0 ELSE
         least(p.size, greatest(0, n.take - p.before_it)) + least(p.size, greatest(0, n.take - n.source_size - p.before_it))
       END::BIGINT AS taken, z.first_slot
FROM p JOIN n ON p.source IS NOT DISTINCT FROM n.source LEFT JOIN z ON z.r = p.r
"""
