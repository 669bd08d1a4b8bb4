"""Removal of lines that are nearly repeated: an exact set-similarity join of the lines' word sets.

A later line goes if its Jaccard similarity to some earlier line is a threshold or more (earlier: by document id, then by
line number). ``line_dedup`` takes THRESHOLD where none is given, the query takes NEAR. All steps are DataFrame functions:

1. Words are ordered by rarity. How common a word is, is read from a table of RARITY counts over all lines, into which
   words are hashed; its size is fixed, so it is carried in the plan. Any order gives right results, a rare-first one few
   candidates. A word becomes one number that sorts so: its class of commonness, then its hash.
2. Lines with equal word sets (by 128 bits of hashes) form a class, which its earliest line stands for; the others go at
   once. A line is known by its document's id, a hash of id and text, and its number, so documents without an id, or with
   one id, are told apart by their texts (the hash orders them); rows that are the same in id and text are one.
3. Sets of size n that are similar enough share one of the first n - ceil(t n) + 1 words of each other, and the smaller one has
   it among the first n - ceil(2 t n / (1 + t)) + 1. These prefixes are joined by word. Pairs must pass a positional filter (the
   words from the shared one on must suffice in both sets, as they do for the first shared word) and a bitmap filter (words are
   hashed into 128 bits, each of which tells whether an odd number of the set's words fell on it; each bit in which two sets differ
   is a word that they don't share).
4. Of words that occur more than SHORT times, the earliest class of each band of lengths is compared with the rest of the word's
   list before, as a star. If these pairs show large groups, they are verified first; lines that are removed by that are settled,
   and what is settled meets only what isn't. So a line of a large group of near copies costs a pair for each of its prefix
   words, not one for each other line of the group.
5. Candidates are verified on the full sets, which are made for them alone. Their lines are fetched by a join; a bitmap
   of fixed size, made of the wanted lines, keeps most others from being moved. Where there are too many for it, it only
   lets more pass.
"""

from __future__ import annotations

import math
from contextlib import contextmanager
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, Scratch, fresh, table

THRESHOLD = (90, 100)
NEAR = (75, 100)
RARITY = 1 << 19
SHORT = 256  # a word that occurs more often is a common one: its list is compared with its first entries before
PASSES = 4  # words are listed, pairs found and compared a part at a time, so that the shuffles lie on disk one after the other
BITMAP = 1 << 16  # longs
_BREAKS = r"[\x20\x09-\x0D]+"
_LAST = (1 << 63) - 1


def _split(text: Column) -> Column:
    """Words, and empty strings between breaks. Where blanks are the only breaks, no pattern is needed."""
    other = F.lit(False)
    for c in "\t\n\x0b\x0c\r":
        other = other | F.contains(text, F.lit(c))
    return F.when(other, F.split(text, _BREAKS)).otherwise(F.split(text, " "))


def _hashes(line: Column) -> Column:
    """Distinct word hashes of a line."""
    return F.array_distinct(F.array_remove(F.transform(_split(line), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


ID = ("doc", "key")
LINE = (*ID, "line_no")


def _identity() -> list[Column]:
    doc_id = F.col("doc_id").cast("long")
    return [F.coalesce(doc_id, F.lit(_LAST)).alias("doc"), F.xxhash64(doc_id, F.col("text").cast("string")).alias("key")]


def split_lines(docs: DataFrame) -> DataFrame:
    """doc (never null), key, line_no, line; null ids come last."""
    return docs.select(*_identity(), F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n")).alias("line_no", "line"))


def rarity(docs: DataFrame) -> Column:
    """For each of RARITY buckets of word hashes, how often words of it occur in all texts, as half powers of two: a byte each of a binary literal."""
    words = split_lines(docs).select(F.explode(_split(F.col("line"))).alias("w")).select(F.xxhash64("w").alias("h"))
    counts = words.groupBy(F.col("h").bitwiseAND(RARITY - 1).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    both = F.col("b").cast("long") * 64 + F.least(F.lit(62), F.floor(2 * F.log2("n")))
    rows = counts.groupBy(F.pmod("b", F.lit(1024)).alias("part")).agg(F.array_join(F.collect_list(both.cast("string")), ",").alias("all")).collect()  # 1024 rows
    table_ = np.zeros(RARITY, np.uint8)
    for _, part in rows:
        found = np.array(part.split(","), np.int64)
        table_[found >> 6] = found & 63
    return F.lit(bytearray(table_.tobytes()))


def _keys(line: Column, ranks: Column) -> Column:
    """The line's words, rarest first, as numbers."""

    def key(h: Column) -> Column:
        at = h.bitwiseAND(RARITY - 1).cast("int") + 1
        rank = F.ascii(F.call_function("substring", ranks, at, F.lit(1)).cast("string"))
        return F.shiftleft(rank.cast("long"), 57).bitwiseOR(F.shiftrightunsigned(h, 7))

    # sort_array sorts longs as such; array_sort would call a comparator expression for each two words
    return F.sort_array(F.transform(_hashes(line), key))


def _prefix(n: Column, threshold: tuple[int, int]) -> Column:
    return (n - F.ceil(n * threshold[0] / threshold[1]) + 1).cast("int")


def _alike(x: str, y: str, threshold: tuple[int, int]) -> Column:
    """Whether two sets can be similar enough if the entries <x> and <y> are of the first word that they share: positional filter
    (which holds the lengths too) and bitmap filter."""
    t, whole = threshold
    n, rest, *bits = ((F.col(f"{x}{c}"), F.col(f"{y}{c}")) for c in ("n", "rest", "odd", "even"))
    apart = sum((F.bit_count(a.bitwiseXOR(b)) for a, b in bits), F.lit(0))  # words that only one has, at least
    both = n[0] + n[1]
    return (F.least(*rest) * (whole + t) >= both * t) & ((both - apart) * (whole + t) >= both * (2 * t))


def _cleaning(spark: SparkSession):
    """Within it, what a written table was shuffled through is deleted as soon as the table is there."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @contextmanager
    def held():
        before = spark.conf.get(name, None)
        spark.conf.set(name, "true")
        try:
            yield
        finally:
            if before is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, before)

    return held()


def repeated_lines(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """doc, key and line_no of the lines to remove. Lines without words are no candidates."""
    with _cleaning(spark):
        return _repeated_lines(spark, docs, threshold)


def _repeated_lines(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    t, whole = threshold
    scratch = Scratch(spark, "lines")
    lines = split_lines(docs)
    size = F.size("keys")
    # a filter on the words would be pushed below and would make them twice
    keyed = _worded(lines).select(*LINE, _keys(F.col("line"), rarity(docs)).alias("keys"))
    # words of the index are told apart by 31 bits: those that share them only make lists longer; common ones are negative
    common = (math.floor(2 * math.log2(SHORT)) + 1) << 57
    word = lambda k: F.when(k >= common, F.bitwise_not(k.bitwiseAND((1 << 31) - 1))).otherwise(k.bitwiseAND((1 << 31) - 1)).cast("int")
    prefix = F.transform(F.slice("keys", F.lit(1), _prefix(size, threshold)), word)
    one = lambda bit, k: F.call_function("shiftleft", bit, k.bitwiseAND(63).cast("int"))
    every = F.aggregate("keys", F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(one(F.lit(1).cast("long"), k)))
    odd = F.aggregate("keys", F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(one(F.shiftrightunsigned(k, 6).bitwiseAND(1), k)))
    known = keyed.select(*LINE, F.xxhash64("keys").alias("cls"), F.xxhash64(F.lit(3), "keys").alias("other"), size.alias("n"), prefix.alias("prefix"), odd.alias("odd"), every.alias("every"))
    known = scratch.write(known, "lines")
    first = F.min(F.struct(*LINE, "n", "odd", F.col("every").bitwiseXOR(F.col("odd")).alias("even"), "prefix")).alias("first")
    classes = scratch.write(known.groupBy("cls", "other").agg(first).select("first.*").withColumn("id", F.monotonically_increasing_id()), "classes")
    scratch.drop(known)
    firsts = classes.select("id", *LINE)
    able = classes.where(F.col("n") * whole >= (F.col("n") + 1) * t)  # a smaller set is similar enough to itself alone
    stars = scratch.write(_stars(able, threshold), "stars")
    settled = _later(scratch, stars, lines, firsts, threshold) if _heavy(stars, classes) else None
    if settled is not None:
        # from here on the ids of what is settled are negative
        own = F.when(F.col("gone"), F.bitwise_not("id")).otherwise(F.col("id"))
        able = able.join(settled.withColumn("gone", F.lit(True)), "id", "left").withColumn("id", own)
        able = scratch.write(able.select("id", "n", "odd", "even", "prefix"), "able")
    found = [scratch.write(_met(able, k, threshold), "met") for k in range(PASSES)]
    if settled is not None:
        scratch.drop(able)
    pairs = scratch.write(reduce(DataFrame.unionByName, found).distinct(), "pairs")
    scratch.drop(stars, *found)
    later = _later(scratch, pairs, lines, firsts, threshold)
    gone = scratch.write(later if settled is None else later.unionByName(settled).distinct(), "gone")
    scratch.drop(pairs)
    stay = firsts.join(gone, "id", "left_anti")
    return _worded(lines).select(*LINE).join(stay.select(*LINE), list(LINE), "left_anti")


def _pass(id_: str) -> Column:
    return F.pmod(F.col(id_), F.lit(PASSES))


def _worded(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(WORD))


def _entries(classes: DataFrame, *more: str) -> DataFrame:
    """A row for each word of the prefixes: what ``_alike`` asks for; rest: how many of the set's words there are from this one on."""
    n = F.col("n").cast("long")
    listed = classes.select("id", *more, n.alias("n"), "odd", "even", F.posexplode("prefix").alias("at", "word"))
    return listed.withColumn("rest", F.col("n") - F.col("at")).drop("at")


def _stars(classes: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of the earliest class and another one in the list of a common word, for each band of lengths."""
    t, whole = threshold
    band = F.floor(F.log("n") / math.log(whole / t)).alias("band")
    entry = ("doc", "id", "n", "rest", "odd", "even")
    listed = _entries(classes.where(F.array_min("prefix") < 0), "doc").where("word < 0").select("word", band, *entry)
    heads = listed.groupBy("word", "band").agg(F.min(F.struct(*entry)).alias("x"))
    both = listed.withColumnsRenamed({c: f"y_{c}" for c in entry}).join(heads.select("word", "band", *[F.col(f"x.{c}").alias(f"x_{c}") for c in entry]), ["word", "band"])
    return both.where((F.col("x_id") != F.col("y_id")) & _alike("x_", "y_", threshold)).select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def _heavy(stars: DataFrame, classes: DataFrame) -> bool:
    """Whether the pairs of large groups would be many beside the classes."""
    each = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    pairs = each.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    return bool(pairs) and pairs > classes.count()


def _met(classes: DataFrame, part: int, threshold: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of classes that meet in the lists of some words and may be similar enough; those with negative ids don't meet
    each other. The first word that two sets share lies, of the smaller set (y, or the one of the lower id), in the prefix that
    is enough among sets of its own size."""
    t, whole = threshold
    listed = _entries(classes).where(F.pmod("word", F.lit(PASSES)) == part)
    side = lambda c: [F.col(k).alias(f"{c}_{k}") for k in ("id", "n", "rest", "odd", "even")]
    short = listed.where(F.col("rest") * (whole + t) >= F.col("n") * (2 * t)).select("word", *side("y"))
    both = listed.select("word", *side("x")).join(short.hint("shuffle_hash"), "word")
    both = both.where("x_n > y_n or (x_n = y_n and x_id < y_id)").where("x_id >= 0 or y_id >= 0").where(_alike("x_", "y_", threshold))
    real = lambda c: F.when(F.col(c) < 0, F.bitwise_not(c)).otherwise(F.col(c))
    return both.select(real("x_id").alias("a"), real("y_id").alias("b")).distinct()


def _bitmap(where: DataFrame) -> Column:
    """The set of lines as an array of BITMAP longs, a bit for each hash value. It is made by a subquery: as a literal it would
    stand in every description of a plan that the driver holds."""
    h = F.xxhash64(*LINE)
    bits = where.select(F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP - 1).alias("at"), F.expr("shiftleft(1L, cast(xxhash64(doc, key, line_no) & 63 as int))").alias("bit"))
    every = where.sparkSession.range(BITMAP).select(F.col("id").alias("at")).join(bits.groupBy("at").agg(F.bit_or("bit").alias("bit")), "at", "left")
    longs = F.sort_array(F.collect_list(F.struct("at", F.coalesce("bit", F.lit(0).cast("long")).alias("bit"))))  # BITMAP rows
    return every.agg(F.transform(longs, lambda x: x["bit"])).scalar()


def _in_bitmap(bits: Column, h: Column) -> Column:
    word = bits[F.shiftrightunsigned(h, 6).bitwiseAND(BITMAP - 1).cast("int")]
    return F.getbit(word, h.bitwiseAND(63).cast("int")) == 1


def _later(scratch: Scratch, pairs: DataFrame, lines: DataFrame, firsts: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """id of the later class of each pair (a, b) whose full sets are similar enough, as a table."""
    t, whole = threshold
    need = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    where = scratch.write(firsts.join(need, "id", "left_semi"), "where")
    found = lines.where(_in_bitmap(_bitmap(where), F.xxhash64(*LINE))).join(where, list(LINE)).dropDuplicates(list(LINE))  # rows that are the same have the line each
    sets = scratch.write(found.select("id", *LINE, _hashes(F.col("line")).alias("words")), "sets")
    side = lambda c: sets.select(F.col("id").alias(c), F.struct(*LINE).alias(f"first_{c}"), F.col("words").alias(f"words_{c}"))
    shared = F.size(F.array_intersect("words_a", "words_b"))
    later = []
    for k in range(PASSES):
        both = pairs.where(_pass("a") == k).join(side("a").where(_pass("a") == k), "a").join(side("b"), "b")
        alike = both.where(shared * (whole + t) >= (F.size("words_a") + F.size("words_b")) * t)
        later.append(scratch.write(alike.select(F.when(F.col("first_a") < F.col("first_b"), F.col("b")).otherwise(F.col("a")).alias("id")).distinct(), "later"))
    scratch.drop(where, sets)
    return reduce(DataFrame.unionByName, later).distinct()


def _gone(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int]) -> DataFrame:
    """doc, key and, in order, the numbers of its removed lines; documents that lose none are left out."""
    return repeated_lines(spark, docs, threshold).distinct().groupBy(*ID).agg(F.sort_array(F.collect_list("line_no")).alias("removed"))


def _counted(docs: DataFrame, gone: DataFrame, *more: str) -> DataFrame:
    """A row per document: doc_id, n_lines, removed (null for none) and further columns of ``docs``."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    rows = docs.select("doc_id", *more, (F.coalesce(breaks, F.lit(0)) + 1).cast("int").alias("n_lines"), *_identity())
    return rows.join(gone, list(ID), "left")


def _kept(text: str, removed: str) -> Column:
    """A text without its removed lines; null texts stay null."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains(removed, i)), "\n")
    return F.when(F.col(removed).isNull(), F.col(text)).otherwise(kept)


def line_dedup(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, n_lines, n_removed and the numbers of the removed lines (from 0), in order.

    Null texts count as empty (one blank line). Lines without words stay. Documents with null ids are later than all
    others; documents that share an id, or have none, come in the order of a hash of their texts. Rows that are the same in
    id and text are one document: their lines don't remove each other, and all of them lose the same ones. Other columns are
    ignored; an empty table gives no rows. Very long texts and lines are read whole.
    """
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    return _counted(docs, _gone(spark, docs, threshold)).select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed_lines"))


def deduplicated(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = NEAR) -> DataFrame:
    """What ``line_dedup`` returns, and the text without those lines as kept_text."""
    removed = F.coalesce("removed", F.array().cast("array<int>"))
    rows = _counted(docs, _gone(spark, docs, threshold), "text")
    return rows.select("doc_id", "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed_lines"), _kept("text", "removed").alias("kept_text"))


def without_lines(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = NEAR) -> DataFrame:
    """``docs`` with all columns, whatever their names, and texts without repeated lines, as ``line_dedup`` finds them; null
    texts stay null."""
    names = {c: fresh(docs, f"__{c}") for c in (*ID, "removed")}
    gone = _gone(spark, docs, threshold).select(*[F.col(c).alias(n) for c, n in names.items()])
    both = docs.withColumns({names[c]: x for c, x in zip(ID, _identity(), strict=True)}).join(gone, [names[c] for c in ID], "left")
    return both.withColumn("text", _kept("text", names["removed"])).select(*docs.columns)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deduplicated`` documents; what ``line_dedup`` says of nulls, repeats and empty tables holds here."""
    return deduplicated(spark, table(spark, sf_dir, "documents"))
