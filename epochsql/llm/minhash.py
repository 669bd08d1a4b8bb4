"""Near-duplicate documents by one-permutation MinHash.

1. A document's shingle set is hashed once. The hash's top bits choose one of 128 bins, each bin keeps its smallest
   hash, and an empty bin borrows from the first full bin of an order of its own (optimal densification). Equal sets
   form a class, which is one node from here on, so exact copies never meet each other. Sets are equal by 128 bits of
   hashes: a class has the number of its first 64 bits, and where sets of two kinds share it (a pair in 2^64), the others
   are given numbers of their own.
2. Four bins make a band; classes that share a band share one of 32 buckets. At a similarity of 0.75 a pair shares no
   bucket with a chance of (1 - 0.75^4)^32, or 5 in a million.
3. Candidate edges are stars: in each bucket one centre (the class with most bucket mates) is paired with the others.
   Edges whose signatures agree too little for the threshold, by a wide margin, go; the others are confirmed on full
   shingle sets, and confirmed ones are contracted to components.
4. A star doesn't test its leaves against each other. So whatever of a bucket lies outside its largest component is
   compared with the bucket's other components, by signatures packed in blocks of about 256 classes, which make a row
   for each two blocks, not for each pair. Pairs that agree are confirmed on full sets as before. So no two classes that
   share a bucket stay uncompared unless one component holds both, and pairs inside a component are not spent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, map_arrow, table
from .textkit import Lane, Words, mix, word_chunks

SHINGLE = 5
BINS = 128
ROWS = 4
BANDS = BINS // ROWS
THRESHOLD = (75, 100)
BLOCK = 256
FINE_BITS = 9
FINE = 1 << FINE_BITS
SIGMAS = 4.5
_LANES: dict[int, Lane] = {}


def _lane(seed: int = 202) -> Lane:
    if seed not in _LANES:
        _LANES[seed] = Lane(seed)
    return _LANES[seed]


def _donor_orders() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(203))
    return np.stack([rng.permutation(BINS) for _ in range(BINS)])


DONORS = _donor_orders()


def shingle_sets(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all documents, and each document's edges in them.

    With fewer than k words the whole sequence is one shingle.
    """
    lane = _lane()
    h = lane.words(w.buf, w.start, w.end)
    n = w.counts
    sizes = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    doc = np.repeat(np.arange(len(n)), sizes)
    at = w.first[doc] + np.arange(edges[-1]) - edges[doc]
    full = lane.windows(h, k)
    out = np.zeros(edges[-1], np.uint64)
    whole = n[doc] >= k
    out[whole] = full[at[whole]]
    for short in range(1, k):
        here = n[doc] == short
        if here.any():
            out[here] = lane.windows(h, short)[at[here]]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        out[a:b].sort()
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[new], np.concatenate(([0], np.cumsum(np.bincount(doc[new], minlength=len(n)))))


def signatures(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Densified one-permutation signatures, documents x BINS. Rows of empty sets mean nothing."""
    n = len(edges) - 1
    doc = np.repeat(np.arange(n), np.diff(edges))
    bin_ = (sets >> np.uint64(57)).astype(np.int64)
    key = doc * BINS + bin_
    first = np.flatnonzero(np.diff(key, prepend=-1))  # sets are sorted, so this is each bin's smallest
    sig, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    sig[key[first]], full[key[first]] = sets[first], True
    sig, full = sig.reshape(n, BINS), full.reshape(n, BINS)
    d, i = np.nonzero(~full & (np.diff(edges) > 0)[:, None])
    for a in range(0, len(d), 1 << 15):
        dd, ii = d[a : a + (1 << 15)], i[a : a + (1 << 15)]
        order = DONORS[ii]
        donor = order[np.arange(len(dd)), full[dd[:, None], order].argmax(1)]
        sig[dd, ii] = sig[dd, donor]
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    """Bucket keys, documents x BANDS; the band's number is part of its keys."""
    odd = mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
    return mix((sig.reshape(len(sig), BANDS, ROWS) * odd).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, key (a hash of id and text), n (set size), cls and other (hashes of the whole set; null without words), bands
    and fine signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in word_chunks(b.column(2), lower=True):
                sets, edges = shingle_sets(w)
                n = np.diff(edges)
                (cls, other), some = _classes(sets, edges), n > 0
                keys = bands_of(signatures(sets, edges))
                fine = fine_signatures(sets, edges).tobytes()
                none = pa.array(~some)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.view(np.int64).ravel()), mask=none)
                yield pa.RecordBatch.from_arrays([*(b.column(i)[lo:hi] for i in (0, 1)), pa.array(n), *(pa.array(x.view(np.int64), mask=~some) for x in (cls, other)), lists, pa.array([fine[i : i + FINE] for i in range(0, len(fine), FINE)], pa.binary())], names=["doc_id", "key", "n", "cls", "other", "bands", "signature"])

    return map_arrow(_keyed(docs), run, "doc_id long, key long, n long, cls long, other long, bands array<long>, signature binary")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, key and text. Rows with one id or without one have keys of their own, unless their texts are the same."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("key"), text.alias("text"))


def _classes(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each whole set."""
    out = []
    for salt in (0xD6E8FEB86659FD93, 0x9FB21C651E98DF25):
        c = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(mix(sets ^ np.uint64(salt)), out=c[1:])
        out.append(mix(c[edges[1:]] - c[edges[:-1]] + np.diff(edges).astype(np.uint64)))
    return out[0], out[1]


def _told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (with cls and other) with another cls for sets that only share their first 64 bits with a class."""
    both = rows.groupBy("cls").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo != hi")
    clash = [(r[0], r[1]) for r in both.select("cls", "lo").collect()]  # one for each pair of sets in 2^64
    if not clash:
        return rows
    known = F.create_map(*[F.lit(x) for pair in clash for x in pair])
    return rows.withColumn("cls", F.when(known[F.col("cls")] != F.col("other"), F.xxhash64("cls", "other")).otherwise(F.col("cls")))


def _sets(docs: DataFrame, reps: DataFrame, repeated: bool) -> DataFrame:
    """cls and its sorted shingle hashes, for the classes of ``reps`` (cls, and doc_id and key of one of its documents), a row
    for each. ``repeated``: some rows of ``docs`` are the same in id and text."""

    def run(batches):
        for b in batches:
            for lo, hi, w in word_chunks(b.column(1), lower=True):
                sets, edges = shingle_sets(w)
                raw, cut = sets.tobytes(), (edges * 8).tolist()
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([raw[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["cls", "hashes"])

    # a null id stands as 0 beside the key, which tells it from a real one
    on = lambda x, *more: x.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "key", *more)
    # a merge join at every size: the representatives grow with the documents
    texts = on(_keyed(docs), "text").join(on(reps, "cls").hint("merge"), ["doc_id", "key"]).select("cls", "text")
    return map_arrow(texts.dropDuplicates(["cls"]) if repeated else texts, run, "cls long, hashes binary")


def fine_signatures(sets: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """A byte for each of FINE bins, documents x FINE: of the bin's smallest hash, or 0 where it is empty."""
    doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    key = doc * FINE + (sets >> np.uint64(64 - FINE_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(key, prepend=-1))
    out = np.zeros((len(edges) - 1) * FINE, np.uint8)
    out[key[first]] = mix(sets[first]) % np.uint64(255) + np.uint64(1)
    return out.reshape(-1, FINE)


def may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, threshold: tuple[int, int] = THRESHOLD) -> np.ndarray:
    """Whether fine signatures agree as sets at the threshold do, less SIGMAS standard deviations; n: sum of set sizes.

    Of the bins that either fills, as many agree as the sets are similar; they are a sample of the union, drawn without
    replacement. Bins filled from equal elements always agree.
    """
    goal = threshold[0] / threshold[1]
    either, agree = ((x | y) != 0).sum(-1), ((x == y) & (x != 0)).sum(-1)
    union = np.maximum(n / (1 + goal), either)
    spread = np.sqrt(goal * (1 - goal) / np.maximum(either, 1) * (1 - either / np.maximum(union, 1)) + 1e-6)
    return agree >= (goal - SIGMAS * spread) * either - 1


def agreeing(edges: DataFrame, signs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The edges (a, b) whose signatures agree enough."""

    def run(batches):
        for b in batches:
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, FINE) for c in (b.column(4), b.column(5)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(may_link(x, y, n, threshold)))

    joined = edges.join(signs.select(F.col("cls").alias("b"), F.col("n").alias("m"), F.col("signature").alias("y")), "b")
    joined = joined.join(signs.select(F.col("cls").alias("a"), "n", F.col("signature").alias("x")), "a")
    return map_arrow(joined.select("a", "b", "n", "m", "x", "y"), run, "a long, b long")


def between_components(mates: DataFrame, comp: DataFrame, signs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """Pairs (a, b) of different components that share a bucket and whose signatures agree enough.

    A pair is looked at in the first bucket that it shares; if that bucket's star had one of them as its centre, it has
    been tested there.
    """
    part, whole = threshold
    now = mates.select("bucket", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    parts = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"))
    open_ = parts.groupBy("bucket").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m")).where("top.k < m")
    left = now.join(open_.select("bucket", F.col("top.comp").alias("main"), "m"), "bucket").join(signs, "cls")
    left = left.withColumn("outside", F.col("comp") != F.col("main")).withColumn("block", F.pmod(F.xxhash64("cls"), F.expr(f"m div {BLOCK} + 1")))
    packed = left.groupBy("bucket", "outside", "block").agg(F.collect_list(F.struct("cls", "n", "comp", "signature", "bands")).alias("x"))
    here = packed.select("bucket", "x.cls", "x.n", "x.comp", "x.signature", "x.bands")
    there = packed.where("outside").select("bucket", F.col("x.cls").alias("cls_b"), F.col("x.n").alias("n_b"), F.col("x.comp").alias("comp_b"), F.col("x.signature").alias("signature_b"), F.col("x.bands").alias("bands_b"))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                cls, n, comp, cls_b, n_b, comp_b = (np.asarray(b.column(j)[i].values) for j in (0, 1, 2, 5, 6, 7))
                sig, sig_b = (np.frombuffer(b"".join(b.column(j)[i].as_py()), np.uint8).reshape(-1, FINE) for j in (3, 8))
                bands, bands_b = (np.asarray(b.column(j)[i].values.flatten()).reshape(-1, BANDS) for j in (4, 9))
                band = int(np.flatnonzero(bands[0] == b.column(10)[i].as_py())[0])
                out_a, out_b = [], []
                for k in range(len(cls_b)):
                    small, large = np.minimum(n, n_b[k]), np.maximum(n, n_b[k])
                    ok = (comp != comp_b[k]) & (whole * small >= part * large)
                    at = np.flatnonzero(ok)
                    at = at[~(bands[at, :band] == bands_b[k, :band]).any(1)]
                    at = at[may_link(sig[at], sig_b[k], n[at] + n_b[k], threshold)]
                    out_a.append(np.minimum(cls[at], cls_b[k]))
                    out_b.append(np.maximum(cls[at], cls_b[k]))
                if any(map(len, out_a)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])

    both = here.join(there, "bucket")
    return map_arrow(both.select("cls", "n", "comp", "signature", "bands", "cls_b", "n_b", "comp_b", "signature_b", "bands_b", "bucket"), run, "a long, b long")


def confirm(edges: DataFrame, sets: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """The edges (a, b) whose full sets reach the threshold."""
    part, whole = threshold

    def run(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(whole * both >= part * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    joined = edges.join(sets.select(F.col("cls").alias("b"), F.col("hashes").alias("y")), "b")
    joined = joined.join(sets.select(F.col("cls").alias("a"), F.col("hashes").alias("x")), "a")
    return map_arrow(joined.select("a", "b", "x", "y"), run, "a long, b long")


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """node and comp (the component's smallest node), for the nodes of ``edges`` (distinct pairs a < b), by alternating large
    and small stars.

    It is done once no node with a smaller neighbour has another one too: then each is a centre or hangs on one alone.
    """
    now = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    made = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("k"))
        if low.where("m < u and k > 1").isEmpty():
            tops = now.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(tops)
        large = both.where("v > u").join(low.select("u", F.least("u", "m").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = scratch.write(small.where("u != v").distinct(), "cc")
        if made is not None:
            scratch.drop(made)
        made = now


def _alike(x: str, y: str, threshold: tuple[int, int] = THRESHOLD):
    """Sets that can reach the threshold by their sizes."""
    return F.least(x, y) * threshold[1] >= F.greatest(x, y) * threshold[0]


def near_components(spark: SparkSession, docs: DataFrame, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest id reachable over links), kept.

    Null and empty texts and texts of white space have no shingles and link to nothing. Repeated rows have one id and are
    kept or not together. Null ids never name a component unless all ids in it are null. An empty table gives no rows. Other
    columns are ignored. Very long texts are read whole, at about 40 bytes of memory for each of their bytes.
    """
    scratch = Scratch(spark, "near")
    sketched = scratch.write(sketch(docs), "sketch")
    wide = _told_apart(sketched)
    base = scratch.write(wide.select("doc_id", "key", "n", "cls"), "sets")
    buckets = wide.select("cls", "n", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("bucket")
    mates = scratch.write(buckets.join(shared, "bucket", "left_semi").distinct(), "mates")
    sizes = mates.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
    mates = mates.join(sizes, "bucket")
    score = mates.groupBy("cls").agg(F.sum("size").alias("score"))
    mates = scratch.write(mates.join(score, "cls").drop("size"), "scored")
    need = scratch.write(score.select("cls"), "need")
    signs = scratch.write(wide.select("cls", "n", "signature", "bands").join(need, "cls", "left_semi").dropDuplicates(["cls"]), "signs")
    scratch.drop(sketched)
    reps = base.where("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("rep"))
    reps = scratch.write(reps.join(need, "cls", "left_semi").select("cls", "rep.doc_id", "rep.key"), "reps")
    repeated = not base.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty()
    sets = scratch.write(_sets(docs, reps, repeated), "sets")
    centre = mates.groupBy("bucket").agg(F.max(F.struct("score", "cls", "n")).alias("c")).select("bucket", F.col("c.cls").alias("b"), F.col("c.n").alias("n_b"))
    pairs = mates.withColumnRenamed("cls", "a").join(centre, "bucket")
    left = mates.join(centre.select("bucket", F.col("b").alias("cls")), ["bucket", "cls"], "left_anti")
    stars = pairs.where("a != b").where(_alike("n", "n_b", threshold)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    stars = scratch.write(stars, "stars")
    links = scratch.write(confirm(agreeing(stars, signs, threshold), sets, threshold), "links")
    first = scratch.write(components(scratch, links), "components")
    rest = scratch.write(between_components(left, first, signs, threshold).distinct().join(stars, ["a", "b"], "left_anti"), "rest")
    more = scratch.write(confirm(rest, sets, threshold), "links")
    comp = scratch.write(components(scratch, links.unionByName(more)), "components")
    scratch.drop(sets, reps, mates, signs, need, stars, links, first, rest, more)
    rows = base.select("doc_id", "n", "cls").join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("cls", F.coalesce("comp", "cls"))
    lowest = rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("lowest"))
    rows = rows.join(lowest, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("lowest")))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, but those whose component another document stands for.

    Rows without an id can't be told apart and stay, and rows that share one id stay or go together. Documents without
    words link to nothing and stay. An empty table stays empty. Names of other columns are no matter.
    """
    name = fresh(docs, "__gone")
    gone = near_components(spark, docs).where("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"] == gone[name], "left_anti")


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``near_components`` of documents; what it says of nulls, repeats and empty tables holds here."""
    return near_components(spark, table(spark, sf_dir, "documents"))
