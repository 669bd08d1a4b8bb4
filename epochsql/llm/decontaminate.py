"""Benchmark decontamination: training passages as queries against a BM25 inverted index of the test items.

Every document is cut into overlapping passages, each a query of its distinct words. An item is indexed twice, as a whole
and by its question alone, so that an answer may stand anywhere in the document. Retrieval returns *all* entries whose BM25
score reaches a share of the score that the entry gets from its own text. Postings hold each term's contribution divided
by that threshold, so every entry is retrieved at 1.0.

Retrieval is block-max WAND with a fixed threshold, turned from one passage at a time to all passages of a chunk at once.
A passage ends where the sum of its terms' greatest contributions stays below 1.0. For the others the sums of block maxima
are taken, a block being a range of entries, and postings outside the blocks that can reach 1.0 are skipped: a table has
where each term's postings of each block begin. What is left is scored. Bounds are sums of maxima, so nothing that reaches
the threshold is lost. (Cursors and pivots, passage by passage, gave the same pairs at over sixty times the cost: test items
and texts share their words, so half of all passages pass the first bounds.)

A retrieved pair counts once the item's question and answer are both found in the document: shares of their word
5-grams, in the whole document. An item's last third of words is its answer, the words before it are its question.

Idf and mean length are taken over all items, and passages are as long as an entry's own class of lengths asks for, so
what is found of an item depends on no other item but by idf, nor on how items are cut into blocks. A pass over the
documents takes an index of PASS_BYTES of item texts at most in each worker's memory; larger test sets take more passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, table
from .textkit import CHUNK_BYTES, LETTER_OR_DIGIT, Lane, Words, chunks, string_column

K1, B = 1.2, 0.75
SHARE = 0.6
OVERLAP = 0.75
GRAM = 5
STRIDE_LEAST = 64
BLOCKS = 48
PASS_BYTES = 16 << 20
MARGIN = 1e-4
SEED = 101
_LANES: dict[int, Lane] = {}


def _lane() -> Lane:
    if SEED not in _LANES:
        _LANES[SEED] = Lane(SEED)
    return _LANES[SEED]


def folded(text: pa.Array) -> pa.Array:
    """Lower case; the sharp s as ss, which is what capitals make of it."""
    return pa.compute.replace_substring(pa.compute.utf8_lower(text), "\u00df", "ss")


def bare_words(buf: np.ndarray, edges: np.ndarray) -> Words:
    """Runs of letters and digits of lower-cased texts."""
    return Words(np.where(LETTER_OR_DIGIT[buf], buf, np.uint8(32)), edges)


def hashed_words(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a column of texts, and where each text's begin."""
    w = bare_words(*string_column(folded(text)))
    return _lane().words(w.buf, w.start, w.end), w.first


def grams(h: np.ndarray, k: int = GRAM) -> np.ndarray:
    return np.unique(_lane().windows(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


def question_words(n: int) -> int:
    return n - max(1, n // 3) if n > 1 else n


class Statistics:
    """Over all items: their number, their mean length, and in how many of them a term stands."""

    def __init__(self, n: int, mean_length: float, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.terms, self.df = n, max(1.0, mean_length), terms, df

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log1p((self.n - df + 0.5) / (df + 0.5))


class Postings:
    """The inverted index of entries of one class of lengths; contributions are scaled so that an entry is retrieved at 1.0."""

    def __init__(self, entries: list[tuple[int, np.ndarray]], stride: int, stats: Statistics, share: float = SHARE):
        self.stride = stride
        self.entry_item = np.array([i for i, _ in entries], np.int64)
        n, length = len(entries), np.array([len(h) for _, h in entries])
        h = np.concatenate([h for _, h in entries])
        self.vocabulary, term = np.unique(h, return_inverse=True)
        key, tf = np.unique(term * n + np.repeat(np.arange(n), length), return_counts=True)
        term, self.entry = key // n, key % n
        impact = stats.idf(self.vocabulary)[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[self.entry] / stats.mean))
        own = np.bincount(self.entry, impact, n)  # in the order of the terms' hashes, so the same in any index
        self.impact = impact / np.maximum(own * share, 1e-12)[self.entry]
        self.edges = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.term_max = np.zeros(len(self.vocabulary))
        np.maximum.at(self.term_max, term, self.impact)
        # blocks are ranges of entries; for each term and block, its greatest contribution and its first posting
        self.per_block = -(-n // BLOCKS)
        blocks = -(-n // self.per_block)
        cell = term * blocks + self.entry // self.per_block
        self.block_max = np.zeros(len(self.vocabulary) * blocks, np.float32)
        np.maximum.at(self.block_max, cell, np.nextafter(self.impact.astype(np.float32), np.float32(np.inf)))  # no bound is rounded down
        self.block_max = self.block_max.reshape(-1, blocks)
        self.begin = np.searchsorted(cell, np.arange(len(self.vocabulary) * blocks + 1)).astype(np.int32)
        slots = 1 << max(10, int(np.ceil(np.log2(8 * max(1, len(self.vocabulary))))))
        self.mask = np.zeros(slots, bool)
        self.mask[(self.vocabulary % np.uint64(slots)).astype(np.int64)] = True

    def terms(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the words that the vocabulary has, and their term numbers."""
        maybe = np.flatnonzero(self.mask[(h % np.uint64(len(self.mask))).astype(np.int64)])
        t = np.minimum(np.searchsorted(self.vocabulary, h[maybe]), len(self.vocabulary) - 1)
        hit = self.vocabulary[t] == h[maybe]
        return maybe[hit], t[hit]

    def passages(self, w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (passage, term) pairs in order, and the first passage of each document."""
        at, term = self.terms(h)
        doc = np.searchsorted(w.first, at, "right") - 1
        half = (at - w.first[doc]) // self.stride
        base = np.concatenate(([0], np.cumsum(-(-w.counts // self.stride))))
        number = base[doc] + half  # passage p covers half-passages p and p + 1 of its document
        back, size = half > 0, len(self.vocabulary)
        key = np.unique(np.concatenate([number, number[back] - 1]) * size + np.concatenate([term, term[back]]))
        return key // size, key % size, base

    def retrieve(self, passage: np.ndarray, term: np.ndarray, n_passages: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (passage, entry, score) with score >= 1, from distinct (passage, term) pairs in order."""
        limit = 1 - MARGIN  # sums in another order may differ by rounding
        keep = (np.bincount(passage, self.term_max[term], n_passages + 1) >= limit)[passage]
        passage, term = passage[keep], term[keep]
        if not len(passage):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        new = np.diff(passage, prepend=-1) != 0
        row, blocks = np.cumsum(new) - 1, self.block_max.shape[1]
        good = np.add.reduceat(self.block_max[term], np.flatnonzero(new)) >= limit
        # the postings of each term in the blocks that its passage may find something in
        pair, block = np.nonzero(good[row])
        cell = term[pair] * blocks + block
        n = self.begin[cell + 1] - self.begin[cell]
        some = np.flatnonzero(n)
        n, first, at = n[some].astype(np.int64), self.begin[cell[some]].astype(np.int64), pair[some]
        post = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        key = np.repeat(passage[at], n) * len(self.entry_item) + self.entry[post]
        keys, back = np.unique(key, return_inverse=True)
        score = np.bincount(back, self.impact[post], len(keys)) if len(keys) else np.zeros(0)
        ok = score >= limit
        return keys[ok] // len(self.entry_item), keys[ok] % len(self.entry_item), score[ok]


class Index:
    """Postings by classes of lengths, and the 5-grams of each item's question and answer."""

    def __init__(self, items: list[tuple[int, np.ndarray]], stats: Statistics, share: float = SHARE):
        """items: (id, word hashes)."""
        self.ids = [i for i, _ in items]
        self.parts = [(grams(h[: question_words(len(h))]), grams(h[question_words(len(h)) :])) for _, h in items]
        by_stride: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, (_, h) in enumerate(items):
            for part in {len(h), question_words(len(h))} - {0}:
                stride = STRIDE_LEAST  # a copy of up to stride words lies whole in one passage
                while stride < part:
                    stride *= 2
                by_stride.setdefault(stride, []).append((n, h[:part]))
        self.postings = [Postings(e, stride, stats, share) for stride, e in sorted(by_stride.items())]

    def matches(self, w: Words, h: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(document, item, best score, question overlap, answer overlap) of all retrieved pairs."""
        found: dict[tuple[int, int], float] = {}
        for p in self.postings:
            passage, term, base = p.passages(w, h)
            passage, entry, score = p.retrieve(passage, term, int(base[-1]))
            for doc, item, x in zip((np.searchsorted(base, passage, "right") - 1).tolist(), p.entry_item[entry].tolist(), score.tolist(), strict=True):
                found[doc, item] = max(x, found.get((doc, item), 0.0))
        last, own = None, None
        for doc, item in sorted(found):
            if doc != last:
                words = h[w.first[doc] : w.first[doc + 1]]
                last, own = doc, np.unique(np.concatenate([_lane().windows(words, k) for k in range(1, GRAM + 1)]))
            yield doc, item, found[doc, item], *(overlap_of(part, own) for part in self.parts[item])


def overlap_of(part: np.ndarray, own: np.ndarray) -> float:
    """The share of a part's grams that the document has. A part shorter than a gram is one gram of its length."""
    return 1.0 if not len(part) else float(np.isin(part, own).mean())


def indexes(items: DataFrame, pass_bytes: int = PASS_BYTES, share: float = SHARE) -> Iterator[Index]:
    """Indexes of all items with a text, in the order of their ids, each of about ``pass_bytes`` of texts at most."""
    items = items.where("text is not null").select(F.coalesce(F.col("item_id").cast("long"), F.lit(-1)).alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0

    def hashed(rows) -> list[tuple[int, np.ndarray]]:
        h, first = hashed_words(pa.array([r[1] for r in rows], pa.large_string()))
        return [(r[0], h[a:b]) for r, a, b in zip(rows, first[:-1], first[1:], strict=True)]

    def counted(held: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([np.unique(h) for _, h in held]), return_counts=True)

    ordered = items.orderBy("item_id", "text")
    if total <= pass_bytes:
        held = [x for x in hashed(ordered.collect()) if len(x[1])]  # pass_bytes of text at most
        if held:
            yield Index(held, Statistics(len(held), sum(len(h) for _, h in held) / len(held), *counted(held)), share)
        return

    def terms(batches):
        for b in batches:
            h, first = hashed_words(b.column(0))
            item = np.repeat(np.arange(b.num_rows), np.diff(first))
            n = np.diff(first)[item]
            order = np.lexsort((h, item))
            new = np.ones(len(h), bool)
            new[1:] = (h[order][1:] != h[order][:-1]) | (item[order][1:] != item[order][:-1])
            at = order[new]
            first_of = np.diff(item[at], prepend=-1) != 0
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(np.where(first_of, n[at], 0)), pa.array(first_of)], names=["term", "words", "first"])

    scratch = Scratch(items.sparkSession, "items")
    one = map_arrow(items.select("text"), terms, "term long, words long, first boolean")
    df = scratch.write(one.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("words").alias("words"), F.count_if("first").alias("n")), "terms")
    words, n = df.agg(F.sum("words"), F.sum("n")).first()

    def index(held):
        own = counted(held)[0]
        asked = items.sparkSession.createDataFrame(pa.table({"term": own.view(np.int64)}))  # the terms of one pass
        got = df.join(F.broadcast(asked), "term").select("term", "df").collect()
        t = np.array([r[0] for r in got], np.int64).view(np.uint64)
        order = np.argsort(t)
        return Index(held, Statistics(n, words / n, t[order], np.array([r[1] for r in got])[order]), share)

    held, size = [], 0
    for r in ordered.toLocalIterator():
        if held and size + len(r[1].encode()) > pass_bytes:
            yield index(held)
            held, size = [], 0
        held += [x for x in hashed([r]) if len(x[1])]
        size += len(r[1].encode())
    if held:
        yield index(held)
    scratch.drop_all()


def found_in(index: Index, text: pa.Array, overlap: float = OVERLAP) -> Iterator[tuple[int, int, float, float, float]]:
    """(row, item id, score, question overlap, answer overlap) of all contaminated pairs of a column of texts."""
    buf, edges = string_column(folded(text))
    for a, b in chunks(edges, CHUNK_BYTES // 2):
        w = bare_words(buf[edges[a] : edges[b]], edges[a : b + 1] - edges[a])
        for d, i, s, q, r in index.matches(w, _lane().words(w.buf, w.start, w.end)):
            if q >= overlap and r >= overlap:
                yield a + d, int(index.ids[i]), s, q, r


def leaks(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """A row per document and test item that it contains: doc_id, item_id, score, question_overlap, answer_overlap.

    Null and empty texts and items match nothing; null ids stay null (a null item id becomes -1); repeated rows and
    repeated items are reported each, with equal scores; other columns are ignored; no documents or no items give no rows.
    Very long texts are read whole, all their passages, at about 40 bytes of memory for each of their bytes.
    """
    out = None
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    for built in indexes(items, pass_bytes):
        index = docs.sparkSession.sparkContext.broadcast(built)  # bounded by pass_bytes

        def run(batches, index=index):
            for b in batches:
                rows = [(b.column(0)[d].as_py(), i, round(s, 6), round(q, 6), round(r, 6)) for d, i, s, q, r in found_in(index.value, b.column(1), overlap)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), *[pa.float64()] * 3), strict=True)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        found = map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema)
        out = found if out is None else out.unionByName(found)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaking(docs: DataFrame, items: DataFrame, overlap: float = OVERLAP, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``docs``, with all columns whatever their names, that contain no test item.

    Rows with null or empty texts stay, as do all rows if there are no items; ids are not looked at, so null and repeated
    ones are no matter; each of repeated rows is judged by its own text, so they stay or go together; an empty table stays
    empty.
    """
    at = docs.columns.index("text")
    for built in indexes(items, pass_bytes):
        index = docs.sparkSession.sparkContext.broadcast(built)

        def run(batches, index=index):
            for b in batches:
                bad = np.zeros(b.num_rows, bool)
                for d, *_ in found_in(index.value, b.column(at), overlap):
                    bad[d] = True
                yield b.filter(pa.array(~bad))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``leaks`` of documents against benchmark; what it says of nulls, repeats and empty tables holds here."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
