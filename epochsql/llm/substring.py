"""Removal of repeated passages: every 35-word window that starts anywhere else too.

Windows are judged level by level, and only those repeated at one length are extended to twice that length:

1. 18 words. Of the 18-word windows inside a 35-word window, the one with the smallest hash (the leftmost of equal ones)
   is its anchor. Equal windows have equal anchors at equal places, so a window can only be repeated if its anchor is;
   and neighbouring windows share anchors, so about an eighth of all positions is counted instead of all of them.
2. 35 words, the length that is asked for (twice 18, less a word). The windows around repeated anchors are counted
   themselves. What is repeated at a greater length is covered by windows of this one, so the levels end here.

Counting at one level: tasks send 128-bit hashes to buckets by value, as packed arrays. A hash that a task holds twice is
known to be repeated, so its places need no answer, and one witness of it is sent for the others: a passage in a third of
all documents costs a row for each task, not for each document. A bucket's hashes are sorted in memory; there is a bucket
for every BUCKET_BYTES of text, however many that makes, and a task holds one at a time. Documents are known by a 128-bit
hash of id and text, which has no hot keys but repeated rows; both levels read one and the same exchange of the texts.

A document is worked on as a whole: a very long one takes about 40 bytes of memory for each of its bytes.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .textkit import Lane, Words, word_chunks

WINDOW = 35
GRAM = 18
BUCKET_BYTES = 28 << 20
#: Partitions of an exchange at most; beyond it a task works through several buckets, one after the other.
MAX_PARTITIONS = 1 << 16
FLUSH_ITEMS = 1 << 20
_LANES: dict[int, Lane] = {}


def lane(seed: int) -> Lane:
    if seed not in _LANES:
        _LANES[seed] = Lane(seed)
    return _LANES[seed]


def word_hashes(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each word."""
    return lane(800).words(w.buf, w.start, w.end), lane(803).words(w.buf, w.start, w.end)


def anchors(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring windows with one anchor: the anchor's word, the first window's and the last window's."""
    n, span = w.counts, WINDOW - GRAM + 1
    windows = np.maximum(n - WINDOW + 1, 0)
    total = int(windows.sum())
    if not total:
        return (np.zeros(0, np.int64),) * 3
    g = lane(801).windows(h, GRAM)
    # sliding minimum over span by doubling: m[i] = smallest of g[i : i + span], and its leftmost place
    key, place, width = g, np.arange(len(g)), 1
    while width < span:
        step = min(width, span - width)
        k = len(key) - step
        right = key[step:] < key[:k]
        key, place, width = np.where(right, key[step:], key[:k]), np.where(right, place[step:], place[:k]), width + step
    start = np.repeat(w.first[:-1], windows) + np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows)
    a = place[start]
    cut = np.flatnonzero((np.diff(a, prepend=-1) != 0) | (np.diff(start, prepend=-2) != 1))
    return a[cut], start[cut], start[np.append(cut[1:], total) - 1]


def grouped(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal pairs (a, b) together, and where each group of them begins in it."""
    order = np.argsort(a, kind="stable")
    x, y = a[order], b[order]
    same = x[1:] == x[:-1]
    if (same & (y[1:] != y[:-1])).any():  # one half alone does not tell these apart
        order = np.lexsort((b, a))
        x, y = a[order], b[order]
        same = x[1:] == x[:-1]
    new = np.ones(len(a), bool)
    new[1:] = ~same | (y[1:] != y[:-1])
    return order, new


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


Pair = tuple[np.ndarray, np.ndarray]


class Sender:
    """Collects (hash, document, place, length) and packs them into a blob for each bucket."""

    def __init__(self, buckets: int):
        self.buckets, self.held, self.n = buckets, [], 0

    def add(self, keys: Pair, doc: np.ndarray, h: Pair, place: np.ndarray, length: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(place):
            self.held.append((keys[0][doc], keys[1][doc], *h, place.astype(np.uint32), length.astype(np.uint8)))
            self.n += len(place)
        if self.n >= FLUSH_ITEMS:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        k, l, g, h, place, length = map(np.concatenate, zip(*self.held, strict=True))  # noqa: E741
        self.held, self.n = [], 0
        order, new = grouped(g, h)
        times = np.diff(np.append(np.flatnonzero(new), len(g)))
        known = np.zeros(len(g), bool)
        known[order] = np.repeat(times > 1, times)
        first = order[new][times > 1]
        buckets = np.uint64(self.buckets)
        # known places go to any bucket; the document's key spreads them
        to = np.where(known, k.astype(np.uint64), g) % buckets
        order = np.lexsort((l, k, known, to))
        k, l, g, h, place, length, known, to = (x[order] for x in (k, l, g, h, place, length, known, to))  # noqa: E741
        g_first, h_first = self._witness(first, order, g, h)
        w_to = g_first % buckets
        w_order = np.argsort(w_to, kind="stable")
        g_first, h_first, w_to = g_first[w_order], h_first[w_order], w_to[w_order]
        ids, blobs = [], []
        for b in np.union1d(to, w_to).tolist():
            i, j = np.searchsorted(to, [b, b + 1])
            u, v = np.searchsorted(w_to, [b, b + 1])
            m = i + int(np.searchsorted(known[i:j], True))
            cut = _runs(k[i:j], l[i:j], known[i:j]) if j > i else np.zeros(0, np.int64)
            parts = [struct.pack("<4q", m - i, j - m, v - u, len(cut)), g[i:m], h[i:m], g_first[u:v], h_first[u:v], k[i:j][cut], l[i:j][cut], np.diff(np.append(cut, j - i)).astype(np.uint32), place[i:j], length[i:j]]
            ids.append(b)
            blobs.append(b"".join(x if isinstance(x, bytes) else x.tobytes() for x in parts))
        for a in range(0, len(ids), 256):
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 256], pa.int64()), pa.array(blobs[a : a + 256], pa.binary())], names=["bucket", "blob"])

    @staticmethod
    def _witness(first: np.ndarray, order: np.ndarray, g: np.ndarray, h: np.ndarray) -> Pair:
        """The hashes that stood at ``first`` before the rows were put into ``order``."""
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return g[back[first]], h[back[first]]


def _unpack(blob) -> tuple:
    """Hashes (of unknown places), witnesses, number of unknown places, places, lengths, keys of all places."""
    unknown, known, w, runs = struct.unpack_from("<4q", blob)
    at, n = 32, unknown + known

    def take(kind, count):
        nonlocal at
        out = np.frombuffer(blob, kind, count, at)
        at += out.nbytes
        return out

    g, h, wg, wh = take(np.uint64, unknown), take(np.uint64, unknown), take(np.uint64, w), take(np.uint64, w)
    k, l, times = take(np.int64, runs), take(np.int64, runs), take(np.uint32, runs)  # noqa: E741
    return (g, h), (wg, wh), unknown, take(np.uint32, n), take(np.uint8, n), (np.repeat(k, times), np.repeat(l, times))


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The blobs of one bucket after the other; rows come in the order of their buckets."""
    now, held = None, []
    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(blob.as_buffer())
    if held:
        yield held


def _dealt(blobs: DataFrame, buckets: int) -> DataFrame:
    """Each bucket in one partition, as a stretch of rows."""
    parts = min(buckets, MAX_PARTITIONS)
    dealt = blobs.repartitionById(parts, F.expr(f"cast(bucket % {parts} as int)"))
    return dealt if parts == buckets else dealt.sortWithinPartitions("bucket")


def _verdicts(blobs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys (two halves), places and lengths of a bucket's items whose hash occurs elsewhere too."""
    each = [_unpack(x) for x in blobs]
    g, h = (np.concatenate([x[0][i] for x in each] + [x[1][i] for x in each]) for i in (0, 1))
    n = sum(len(x[0][0]) for x in each)
    order, new = grouped(g, h)
    starts = np.flatnonzero(new)
    times = np.diff(np.append(starts, len(g)))
    told = np.add.reduceat((order >= n).astype(np.int64), starts) > 0 if len(starts) else np.zeros(0, bool)
    verdict = np.zeros(len(g), bool)
    verdict[order] = np.repeat((times > 1) | told, times)
    good, at = [], 0
    for x in each:
        ok = np.ones(len(x[3]), bool)
        ok[: x[2]] = verdict[at : at + x[2]]
        at += x[2]
        good.append(ok)
    take = lambda f: np.concatenate([f(x)[ok] for x, ok in zip(each, good, strict=True)])
    return take(lambda x: x[5][0]), take(lambda x: x[5][1]), take(lambda x: x[3]), take(lambda x: x[4])


def repeated(blobs: DataFrame, buckets: int) -> DataFrame:
    """k, l and packed places (4 bytes each, then a byte of length each) of all items whose hash occurs elsewhere too.

    A row per document: verdicts travel back in packs for groups of documents and are put together there.
    """

    def judge(batches):
        for held in _by_bucket(batches):
            k, l, place, length = _verdicts(held)  # noqa: E741
            group = k.astype(np.uint64) % np.uint64(buckets)
            order = np.lexsort((l, k, group))
            k, l, place, length, group = (x[order] for x in (k, l, place, length, group))  # noqa: E741
            cut = np.append(_runs(group), len(group)) if len(group) else np.zeros(1, np.int64)
            for i, j in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                first = _runs(k[i:j], l[i:j])
                runs = np.diff(np.append(first, j - i)).astype(np.uint32)
                pack = b"".join([struct.pack("<2q", len(first), j - i), k[i:j][first].tobytes(), l[i:j][first].tobytes(), runs.tobytes(), place[i:j].tobytes(), length[i:j].tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([int(group[i])], pa.int64()), pa.array([pack], pa.binary())], names=["bucket", "blob"])

    def gather(batches):
        for held in _by_bucket(batches):
            parts = []
            for blob in held:
                m, n = struct.unpack_from("<2q", blob)
                runs = np.frombuffer(blob, np.uint32, m, 16 + 16 * m)
                keys = [np.repeat(np.frombuffer(blob, np.int64, m, 16 + 8 * m * i), runs) for i in (0, 1)]
                parts.append((*keys, np.frombuffer(blob, np.uint32, n, 16 + 20 * m), np.frombuffer(blob, np.uint8, n, 16 + 20 * m + 4 * n)))
            k, l, place, length = map(np.concatenate, zip(*parts, strict=True))  # noqa: E741
            order, _ = grouped(k, l)
            k, l, place, length = (x[order] for x in (k, l, place, length))  # noqa: E741
            cut = np.append(_runs(k, l), len(k))
            for a in range(0, len(cut) - 1, 2048):
                c = cut[a : a + 2049]
                packed = [place[i:j].tobytes() + length[i:j].tobytes() for i, j in zip(c[:-1], c[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(k[c[:-1]]), pa.array(l[c[:-1]]), pa.array(packed, pa.binary())], names=["k", "l", "places"])

    judged = map_arrow(_dealt(blobs, buckets), judge, "bucket long, blob binary")
    return map_arrow(_dealt(judged, buckets), gather, "k long, l long, places binary")


def _places(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct places and their lengths (repeated rows have sent theirs each)."""
    n = len(packed) // 5
    where, at = np.unique(np.frombuffer(packed, np.uint32, n), return_index=True)
    return where.astype(np.int64), np.frombuffer(packed, np.uint8, n, 4 * n)[at].astype(np.int64)


def _expand(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    return np.repeat(start, length) + np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)


def _anchor_blobs(texts: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        out = Sender(buckets)
        for b in batches:
            keys = [b.column(i).to_numpy() for i in (0, 1)]
            for lo, hi, w in word_chunks(b.column(2)):
                g, h = word_hashes(w)
                a, p, q = anchors(w, g)
                doc = np.searchsorted(w.first, p, "right") - 1
                yield from out.add([x[lo:hi] for x in keys], doc, (lane(801).windows(g, GRAM)[a], lane(804).windows(h, GRAM)[a]), p - w.first[doc], q - p + 1)
        yield from out.flush()

    return map_arrow(texts.select("k", "l", "text"), run, "bucket long, blob binary")


def _window_blobs(texts: DataFrame, runs: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        out = Sender(buckets)
        for b in batches:
            keys, packed = [b.column(i).to_numpy() for i in (1, 2)], b.column(4)
            for lo, hi, w in word_chunks(b.column(3)):
                g, h = (lane(seed).windows(x, WINDOW) for seed, x in zip((802, 805), word_hashes(w), strict=True))
                doc, place = [], []
                for d in range(hi - lo):
                    at = _expand(*_places(packed[lo + d].as_py()))
                    doc.append(np.full(len(at), d))
                    place.append(at)
                doc, place = np.concatenate(doc), np.concatenate(place)
                at = w.first[doc] + place
                yield from out.add([x[lo:hi] for x in keys], doc, (g[at], h[at]), place, np.ones(len(place)))
        yield from out.flush()

    # with all columns of the last join, so that both read the same exchange of the texts
    return map_arrow(texts.join(runs, ["k", "l"]).select("doc_id", "k", "l", "text", "places"), run, "bucket long, blob binary")


def strip_repeats(docs: DataFrame, with_text: bool = True, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """A row per document: doc_id, n_words, n_removed, kept_sha256, and ``kept_text`` if asked for (kept words joined by
    one space).

    Null, empty and short texts keep all their words; repeated rows repeat each other's windows; ids may be null; an
    empty table gives no rows; other columns are ignored, also those named as columns in here. Very long texts are read
    whole. Windows are taken as equal by 128 bits of hashes: among n windows, two different ones meet with a chance of
    n^2 / 2^129, under one in a million for 10^16 windows.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))
    texts = docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text).alias("k"), F.xxhash64(text, F.lit(803), doc_id).alias("l"), text.alias("text"))
    runs = repeated(_anchor_blobs(texts, buckets), buckets)
    found = repeated(_window_blobs(texts, runs, buckets), buckets)

    def run(batches):
        for b in batches:
            packed = b.column(4)
            for lo, hi, w in word_chunks(b.column(3)):
                n = w.counts
                keep = np.ones(len(w.start), bool)
                for d in range(hi - lo):
                    if packed[lo + d].is_valid:
                        at, _ = _places(packed[lo + d].as_py())
                        cover = np.zeros(n[d] + 1, np.int32)
                        cover[at] += 1
                        np.subtract.at(cover, at + WINDOW, 1)
                        keep[w.first[d] : w.first[d + 1]] = np.cumsum(cover[:-1]) == 0
                doc_end = np.repeat(w.edges[1:], n)
                mark = np.zeros(len(w.buf) + 1, np.int8)
                mark[w.start[keep]] += 1
                np.subtract.at(mark, np.minimum(w.end + 1, doc_end)[keep], 1)
                mask = np.cumsum(mark[:-1], dtype=np.int8) > 0
                blank = np.zeros(len(w.buf) + 1, bool)
                blank[w.end] = True
                blank[w.edges] = False
                clean = np.where(blank[:-1], np.uint8(32), w.buf)
                edges = w.edges.tolist()
                kept = [clean[i:j][mask[i:j]].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)]
                kept = [x[:-1] if x.endswith(b" ") else x for x in kept]
                left = np.add.reduceat(np.append(keep, False), w.first[:-1], dtype=np.int64) * (n > 0) if len(n) else n
                columns = [b.column(0)[lo:hi], pa.array(n), pa.array(n - left), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
                columns += [pa.array([x.decode() for x in kept], pa.string())] if with_text else []
                yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text]
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return map_arrow(texts.join(found, ["k", "l"], "left").select("doc_id", "k", "l", "text", "places"), run, schema)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``strip_repeats`` of documents without the texts; what it says of nulls, repeats and empty tables holds here."""
    return strip_repeats(table(spark, sf_dir, "documents"), with_text=False)


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35),
w AS (SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h FROM i),
r AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
c AS (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM w WHERE h IN (SELECT h FROM r)),
g AS (SELECT DISTINCT doc_id, p FROM c),
k AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
o AS (SELECT k.doc_id, string_agg(k.word, ' ' ORDER BY k.p) AS kept, count(*) AS n FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.p = g.p WHERE g.p IS NULL GROUP BY k.doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, (len(d.ws) - coalesce(o.n, 0))::BIGINT AS n_removed, sha256(coalesce(o.kept, '')) AS kept_sha256
FROM d LEFT JOIN o ON d.doc_id = o.doc_id
"""
