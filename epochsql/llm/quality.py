"""Ordinal cumulative-link regression on graded ratings of documents.

A document's score is one linear function of hashed text features; ordered thresholds cut the score into grades:
P(grade >= k) = sigmoid(score - threshold_k). The weights are shared by all thresholds, so a document that is likely
to reach a high grade is likelier still to reach the lower ones. Selection uses the tail probability of a grade.

Ratings are 0 (toxic), 1 (poor) and 2 (good). The model is fitted on the driver, on the whole texts of at most ``max_rated``
rated documents (those whose ids hash lowest); all documents are scored. Executors read these texts twice: once to count
in how many of them, and with what grades, each column occurs, and once for their values in the telling columns, the only
ones that get a weight. So texts of any length can be read, and the driver gets no column that the fit would leave out.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, trim_memory
from .textkit import Lane, Words, mix, word_chunks

DIMS = 1 << 18
MAX_RATED = 8000
MAX_BYTES = 48 << 20
GRADES = 3
KEEP_GRADE = 2
KEEP_PROBABILITY = 0.4
_SIDE = 64
STEMS = (4, 5, 6, 7)
_LANE: list[Lane] = []
#: Bytes of letters: ASCII letters and all of multi-byte characters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


def _lane() -> Lane:
    if not _LANE:
        _LANE.append(Lane(606))
    return _LANE[0]


def features(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows (document edges, columns, values): hashed words and side features.

    A word enters without its bordering punctuation, lower-cased, as a whole and by its first 4 to 7 bytes (stems), with
    log2(1 + count) / 2. Side features, in the last columns: a constant, and bins of the shares of capitals, of symbols
    and of the commonest word, and of distinct words.
    """
    n_docs = len(w.edges) - 1
    letter = LETTER[w.buf]
    at = np.arange(len(w.buf), dtype=np.int64)
    after = np.full(len(w.buf) + 1, len(w.buf), np.int64)  # the next letter at or after a byte
    before = np.zeros(len(w.buf) + 1, np.int64)  # just past the last letter before a byte
    after[:-1] = np.minimum.accumulate(np.where(letter, at, len(w.buf))[::-1])[::-1]
    before[1:] = np.maximum.accumulate(np.where(letter, at + 1, 0))
    start, end = np.minimum(after[w.start], w.end), np.maximum(before[w.end], w.start)
    bare = end > start  # else a word without letters stands as it is
    start, end = np.where(bare, start, w.start), np.where(bare, end, w.end)
    capital = (w.buf >= 65) & (w.buf <= 90)
    doc = np.repeat(np.arange(n_docs) * DIMS, w.counts)
    kinds = [(start, end, doc), *((start[far], start[far] + n, doc[far]) for n in STEMS if len(far := np.flatnonzero(end - start > n)))]
    ends = np.concatenate([k[1] for k in kinds])
    hashed = _lane().words(np.where(capital, w.buf + 32, w.buf).astype(np.uint8), np.concatenate([k[0] for k in kinds]), ends)
    col = (hashed % np.uint64(DIMS - _SIDE)).astype(np.int64)
    whole = np.unique(doc + col[: len(doc)], return_counts=True)  # words alone, for the shares
    key, count = np.unique(np.concatenate([k[2] for k in kinds]) + col, return_counts=True)
    doc, col = key // DIMS, key % DIMS
    value = np.log2(1 + count) / 2
    size, words = np.maximum(np.diff(w.edges), 1), np.maximum(w.counts, 1)
    total = lambda x: np.diff(np.concatenate(([0], np.cumsum(x)))[w.edges])
    top = np.zeros(n_docs, np.int64)
    np.maximum.at(top, whole[0] // DIMS, whole[1])
    symbol = (w.buf > 32) & (w.buf < 127) & ~letter & ~((w.buf >= 48) & (w.buf <= 57))
    long = w.counts >= 20  # in a short text the shares of words say little
    bins = (10 * total(capital) // size, 20 * total(symbol) // size, np.where(long, 10 * top // words, 0), np.where(long, 10 * np.bincount(whole[0] // DIMS, minlength=n_docs) // words, 9))
    side = np.stack([np.full(n_docs, DIMS - _SIDE), *(DIMS - _SIDE + 1 + 10 * i + np.minimum(9, x) for i, x in enumerate(bins))], 1)
    order = np.argsort(np.concatenate([doc, np.repeat(np.arange(n_docs), side.shape[1])]), kind="stable")
    edges = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n_docs) + side.shape[1])))
    return edges, np.concatenate([col, side.ravel()])[order], np.concatenate([value, np.ones(side.size)])[order]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, edges, col, value) -> np.ndarray:
        """P(grade >= k) for k = 1 and up: documents x (grades - 1)."""
        sums = np.add.reduceat(self.weights[col] * value, edges[:-1]) if len(edges) > 1 else np.zeros(0)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - sums[:, None], -40, 40)))


LEAST, TELLING = 5, 4.0
FIT_VALUES = 1 << 23  # of a block of the fit


def telling_columns(times: np.ndarray, sums: np.ndarray, of_grade: np.ndarray, least: int = LEAST, telling: float = TELLING) -> np.ndarray:
    """Which columns get a weight, from the number of rated documents that have each, the sum of their grades, and the number
    of documents of each grade: those of ``least`` documents or more, whose mean grade lies ``telling`` standard errors or more
    from the mean of all; and the side features."""
    n, grade = max(1, of_grade.sum()), np.arange(len(of_grade))
    mean = (of_grade * grade).sum() / n
    deviation = np.sqrt((of_grade * (grade - mean) ** 2).sum() / n)
    chosen = (times >= least) & (np.abs(sums - times * mean) >= telling * deviation * np.sqrt(times))
    chosen[DIMS - _SIDE :] = True
    return chosen


def fit(edges: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int = GRADES, least: int = LEAST, telling: float = TELLING, rounds: int = 300, rate: float = 0.05, decay: float = 1e-4, chosen: np.ndarray | None = None) -> Model:
    """Maximum likelihood with weight decay by full-batch Adam; thresholds are kept in order. Deterministic.

    Only ``telling_columns`` get a weight. ``chosen`` are these, where the rows given hold no others.
    """
    n = len(grade)
    if chosen is None:
        doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(edges))
        chosen = telling_columns(np.bincount(col, minlength=DIMS), np.bincount(col, grade[doc], DIMS), np.bincount(grade, minlength=grades), least, telling)
        keep = chosen[col]
        edges, col, value = np.concatenate(([0], np.cumsum(keep)))[edges], col[keep], value[keep]
    used = np.zeros(DIMS, bool)
    for i in range(0, len(col), FIT_VALUES):
        used[col[i : i + FIT_VALUES]] = True
    place = np.cumsum(used) - 1
    used = np.flatnonzero(used)
    cuts, to = [0], 0  # documents in blocks of FIT_VALUES values, or one document
    while to < n:
        to = min(n, max(to + 1, int(np.searchsorted(edges, edges[to] + FIT_VALUES, "right")) - 1))
        cuts.append(to)

    def block(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(edges[lo : hi + 1])), place[col[edges[lo] : edges[hi]]], np.asarray(value[edges[lo] : edges[hi]])

    ranges = list(zip(cuts[:-1], cuts[1:], strict=True))
    held = [block(0, n)] if len(ranges) == 1 else None  # more than one are made in each round anew, so memory is bounded
    blocks = lambda: zip(ranges, held or (block(*r) for r in ranges), strict=True)
    x = np.zeros(len(used) + grades - 1)
    share = np.array([(grade >= k).mean() for k in range(1, grades)]).clip(0.01, 0.99) if n else np.full(grades - 1, 0.5)
    x[len(used) :] = np.sort(np.log((1 - share) / share))
    m, v = np.zeros_like(x), np.zeros_like(x)
    weight = 1 / np.maximum(np.bincount(grade, minlength=grades), 1)[grade] if n else np.zeros(0)
    weight = 0.5 * weight * n / max(1, weight.sum()) + 0.5
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, rounds * (n > 0) + 1):
        w, b = x[: len(used)], x[len(used) :]
        s = np.concatenate([np.bincount(doc, w[at] * val, hi - lo) for (lo, hi), (doc, at, val) in blocks()])
        upper = sig(s[:, None] - np.concatenate(([-40.0], b))[None, :])  # P(grade >= k)
        tail = np.concatenate([upper, np.zeros((n, 1))], 1)
        here, up, lo = tail[np.arange(n), grade], tail[np.arange(n), grade + 1], None
        p = np.maximum(here - up, 1e-9)
        d_here, d_up = here * (1 - here), up * (1 - up)
        g_s = -weight * (d_here - d_up) / p
        g = np.zeros_like(x)
        for (lo, hi), (doc, at, val) in blocks():
            g[: len(used)] += np.bincount(at, g_s[lo:hi][doc] * val, len(used))
        g[: len(used)] = g[: len(used)] / n + decay * w
        for k in range(1, grades):
            g[len(used) + k - 1] = (np.sum((weight * d_here / p)[grade == k]) - np.sum((weight * d_up / p)[grade + 1 == k])) / n
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        x[len(used) :] = np.maximum.accumulate(x[len(used) :])
    full = np.zeros(DIMS)
    full[used] = x[: len(used)]
    return Model(full.astype(np.float32), x[len(used) :])


def rated_sample(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED) -> DataFrame:
    """doc_id, text and grade of the rated documents whose ids hash lowest, at most ``max_rated`` of them."""
    rated = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.coalesce("quality", F.lit(1)) > 0, 2).otherwise(1)
    rated = rated.groupBy("doc_id").agg(F.min(grade).cast("int").alias("__grade"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rated)
    found = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")  # max_rated rows of two numbers
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("__grade").alias("grade"))


# ``train`` cuts no text; the next two functions are for those who want texts of bounded length.
def common_length(sizes: list[int], most: int) -> int | None:
    """The greatest length to which texts of these sizes can be cut so that ``most`` bytes remain in all; None: no cut."""
    if sum(sizes) <= most:
        return None
    left = most
    for i, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - i)
        if size > share:
            return share
        left -= size
    return None


def _beginning(text: str | None, length: int) -> str | None:
    """The words of a text that lie in its first bytes as a whole."""
    raw = text.encode() if text else b""
    if len(raw) <= length:
        return text
    end = next((i for i in range(length, 0, -1) if raw[i] in b" \t\n\x0b\x0c\r"), length)
    return raw[:end].decode(errors="ignore")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (doc_id, text, grade): for each column the documents that have it and the sum of their grades. Numbers from
    DIMS on count the documents of each grade."""
    times, sums = np.zeros(DIMS + GRADES, np.int64), np.zeros(DIMS + GRADES, np.int64)
    for b in batches:
        grade = b.column(2).to_numpy(zero_copy_only=False)
        times[DIMS:] += np.bincount(grade, minlength=GRADES)
        for lo, hi, w in word_chunks(b.column(1)):
            edges, col, _ = features(w)
            times[:DIMS] += np.bincount(col, minlength=DIMS)
            sums[:DIMS] += np.bincount(col, np.repeat(grade[lo:hi], np.diff(edges)), DIMS).astype(np.int64)
    used = np.flatnonzero(times)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(times[used]), pa.array(sums[used])], names=["col", "times", "sums"])


def _rows(sample: DataFrame, chosen: np.ndarray) -> DataFrame:
    """doc_id, grade and the chosen columns of each document, in the order of the ids' hashes."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in word_chunks(b.column(1)):
                edges, col, value = features(w)
                keep = chosen[col]
                edges, col, value = np.concatenate(([0], np.cumsum(keep)))[edges], col[keep], value[keep]
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(edges[:-1], edges[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(2)[lo:hi], cut(col.astype(np.int32)), cut(value.astype(np.float32))], names=["doc_id", "grade", "col", "value"])

    return map_arrow(sample, extract, "doc_id long, grade int, col binary, value binary").orderBy(F.xxhash64("doc_id"), "doc_id")


def train(docs: DataFrame, labels: DataFrame, max_rated: int = MAX_RATED, max_bytes: int = MAX_BYTES) -> Model:
    """Fits the model on the driver, on the whole texts of the sample.

    Beyond ``max_bytes`` the documents' chosen columns are not held in memory but in a file, which the fit reads as an array.
    """
    sample = rated_sample(docs, labels, max_rated)
    counts = map_arrow(sample, _counts, "col int, times long, sums long").groupBy("col").agg(F.sum("times").alias("times"), F.sum("sums").alias("sums")).toArrow()
    times, sums = np.zeros(DIMS + GRADES, np.int64), np.zeros(DIMS + GRADES, np.int64)
    at = counts["col"].to_numpy()
    times[at], sums[at] = counts["times"].to_numpy(), counts["sums"].to_numpy()
    if not times[DIMS:].any():
        return Model(np.zeros(DIMS, np.float32), np.full(GRADES - 1, -40.0))  # nothing is rated: everything is kept
    chosen = telling_columns(times[:DIMS], sums[:DIMS], times[DIMS:])
    n, grade, edges = int(times[DIMS:].sum()), [], [0]
    size = int(times[:DIMS][chosen].sum())
    with tempfile.TemporaryFile() as where:
        made = (lambda dtype, offset: np.memmap(where, dtype, "r+", offset, (size,))) if 8 * size > max_bytes else (lambda dtype, offset: np.empty(size, dtype))
        where.truncate(8 * size)
        col, value = made(np.int32, 0), made(np.float32, 4 * size)
        for r in _rows(sample, chosen).toLocalIterator():
            to = edges[-1] + len(r.col) // 4
            col[edges[-1] : to], value[edges[-1] : to] = np.frombuffer(r.col, np.int32), np.frombuffer(r.value, np.float32)
            grade.append(r.grade)
            edges.append(to)
        if (len(grade), edges[-1]) != (n, size):
            raise RuntimeError("the documents changed while they were read")
        model = fit(np.array(edges), col, value, np.array(grade), chosen=chosen)
    del col, value
    trim_memory()
    return model


def tails_of(model: Model, text: pa.Array) -> np.ndarray:
    """P(grade >= k) of a column of texts. A text without words has no evidence against it and gets probability 1."""
    out = np.ones((len(text), len(model.thresholds)))
    for lo, hi, w in word_chunks(text):
        p = model.tails(*features(w))
        p[w.counts == 0] = 1.0
        out[lo:hi] = p
    return out


def score(docs: DataFrame, model: Model, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """doc_id, expected_grade, p_acceptable (grade 1 or more), p_good (grade 2), kept.

    Null texts count as empty; empty texts are kept; repeated rows are scored alike; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            p = tails_of(model, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.round(x, 6)) for x in (p.sum(1), p[:, 0], p[:, -1])), pa.array(p[:, keep_grade - 1] >= keep_probability)], names=["doc_id", "expected_grade", "p_acceptable", "p_good", "kept"])

    return map_arrow(docs.select("doc_id", F.col("text").cast("string")), run, "doc_id long, expected_grade double, p_acceptable double, p_good double, kept boolean")


def keep_good(docs: DataFrame, model: Model, keep_grade: int = KEEP_GRADE, keep_probability: float = KEEP_PROBABILITY) -> DataFrame:
    """The rows of ``docs``, with all columns, that the model doesn't reject."""
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            text = b.column(at)
            yield b.filter(pa.array(tails_of(model, text)[:, keep_grade - 1] >= keep_probability))

    return map_arrow(docs, run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
