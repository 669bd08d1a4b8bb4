"""Vectorised words and rolling fingerprints over Arrow string columns, in numpy.

Words are found in the UTF-8 bytes of a whole column at once. A word's fingerprint is a polynomial over a
random byte table modulo 2**64, taken from prefix sums, so its cost doesn't depend on the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of letters and digits: those of ASCII, and all of multi-byte characters.
LETTER_OR_DIGIT = np.zeros(256, bool)
LETTER_OR_DIGIT[48:58] = LETTER_OR_DIGIT[65:91] = LETTER_OR_DIGIT[97:123] = LETTER_OR_DIGIT[128:] = True
CHUNK_BYTES = 1 << 19
CHUNK_DOCS = 1024


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with good avalanche (the splitmix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


# Odd multipliers without pattern, for bytes and for words.
BYTE_BASE, WORD_BASE = 0x9E6C63D0876A9A55, 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least; kept for the next call."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, _U(b), _U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = (both[0], both[1])
        if size <= 2 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


class Lane:
    """One family of fingerprints: a random table of bytes."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.bytes = rng.integers(0, 1 << 64, 256, dtype=np.uint64) | _U(1)

    def words(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = powers(BYTE_BASE, len(buf) + 1)
        c = np.zeros(len(buf) + 1, _U)
        np.cumsum(self.bytes[buf] * up[: len(buf)], out=c[1:])
        return mix((c[end] - c[start]) * down[start] + (end - start).astype(_U))

    def windows(self, word_hash: np.ndarray, k: int) -> np.ndarray:
        """Fingerprints of every k consecutive words (also across documents; the caller knows where those end)."""
        n = len(word_hash) - k + 1
        if n <= 0:
            return np.zeros(0, _U)
        up, down = powers(WORD_BASE, len(word_hash) + 1)
        c = np.zeros(len(word_hash) + 1, _U)
        np.cumsum(word_hash * up[: len(word_hash)], out=c[1:])
        return mix((c[k:] - c[:-k]) * down[:n])


class Words:
    """The words of some documents: byte ranges [start, end) in buf; doc d owns words first[d] to first[d + 1]."""

    def __init__(self, buf: np.ndarray, edges: np.ndarray, lower: bool = False):
        self.buf, self.edges = (LOWER[buf] if lower else buf), edges
        solid = ~SPACE[buf]
        n = len(buf)
        cut = np.zeros(n + 1, bool)  # a document starts at, or all ends before, this byte
        cut[edges] = True
        first = solid.copy()
        first[1:] &= ~solid[:-1] | cut[1:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:] | cut[1:-1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, edges)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def string_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document edges of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_string_view(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pa.compute.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    edges = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[edges[0] : edges[-1]], edges - edges[0]


def chunks(edges: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes and at most CHUNK_DOCS documents; a longer document stands alone."""
    at, n = 0, len(edges) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + most, "right")) - 1)
        to = min(to, n, at + CHUNK_DOCS)
        yield at, to
        at = to


def word_chunks(col: pa.Array, lower: bool = False, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    buf, edges = string_column(col)
    for a, b in chunks(edges, most):
        yield a, b, Words(buf[edges[a] : edges[b]], edges[a : b + 1] - edges[a], lower)
