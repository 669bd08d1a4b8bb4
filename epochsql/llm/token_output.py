"""Training-order materialisation of token ids.

Texts become token ids, cut into sequences of one length (a document's last one is filled up). A keyed Feistel network
permutes the sequence numbers 0 to N - 1, walking the cycle until a number falls below N, so every sequence has one
global slot and every slot one sequence. Slot s lies in shard s div shard_size, at byte (s mod shard_size) * stride:
reading shards from end to end is the training order, and a run resumes at any slot by arithmetic alone.

Sequences are numbered by the place of their document: its file and its row in the file where the documents are files,
however those are split into tasks, so a rerun on another cluster agrees. Documents that come from another plan are numbered
by task; the numbers are kept in the written token table, so lost executors don't renumber them.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import Scratch, map_arrow, table
from .textkit import mix

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
LENGTH = 512
SHARD_SIZE = 16384
KEY = 5
ROUNDS = 6
# The white space of Unicode, which the pattern's \s stands for.
_LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
#: In a shard, before a record's tokens: slot, doc_id, number in the document, number of tokens, whether doc_id is null, checksum.
HEADER = "<qqiiiI"


@lru_cache(2)
def encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("from-file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def permute(x: np.ndarray, n: int, key: int = KEY, back: bool = False) -> np.ndarray:
    """The keyed permutation of 0 to n - 1, for an array of numbers."""
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    mask = np.uint64((1 << int(half)) - 1)
    keys = [mix(np.array([key * 1000003 + r], np.uint64))[0] for r in range(ROUNDS)]
    out = np.asarray(x, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        a, b = out[todo] >> half, out[todo] & mask
        for k in reversed(keys) if back else keys:
            a, b = (b ^ mix(a + k) & mask, a) if back else (b, a ^ mix(b + k) & mask)
        out[todo] = a << half | b
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def encode(enc, text: str) -> list[int]:
    """The ids of a text. Long runs of white space, on which the pattern's engine would overflow its stack, are cut out
    first, as the pattern cuts them: at the end of the text a run is one piece, elsewhere all of it but its last character."""
    out, done = [], 0
    for m in _LONG_BLANK.finditer(text):
        cut = m.end() if m.end() == len(text) else m.end() - 1
        out += enc.encode_ordinary(text[done : m.start()])
        out += enc._core_bpe.encode_single_piece(text[m.start() : cut].encode())
        done = cut
    return out + enc.encode_ordinary(text[done:])


def token_type(vocabulary: str, end: int) -> str:
    """16 bits where all ids fit, else 32."""
    with open(vocabulary, "rb") as f:
        most = max([end, *(int(line.split()[1]) for line in f if line.strip())])
    return "<u2" if most < 1 << 16 else "<u4"


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the file and row that each document is; a null file where documents aren't rows of files."""
    doc = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    try:
        return docs.select(*doc, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return docs.select(*doc, F.lit(None).cast("string").alias("file"), F.lit(None).cast("long").alias("row"))


def tokenise(docs: DataFrame, length: int = LENGTH, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END) -> DataFrame:
    """doc_id, tokens (little-endian ids, with the end token), n_seq, and where they stand: the stretch of consecutive rows
    of one file that the task read (its file and first row, or the task's number) and how many sequences came before in it.

    A null or empty text is the end token alone; a very long one is encoded whole, white space of any length as well.
    ``vocabulary`` is a path that all executors can read.
    """
    kind = token_type(vocabulary, end)

    def run(batches):
        enc, task = encoder(vocabulary, pattern), TaskContext.get().partitionId()
        stretch, last, n = None, None, 0
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                made = []
                for text, file, row in zip(*(part.column(j).to_pylist() for j in (1, 2, 3)), strict=True):
                    if stretch is None or file is not None and (file != stretch[0] or row != last + 1):
                        stretch, n = (file or "", task if file is None else row), 0
                    last = row
                    ids = np.array([*encode(enc, text or ""), end], kind)
                    made.append((ids.tobytes(), -(-len(ids) // length), *stretch, n))
                    n += made[-1][1]
                columns = [pa.array(c, t) for c, t in zip(zip(*made, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "tokens", "n_seq", "file", "start", "after"])

    return map_arrow(placed(docs), run, "doc_id long, tokens binary, n_seq long, file string, start long, after long")


def materialise(spark: SparkSession, docs: DataFrame, length: int = LENGTH, shard_size: int = SHARD_SIZE, key: int = KEY, vocabulary: str = VOCABULARY, pattern: str = PATTERN, end: int = END) -> DataFrame:
    """A row per sequence in training order: slot, shard, byte_offset, doc_id, seq_no, n_tokens, crc32 and ``tokens``
    (``length`` ids, filled up with the end token). One partition holds the slots of one shard, in order.

    Null ids stay null; repeated rows are documents of their own; null and empty texts have one sequence; an empty table
    gives no rows; other columns are ignored.
    """
    kind = token_type(vocabulary, end)
    made = Scratch(spark, "tokens").write(tokenise(docs, length, vocabulary, pattern, end), "ids", compression="zstd")
    total, first = 0, {}
    for r in made.groupBy("file", "start").agg(F.sum("n_seq")).orderBy("file", "start").collect():  # a row or so per task above
        first[r[0], r[1]] = total
        total += r[2]
    stride = length * np.dtype(kind).itemsize
    names = ["slot", "doc_id", "seq_no", "n_tokens", "crc32", "tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                counts = part.column(2).to_numpy()
                rows = np.repeat(np.arange(part.num_rows), counts)
                seq = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                base = np.array([first[t] for t in zip(part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)]) + part.column(5).to_numpy()
                ids = [np.frombuffer(x.as_buffer(), kind) for x in part.column(1)]
                filled = np.full((len(rows), length), end, kind)
                at = 0
                for x, c in zip(ids, counts, strict=True):
                    filled[at : at + c].reshape(-1)[: len(x)] = x
                    at += c
                left = np.array([len(x) for x in ids])[rows] - seq * length
                blob = filled.tobytes()
                tokens = [blob[k : k + stride] for k in range(0, len(blob), stride)]
                columns = [pa.array(permute(base[rows] + seq, total, key)), part.column(0).take(pa.array(rows)), pa.array(seq, pa.int32()), pa.array(np.minimum(left, length), pa.int32()), pa.array([zlib.crc32(t) for t in tokens], pa.int64()), pa.array(tokens, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = map_arrow(made.select("doc_id", "tokens", "n_seq", "file", "start", "after"), place, "slot long, doc_id long, seq_no int, n_tokens int, crc32 long, tokens binary")
    out = out.withColumn("shard", F.expr(f"cast(slot div {shard_size} as int)")).withColumn("byte_offset", F.expr(f"(slot % {shard_size}) * {stride}"))
    shards = max(1, -(-total // shard_size))
    out = out.repartitionById(shards, "shard").sortWithinPartitions("slot")
    return out.select("slot", "shard", "byte_offset", "doc_id", "seq_no", "n_tokens", "crc32", "tokens")


def write_shards(sequences: DataFrame, folder: str) -> None:
    """Writes each shard of ``materialise`` as one file of fixed-stride records, on any file system that Spark writes to.

    A record is a HEADER, the tokens and a line break. Spark's own committer puts the files into place, so a file appears
    whole or not at all, whatever executors are lost.
    """
    length = sequences.select(F.max(F.length("tokens"))).first()[0] or 0

    def run(batches):
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)
            records = [struct.pack(HEADER, slot, doc or 0, seq, n, doc is None, crc) + tokens for slot, doc, seq, n, crc, tokens in rows]
            yield pa.RecordBatch.from_arrays([pa.array(records, pa.binary())], names=["record"])

    records = map_arrow(sequences.select("slot", "doc_id", "seq_no", "n_tokens", "crc32", "tokens"), run, "record binary")
    # a cast of bytes to a string keeps them as they are, and the text writer writes them so
    records.select(F.col("record").cast("string")).write.option("lineSep", "\n").option("compression", "none").text(folder)
    sequences.sparkSession.createDataFrame([(struct.calcsize(HEADER) + length + 1,)], "stride int").coalesce(1).write.json(f"{folder}/_stride")


class Shards:
    """The shards in a folder, for sequential reads from any slot on."""

    def __init__(self, spark: SparkSession, folder: str, shard_size: int = SHARD_SIZE):
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(folder)
        self.jvm, self.fs, self.size = jvm, where.getFileSystem(spark._jsc.hadoopConfiguration()), shard_size
        self.stride = spark.read.json(f"{folder}/_stride").first()[0]
        files = [s.getPath() for s in self.fs.listStatus(where) if s.getPath().getName().startswith("part-") and s.getLen()]
        self.files = {self._record(p, 0)[0] // shard_size: p for p in files}

    def _record(self, path, at: int) -> tuple:
        stream = self.fs.open(path)
        try:
            stream.seek(at * self.stride)
            raw = bytes(self.jvm.org.apache.commons.io.IOUtils.readFully(stream, self.stride))
        finally:
            stream.close()
        slot, doc, seq, n, null, crc = struct.unpack_from(HEADER, raw)
        tokens = raw[struct.calcsize(HEADER) : -1]
        if zlib.crc32(tokens) != crc:
            raise ValueError(f"slot {slot} is damaged")
        return slot, None if null else doc, seq, n, tokens

    def read(self, start: int, count: int) -> Iterator[tuple]:
        """slot, doc_id, seq_no, n_tokens and tokens of slots start, start + 1, ...; ends behind the last one."""
        for slot in range(start, start + count):
            path = self.files.get(slot // self.size)
            if path is None or (slot % self.size + 1) * self.stride > self.fs.getFileStatus(path).getLen():
                return
            yield self._record(path, slot % self.size)


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``materialise`` of documents; what it says of nulls, repeats and empty tables holds here."""
    return materialise(spark, table(spark, sf_dir, "documents"))
