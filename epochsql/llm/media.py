"""Media columns: payloads kept as progressive JPEGs, decoded to coefficient arrays and full-resolution RGB tensors."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import map_arrow, table

UNIT = 64
BATCH_BYTES = 8 << 20


def _batches(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of about BATCH_BYTES from (bytes, row)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if size >= BATCH_BYTES or len(held) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def encode_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and ``media``: the JPEG that holds each text's UTF-8 bytes, filled up with zeros to full blocks.

    A null or empty text gives one block of zeros; ids may be null or repeated; other columns are ignored.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches):
        def rows():
            for b in batches:
                for i, t in zip(b.column(0), b.column(1), strict=True):
                    raw = (t.as_py() or "").encode()
                    media = jpeg.encode_payload(raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT)))
                    yield len(media), (i.as_py(), len(raw), media)

        return _batches(rows(), schema)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_bytes long, media binary")


def decode_rgb(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, height, width and ``rgb`` (height x width x 3 bytes) of any progressive JPEGs in column ``media``; null stays null."""
    schema = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(batches):
        def rows():
            for b in batches:
                for i, m in zip(b.column(0), b.column(1), strict=True):
                    if not m.is_valid:
                        yield 8, (i.as_py(), None, None, None)
                        continue
                    x = jpeg.rgb(jpeg.parse(m.as_py()))
                    yield x.size, (i.as_py(), x.shape[0], x.shape[1], x.tobytes())

        return _batches(rows(), schema)

    return map_arrow(media.select(F.col(id_col).cast("long"), "media"), run, "doc_id long, height int, width int, rgb binary")


def digest(media: DataFrame) -> DataFrame:
    """What op4 returns, from the stored JPEGs alone (and the unpadded length beside them)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def run(batches):
        def rows():
            for b in batches:
                for i, n, m in zip(*b.columns, strict=True):
                    data = m.as_py()
                    image = jpeg.parse(data)
                    payload = jpeg.decode_payload(image)
                    x = jpeg.rgb(image)
                    r, g, bl = x.sum(axis=(0, 1), dtype="int64").tolist()
                    feature = f"{x.shape[0]}x{x.shape[1]} rgb {r},{g},{bl} crc {zlib.crc32(x):08x}"
                    yield 300, (i.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature)

        return _batches(rows(), schema)

    return map_arrow(media.select("doc_id", "n_bytes", "media"), run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a progressive JPEG, read back, with its payload's checksums and a feature of its RGB tensor."""
    return digest(encode_texts(table(spark, sf_dir, "documents")))
