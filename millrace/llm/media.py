"""Media columns: payloads as 8-bit images in archives, read by a Spark data source.

Payloads are stored as PNG images of 8-bit grey samples, 64 to a row, which are
members of ZIP archives.  The data source ``millrace_media`` plans byte ranges
over the archives by their total size, reads the members that begin in a range
together, streams them as Arrow batches and retries each member on its own at
its offset.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from millrace.llm._shared import bounded_batches, shared_dir, utf8
from millrace.llm.zipfiles import Archives, RangeFile, members_in, plan_ranges

WIDTH = 64
#: Bytes in an archive, in a range that a task reads, and in an Arrow batch.
ARCHIVE, RANGE, BATCH = 64 << 20, 16 << 20, 8 << 20
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
_PART = 1 << 30
_NO_ID = "~"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def padded(data: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of the row width."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def encode_png(data: bytes) -> bytes:
    """A grey 8-bit image of the padded bytes; its text field ``bytes`` has their number before padding."""
    samples = np.frombuffer(padded(data), np.uint8).reshape(-1, WIDTH)
    rows = np.zeros((len(samples), WIDTH + 1), np.uint8)  # each row begins with filter 0
    rows[:, 1:] = samples
    packed = zlib.compress(rows.data, 1)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(samples), 8, 0, 0, 0, 0)) + _chunk(b"tEXt", b"bytes\0" + str(len(data)).encode())
    body = b"".join(_chunk(b"IDAT", packed[i : i + _PART]) for i in range(0, len(packed), _PART))
    return _SIGNATURE + head + body + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> tuple[bytes, int]:
    """Samples and number of bytes before padding of an image that ``encode_png`` made."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, packed, n, size = 8, [], 0, (0, 0)
    while at < len(data):
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError("broken PNG chunk")
        if kind == b"IHDR":
            size = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        at += 12 + length
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("PNG rows have filters")
    return rows[:, 1:].tobytes(), n


def feature(samples: bytes) -> str:
    """Size, mean, deviation and the 64-bit hash of which columns are brighter than the mean."""
    a = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
    columns = a.sum(axis=0, dtype=np.int64)
    n, total, squares = a.size, int(columns.sum()), int(np.dot(np.bincount(a.ravel(), minlength=256), np.arange(256, dtype=np.int64) ** 2))
    bright = int.from_bytes(np.packbits(columns * WIDTH > total).tobytes(), "big")
    return f"{WIDTH}x{len(a)};mean={total / n:.6f};std={math.sqrt(n * squares - total * total) / n:.6f};bright={bright:016x}"


class MediaSource(DataSource):
    """Options: ``path``, the manifest of archives; ``range_bytes``, the most bytes of a range, as far as ``MOST_PARTITIONS`` allows."""

    @classmethod
    def name(cls) -> str:
        return "millrace_media"

    def schema(self) -> str:
        return "member string, offset bigint, media binary"

    def reader(self, schema) -> MediaReader:  # noqa: ARG002
        return MediaReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))


class MediaReader(DataSourceReader):
    def __init__(self, manifest: str, range_bytes: int):
        self.manifest, self.range_bytes = manifest, range_bytes

    def partitions(self) -> list:
        return plan_ranges(self.manifest, self.range_bytes)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("member", pa.string()), ("offset", pa.int64()), ("media", pa.binary())])
        if not hasattr(partition, "ranges"):
            return  # no archives
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for part in partition.ranges:
            with RangeFile(part.uri) as file:
                for m, data in members_in(file, part):
                    rows.append((m.name, m.offset, data))
                    size += m.size
                    if size >= BATCH:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = ARCHIVE) -> str:
    """Store each row's text as an image in archives in the shared folder; the path of their manifest."""
    spark = docs.sparkSession
    folder = shared_dir(spark)
    rows = bounded_batches(docs).select(F.col(id_col).cast("string").alias("id"), utf8(F.col(text_col)).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives, number = Archives(f"{folder}/archives", "zip", archive_bytes), 0
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                label = _NO_ID if name is None else "=" + quote(name, safe="")
                archives.current().add(f"{number}/{label}", encode_png(body.as_py()))
                archives.close(only_full=True)
                number += 1
        archives.close()
        columns = list(zip(*archives.closed, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["uri", "bytes", "members"])

    rows.mapInArrow(run, "uri string, bytes bigint, members bigint").write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def read_media(spark, manifest: str, id_type: str = "bigint", id_col: str = "doc_id", keep_payload: bool = False) -> DataFrame:
    """One row per stored row: ``id_col``, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature and, if wanted, payload."""
    spark.dataSource.register(MediaSource)
    members = spark.read.format(MediaSource.name()).load(manifest)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_payload)
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["payload"] * keep_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for member, media in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
                stored = media.as_py()
                samples, n = decode_png(stored)
                label = member.split("/", 1)[1]
                rows.append((
                    None if label == _NO_ID else unquote(label[1:]), n, len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]),
                    len(stored), hashlib.sha256(stored).hexdigest(), feature(samples), *[samples] * keep_payload,
                ))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds, strict=True)], names)

    schema = "id string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string" + ", payload binary" * keep_payload
    out = members.mapInArrow(run, schema)
    return out.select(F.col("id").cast(id_type).alias(id_col), *names[1:])


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_payload: bool = False) -> DataFrame:
    """Store every text as media and describe what is read back, one row per row of ``docs``.

    Null texts count as empty; an empty text has one row of zeros.  Repeated
    rows and null ids are stored each.  A very long text is one member, held
    whole by the task that stores or reads it.  An empty table gives an empty
    result; other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return read_media(docs.sparkSession, write_media(docs, id_col, text_col), kind, id_col, keep_payload)
