"""WARC records in ZIP-packaged archives, and their reader.

An archive is a ZIP file with stored members: ``archive/data.warc.gz``, in which
every record is a gzip member of its own, and ``indexes/index.cdxj``, which has a
line with offset and length for each record.  The data source ``millrace_warc``
parses the central directory, finds both members and range-reads the records
where they lie, without extracting anything.

Which records are revisits is found on ids and digests alone.  A revisit has no
payload, so it is written from these; a response is written where its page is
read, unless a filter of fixed size says that its payload may be repeated.  Only
such pages are shuffled with their payloads, by id and digest, so that a payload
that very many pages share is spread over the tasks.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from millrace.llm._shared import bounded_batches, materialize, shared_dir, utf8
from millrace.llm.zipfiles import Archives, ByteRange, RangeFile, data_offset, directory, plan_ranges, read_member, retried, spans

#: Payloads from so many bytes on are stored once.
REVISIT_BYTES = 1000
#: Bits of the filter of repeated payloads: 2^16 to 2^20 words of 64, a broadcast table of at most 16 MB.
LEAST_WORDS, MOST_WORDS = 16, 20
#: Bytes of records in an archive, in a range that a task reads, and in an Arrow batch.
ARCHIVE, RANGE, BATCH = 32 << 20, 8 << 20, 8 << 20
# Names inside an archive, and profile of revisits by payload.
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"
_DATE = "1970-01-01T00:00:00Z"


def record(page_id: str | None, url: str | None, payload: bytes | None, refers_to: str | None, length: int | None = None, digest: str | None = None) -> bytes:
    """A response with its payload, or a revisit, for which the payload's length and SHA-1 (hex) will do."""
    if payload is not None:
        length, digest = len(payload), hashlib.sha1(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{_PAGE}{quote(page_id or '', safe='')}>", f"WARC-Date: {_DATE}",
        f"WARC-Target-URI: {quote(url or 'about:blank', safe=':/?#[]@!$&()*+,;=%~')}", "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <{_PAGE}{quote(refers_to, safe='')}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Type, ids, payload (None for revisits), its length and its SHA-1 in hex."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, body = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":", 1)[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    return {"type": fields["WARC-Type"], "url": fields["WARC-Target-URI"], "payload": None if revisit else body, "length": length, "digest": digest}


def references(facts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """The payloads that several rows have (``digest``, ``mark``), and the revisits among the rows.

    ``facts`` has id, url, length, sha1, digest and mark, but no payloads.  Only
    payloads of ``least`` bytes or more count.  A revisit is a row whose id isn't
    ``top``, the largest id with its payload.
    """
    long = facts.where(F.col("length") >= least)
    tops = materialize(long.groupBy("digest").agg(F.max("id").alias("top"), F.count("*").alias("n"), F.first("mark").alias("mark")).where((F.col("n") > 1) & F.col("top").isNotNull()))
    # Payloads of very many rows, of which there can be at most a thousand or so, are joined without a shuffle.
    hot = max(100_000, (tops.agg(F.sum("n").alias("n")).first().n or 0) // 1000)
    rows = long.drop("mark")
    many = rows.join(F.broadcast(tops.where(F.col("n") > hot).select("digest", "top")), "digest")
    few = rows.join(tops.where(F.col("n") <= hot).select("digest", "top"), "digest")
    return tops.select("digest", "mark"), materialize(many.union(few).where(~F.col("top").eqNullSafe(F.col("id"))))


def record_rows(pages: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """A row for each record: id, url, body (null for revisits), refers_to, and for revisits length and sha1."""
    body, kind = utf8(F.col(text_col)), pages.schema[id_col].dataType
    url = F.col("url").cast("string") if "url" in pages.columns else F.lit(None).cast("string")
    own = [F.col(id_col).alias("id"), url.alias("url"), F.octet_length(body).alias("length"), F.xxhash64(body).alias("mark")]
    tops, revisits = references(materialize(pages.select(*own, F.sha1(body).alias("sha1"), F.sha2(body, 256).alias("digest"))), least)
    words = min(MOST_WORDS, max(LEAST_WORDS, (tops.count() // 8).bit_length()))
    word, bit = F.pmod(F.shiftright("mark", 6), F.lit(1 << words)), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("mark", F.lit(64)).cast("int"))
    sieve = tops.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    sifted = pages.select(*own, body.alias("body")).withColumn("word", word).join(F.broadcast(sieve), "word", "left")  # at most 2^MOST_WORDS rows
    maybe = (F.col("length") >= least) & (F.coalesce(F.col("bits"), F.lit(0).cast("bigint")).bitwiseAND(bit) != 0)
    # Those that may be repeated, without the revisits; null ids are compared as such.
    gone = revisits.select(F.col("id").alias("gone_id"), F.col("digest").alias("gone_digest")).distinct()
    again = (F.col("digest") == F.col("gone_digest")) & F.col("id").eqNullSafe(F.col("gone_id"))
    kept = sifted.where(maybe).withColumn("digest", F.sha2("body", 256)).join(gone, again, "left_anti")
    responses = sifted.where(~maybe).select("id", "url", "body").union(kept.select("id", "url", "body"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("refers_to", kind), ("length", "int"), ("sha1", "string"))]
    other = revisits.select("id", "url", F.lit(None).cast("binary").alias("body"), F.col("top").alias("refers_to"), "length", "sha1")
    return responses.select("*", *empty).union(other)


def write_warcs(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE) -> str:
    """Write a record for each row to archives in the shared folder; the path of their manifest."""
    folder = shared_dir(pages.sparkSession)
    rows = record_rows(bounded_batches(pages), id_col, text_col, least)
    rows = rows.select(F.col("id").cast("string"), "url", "body", F.col("refers_to").cast("string"), F.col("length").cast("bigint"), "sha1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archives = Archives(f"{folder}/archives", "wacz", 0)
        data, index = bytearray(), []

        def flush() -> None:
            nonlocal data, index
            if index:
                archives.current().add(DATA, bytes(data))
                archives.current().add(INDEX, "".join(index).encode())
                archives.close()
            data, index = bytearray(), []

        for batch in batches:
            small = [batch.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
            for page, url, other, length, sha1, body in zip(*small, batch.column(2), strict=True):
                packed = gzip.compress(record(page, url, body.as_py(), other, length, sha1), 6, mtime=0)
                index.append(f"{_PAGE} {json.dumps({'id': page, 'refers': other, 'offset': len(data), 'length': len(packed)})}\n")
                data += packed
                if len(data) >= archive_bytes:
                    flush()
        flush()
        columns = list(zip(*archives.closed, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["uri", "bytes"])

    rows.mapInArrow(run, "uri string, bytes bigint").write.parquet(f"{folder}/manifest")
    return f"{folder}/manifest"


def read_archive(file, part: ByteRange) -> Iterator[tuple[str | None, str | None, dict]]:
    """Id, id referred to and parsed record of every indexed record that begins in the range.

    Neighbours are cut out of one read; a record that does not come out right is
    read again on its own, at its offset.
    """
    members = {m.name: m for m in directory(file)}
    if DATA not in members or INDEX not in members:
        raise ValueError(f"the archive has no {DATA} or no {INDEX}")
    base = data_offset(file, members[DATA])
    if base >= part.end:
        return
    entries = [json.loads(line.split(" ", 1)[1]) for line in read_member(file, members[INDEX]).decode().splitlines()]
    inside = sorted((e for e in entries if part.begin <= base + e["offset"] < part.end), key=lambda e: e["offset"])
    places = [(base + e["offset"], e["length"]) for e in inside]
    for i, j in spans(places):
        first = places[i][0]
        try:
            whole = file.read(first, places[j - 1][0] + places[j - 1][1] - first)
        except (OSError, EOFError):
            whole = b""
        for entry, (at, length) in zip(inside[i:j], places[i:j], strict=True):

            def once(at: int = at, length: int = length) -> dict:
                try:
                    return parse(gzip.decompress(file.read(at, length)))
                except (zlib.error, ValueError) as e:
                    raise OSError(f"broken record at {at}") from e

            try:
                found = parse(gzip.decompress(whole[at - first : at - first + length]))
            except (zlib.error, ValueError, OSError, EOFError, KeyError):
                found = retried(file, once)
            yield entry["id"], entry["refers"], found


class WarcSource(DataSource):
    """Options: ``path``, the manifest of archives; ``range_bytes``, the most bytes of a range, as far as ``MOST_PARTITIONS`` allows."""

    @classmethod
    def name(cls) -> str:
        return "millrace_warc"

    def schema(self) -> str:
        return "id string, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to string"

    def reader(self, schema) -> WarcReader:  # noqa: ARG002
        return WarcReader(self.options["path"], int(self.options.get("range_bytes", RANGE)))


class WarcReader(DataSourceReader):
    def __init__(self, manifest: str, range_bytes: int):
        self.manifest, self.range_bytes = manifest, range_bytes

    def partitions(self) -> list:
        return plan_ranges(self.manifest, self.range_bytes)

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not hasattr(partition, "ranges"):
            return  # no archives
        names = ["id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.string()]
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for part in partition.ranges:
            with RangeFile(part.uri) as file:
                for page, refers, r in read_archive(file, part):
                    rows.append((page, r["url"], r["payload"], r["length"], r["digest"], r["type"], refers))
                    size += len(r["payload"] or b"")
                    if size >= BATCH or len(rows) == 10_000:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


def round_trip(pages: DataFrame, id_col: str = "page_id", text_col: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row and read all archives back.

    Gives ``id_col``, url, payload (null for revisits), payload_bytes,
    payload_digest (SHA-1 in hex), record_type and refers_to.  Of rows with
    equal payloads of ``least`` bytes or more, those with the largest id are
    responses and the others revisit it; null ids count as smallest, and rows
    that repeat the largest id are all responses.  Shorter payloads are all
    responses.  Null payloads count as empty.  A very long payload is one
    record, held whole by the task that writes or reads it.  An empty table
    gives an empty result; columns but id, payload and url are not read.
    """
    spark, kind = pages.sparkSession, pages.schema[id_col].dataType.simpleString()
    manifest = write_warcs(pages, id_col, text_col, least)
    spark.dataSource.register(WarcSource)
    out = spark.read.format(WarcSource.name()).load(manifest)
    return out.select(F.col("id").cast(kind).alias(id_col), "url", "payload", "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
