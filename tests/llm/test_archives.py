import hashlib
import io
import math
import struct
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest

from millrace.llm import media, warc, zipfiles
from millrace.llm.queries import QUERIES


class Memory:
    def __init__(self, data):
        self.data, self.size, self.reads, self.opened = data, len(data), [], 0

    def read(self, offset, length):
        self.reads.append((offset, length))
        return self.data[offset : offset + length]

    def reopen(self):
        self.opened += 1


def archive(members, always64=False):
    out = io.BytesIO()
    writer = zipfiles.ZipWriter(out, always64)
    for name, data in members:
        writer.add(name, data)
    writer.close()
    return out.getvalue()


MEMBERS = [("a.txt", b"hello"), ("dir/é", b""), ("b", bytes(range(256)) * 40)]


@pytest.mark.parametrize("always64", [False, True])
def test_archives_are_read_by_the_standard_library_and_back(always64):
    data = archive(MEMBERS, always64)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == MEMBERS
    file = Memory(data)
    assert [(m.name, zipfiles.read_member(file, m)) for m in zipfiles.directory(file)] == MEMBERS


def test_foreign_archives_comments_and_compression():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("s", b"stored" * 9)
        z.writestr("d", b"deflated" * 9, zipfile.ZIP_DEFLATED)
        z.comment = b"PK\x05\x06 is no end of a directory here"
    file = Memory(out.getvalue())
    found = {m.name: m for m in zipfiles.directory(file)}
    assert zipfiles.read_member(file, found["s"]) == b"stored" * 9
    with pytest.raises(ValueError, match="compressed"):
        zipfiles.read_member(file, found["d"])


def test_many_members_need_zip64():
    members = [(str(i), b"") for i in range(70_000)]
    assert [m.name for m in zipfiles.directory(Memory(archive(members)))] == [n for n, _ in members]


def test_no_archive():
    for data in (b"", b"nothing", archive(MEMBERS)[:-5]):
        with pytest.raises(ValueError):
            zipfiles.directory(Memory(data))


def test_a_member_is_retried_alone():
    class Flaky(Memory):
        left = 2

        def read(self, offset, length):
            data = super().read(offset, length)
            if length == 10240 and self.left:
                self.left -= 1
                return data[:-1] + b"?"
            return data

    file = Flaky(archive(MEMBERS))
    members = zipfiles.directory(file)
    before = len(file.reads)
    assert zipfiles.read_member(file, members[2]) == MEMBERS[2][1]
    assert file.opened == 2 and {o for o, _ in file.reads[before:]} == {members[2].offset, zipfiles.data_offset(file, members[2])}
    file.left = 99
    with pytest.raises(OSError, match="checksum"):
        zipfiles.read_member(file, members[2])


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 100_000])
def test_images_are_lossless(n):
    data = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8).tobytes()
    image = media.encode_png(data)
    samples, length = media.decode_png(image)
    assert length == n and samples == media.padded(data) and len(samples) % 64 == 0 and len(samples) >= max(64, n)
    assert struct.unpack(">II", image[16:24]) == (64, len(samples) // 64)


def test_broken_images():
    image = bytearray(media.encode_png(b"abc"))
    image[20] ^= 1
    for wrong in (b"GIF", bytes(image)):
        with pytest.raises(ValueError):
            media.decode_png(wrong)


def media_row(text):
    body = (text or "").encode()
    full = body + bytes(-len(body) % 64 or (64 if not body else 0))
    return len(body), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:])


def test_media_of_odd_rows(odd_docs, odd_rows):
    rows = media.media_columns(odd_docs, keep_payload=True).collect()
    expected = Counter((r[0], *media_row(r[1])) for r in odd_rows)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == expected
    for r in rows:
        a = np.frombuffer(r.payload, np.uint8)
        assert hashlib.sha256(r.payload).hexdigest() == r.payload_sha256
        assert r.feature.startswith(f"64x{len(a) // 64};mean={a.mean():.6f};")
        assert math.isclose(float(r.feature.split("std=")[1].split(";")[0]), a.std(), abs_tol=1e-5)
    same = {}
    for r in rows:
        assert same.setdefault(r.payload_sha256 + str(r.n_bytes), (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_small_archives_and_ranges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = media.write_media(docs, archive_bytes=50_000)
    spark.dataSource.register(media.MediaSource)
    whole = spark.read.format("millrace_media").load(manifest)
    cut = spark.read.format("millrace_media").option("range_bytes", 7000).load(manifest)
    assert cut.rdd.getNumPartitions() > whole.rdd.getNumPartitions() > 3
    assert sorted(tuple(r)[:2] for r in cut.collect()) == sorted(tuple(r)[:2] for r in whole.collect())
    assert whole.count() == docs.count()


def test_media_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = QUERIES["op4_media"](spark, sf_dir).collect()
    assert {(r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == {(r.doc_id, *media_row(r.text)) for r in docs}


PAGES = "page_id bigint, url string, html string"


def test_references_of_odd_pages(spark):
    long = "ü" * 500  # 1000 bytes
    pages = [(1, "http://a/ b\r\nX: y", long), (5, None, long), (3, "u", long), (7, "u", "x" * 999), (8, "u", "x" * 999), (9, "u", None), (10, "u", ""), (None, "u", long), (None, "u", "y" * 2000), (None, "u", "y" * 2000), (5, None, long), (11, "http://ü/%20?a=b&c", "z" * 100_000)]
    df = spark.createDataFrame(pages, PAGES)
    rows = warc.round_trip(df).collect()
    tops = {long: 5, "y" * 2000: None}
    expected = Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        revisit = html == long and i != tops[html]
        expected[i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected
    assert all((r.payload is None) == (r.record_type == "revisit") for r in rows)
    assert any(r.payload == b"z" * 100_000 and r.url == "http://%C3%BC/%20?a=b&c" for r in rows)


def test_records_round_trip():
    made = warc.parse(warc.record("7", "http://a/", b"body\r\n\r\nmore", None))
    assert made["payload"] == b"body\r\n\r\nmore" and made["type"] == "response"
    again = warc.parse(warc.record("7", None, b"body", "9"))
    assert again["payload"] is None and again["length"] == 4 and again["digest"] == hashlib.sha1(b"body").hexdigest()
    with pytest.raises(ValueError):
        warc.parse(warc.record("7", None, b"body", None).replace(b"body", b"b0dy"))


def test_small_warc_archives(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_warcs(pages, archive_bytes=20_000)
    spark.dataSource.register(warc.WarcSource)
    for size in (1 << 30, 5000):
        rows = spark.read.format("millrace_warc").option("range_bytes", size).load(manifest).collect()
        assert sorted(int(r.id) for r in rows) == sorted(r.page_id for r in pages.select("page_id").collect())


def test_empty_tables(spark, no_docs):
    assert media.media_columns(no_docs).count() == 0
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_neighbours_are_read_together_and_repaired_alone():
    members = [(str(i), bytes([i]) * 1000) for i in range(50)]

    class Flaky(Memory):
        def read(self, offset, length):
            data = bytearray(super().read(offset, length))
            if length > 20_000:  # the long read has one wrong byte, in member 7
                data[file_places[7] - offset] ^= 1
            return bytes(data)

    data = archive(members)
    plain = Memory(data)
    file_places = [zipfiles.data_offset(plain, m) for m in zipfiles.directory(plain)]
    file = Flaky(data)
    part = zipfiles.ByteRange("x", 0, len(data))
    assert [(m.name, d) for m, d in zipfiles.members_in(file, part)] == members
    # Tail, directory, all members at once, then header and data of the one that was broken.
    assert len(file.reads) <= 5 and sum(n == 1000 for _, n in file.reads) == 1
    half = zipfiles.ByteRange("x", 0, file_places[25])
    assert [m.name for m, _ in zipfiles.members_in(Memory(data), half)] == [str(i) for i in range(26)]


def test_spans_have_bounded_length():
    places = [(i * 10, 10) for i in range(20)] + [(200, 500), (700, 10)]
    runs = list(zipfiles.spans(places, 45))
    assert [x for i, j in runs for x in range(i, j)] == list(range(22))
    assert all(j - i == 1 or places[j - 1][0] + places[j - 1][1] - places[i][0] <= 45 for i, j in runs)
    assert list(zipfiles.spans([])) == []


def test_partitions_stay_few(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = media.write_media(docs, archive_bytes=20_000)
    every = [r for p in zipfiles.plan_ranges(manifest, 3000) for r in p.ranges]
    few = zipfiles.plan_ranges(manifest, 3000, 4)
    assert len(few) <= 8 < len(every)
    ends = {}
    for part in few:
        for r in part.ranges:
            assert ends.get(r.uri, 0) == r.begin
            ends[r.uri] = r.end
    assert ends == {u: max(r.end for r in every if r.uri == u) for u in ends} and len(ends) == len({r.uri for r in every})


def test_one_payload_in_half_of_the_pages(spark):
    hot = "h" * 1500
    pages = [(i, f"u{i}", hot if i % 2 else f"{i}" * 800, "own", "own", "own") for i in range(2000)] + [(i, "u", "short", "o", "o", "o") for i in range(2000, 2400)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string, id string, body string, digest string").repartition(4)
    for name in ("refers_to", "payload", "mark", "word", "length", "sha1", "top"):
        from pyspark.sql import functions as F

        df = df.withColumn(name, F.lit("own"))
    rows = warc.round_trip(df).collect()
    assert len(rows) == 2400 and sorted(r.page_id for r in rows) == list(range(2400))
    for r in rows:
        html = pages[r.page_id][2]
        revisit = html == hot and r.page_id != 1999
        assert (r.record_type, r.refers_to) == (("revisit", 1999) if revisit else ("response", None))
        assert r.payload_bytes == len(html) and r.payload_digest == hashlib.sha1(html.encode()).hexdigest()


def test_only_repeated_payloads_are_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"{i:04d}" * 400) for i in range(500)], PAGES)
    df.write.parquet(str(tmp_path / "p"))
    rows = warc.record_rows(spark.read.parquet(str(tmp_path / "p")), "page_id", "html", 1000)
    assert rows.count() == 500 and rows.where("refers_to is not null").count() == 0
    kept = warc.record_rows(df.union(df.where("page_id = 7").withColumn("page_id", F_lit(900))), "page_id", "html", 1000).collect()
    assert [(r.id, r.refers_to, r.body) for r in kept if r.refers_to is not None] == [(7, 900, None)] and len(kept) == 501


def F_lit(x):
    from pyspark.sql import functions as F

    return F.lit(x).cast("bigint")
