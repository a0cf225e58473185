"""ZIP archives of stored members in the shared folder: writing, directories, range reads.

Archives are written by tasks under names of their own.  A manifest, a table
that Spark commits, lists the archives of the attempts that counted, so what a
lost attempt left behind is never read.
"""

from __future__ import annotations

import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import InputPartition

from millrace.llm._shared import file_system

# Record signatures and sizes of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
LOCAL_SIZE, CENTRAL_SIZE, END_SIZE, END64_SIZE, LOCATOR_SIZE = 30, 46, 22, 56, 20
FULL16, FULL32, EXTRA64, UTF8_NAME, STORED = 0xFFFF, 0xFFFFFFFF, 0x0001, 0x0800, 0

#: Reads of a member are tried so often, with a new handle each time.
TRIES = 4
#: Members that follow each other are read together, up to so many bytes.
SPAN = 8 << 20
#: At most so many partitions are planned, whatever the archives' size.
MOST_PARTITIONS = 20_000


@dataclass(frozen=True)
class Member:
    """A directory entry; ``offset`` is that of the local header."""

    name: str
    offset: int
    size: int
    packed: int
    crc: int
    method: int


class ZipWriter:
    """Appends stored members to an output stream; ZIP64 fields where numbers need them, or always."""

    def __init__(self, out, always64: bool = False):
        self.out, self.at, self.members, self.always64 = out, 0, [], always64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, data: bytes) -> Member:
        member = Member(name, self.at, len(data), len(data), zlib.crc32(data), STORED)
        wide = self.always64 or member.size >= FULL32
        extra = struct.pack("<HHQQ", EXTRA64, 16, member.size, member.packed) if wide else b""
        shown = FULL32 if wide else member.size
        raw = name.encode()
        self._put(struct.pack("<IHHHHHIIIHH", LOCAL, 45 if wide else 20, UTF8_NAME, STORED, 0, 0x21, member.crc, shown, shown, len(raw), len(extra)) + raw + extra)
        self._put(data)
        self.members.append(member)
        return member

    def close(self) -> int:
        begin = self.at
        for m in self.members:
            wide = self.always64 or m.size >= FULL32 or m.offset >= FULL32
            extra = struct.pack("<HHQQQ", EXTRA64, 24, m.size, m.packed, m.offset) if wide else b""
            size, offset = (FULL32, FULL32) if wide else (m.size, m.offset)
            raw = m.name.encode()
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if wide else 20, UTF8_NAME, STORED, 0, 0x21, m.crc, size, size, len(raw), len(extra), 0, 0, 0, 0, offset) + raw + extra)
        n, length = len(self.members), self.at - begin
        if self.always64 or n >= FULL16 or begin >= FULL32 or length >= FULL32:
            end64 = self.at
            self._put(struct.pack("<IQHHIIQQQQ", END64, END64_SIZE - 12, 45, 45, 0, 0, n, n, length, begin))
            self._put(struct.pack("<IIQI", LOCATOR, 0, end64, 1))
            n, length, begin = FULL16, FULL32, FULL32
        self._put(struct.pack("<IHHHHIIH", END, 0, 0, n, n, length, begin, 0))
        return self.at


class RangeFile:
    """Reads byte ranges of a file in any store that ``pyarrow.fs`` reaches."""

    def __init__(self, uri: str):
        self.store, self.path = file_system(uri)
        self.file = self.store.open_input_file(self.path)
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise EOFError(f"{self.path}: {len(data)} of {length} bytes at {offset}")
        return data

    def reopen(self) -> None:
        self.close()
        self.file = self.store.open_input_file(self.path)

    def close(self) -> None:
        self.file.close()

    def __enter__(self) -> RangeFile:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def directory(file) -> list[Member]:
    """All entries of an archive's central directory, that of ZIP64 where the archive has one."""
    tail_at = max(0, file.size - END_SIZE - FULL16)
    tail = file.read(tail_at, file.size - tail_at)
    at = tail.rfind(struct.pack("<I", END))
    while at >= 0 and (at + END_SIZE > len(tail) or at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(struct.pack("<I", END), 0, at)
    if at < 0:
        raise ValueError("no end of a central directory: not a ZIP archive, or cut off")
    _, _, _, _, n, length, begin, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    place = tail_at + at - LOCATOR_SIZE
    if place >= 0 and (n == FULL16 or length == FULL32 or begin == FULL32):
        mark, _, end64, _ = struct.unpack("<IIQI", file.read(place, LOCATOR_SIZE))
        if mark == LOCATOR:
            mark, _, _, _, _, _, _, n, length, begin = struct.unpack("<IQHHIIQQQQ", file.read(end64, END64_SIZE))
            if mark != END64:
                raise ValueError("broken ZIP64 end of directory")
    data, at, out = file.read(begin, length), 0, []
    for _ in range(n):
        mark, _, _, flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, _, offset = struct.unpack_from("<IHHHHHHIIIHHHHHII", data, at)
        if mark != CENTRAL:
            raise ValueError("broken central directory")
        at += CENTRAL_SIZE
        name = data[at : at + n_name].decode("utf-8" if flags & UTF8_NAME else "cp437")
        extra, i = data[at + n_name : at + n_name + n_extra], 0
        while i + 4 <= len(extra):
            kind, long = struct.unpack_from("<HH", extra, i)
            if kind == EXTRA64:
                # Only the fields that are full in the entry, in this order.
                wide = iter(struct.unpack_from(f"<{long // 8}Q", extra, i + 4))
                size = next(wide) if size == FULL32 else size
                packed = next(wide) if packed == FULL32 else packed
                offset = next(wide) if offset == FULL32 else offset
            i += 4 + long
        at += n_name + n_extra + n_comment
        out.append(Member(name, offset, size, packed, crc, method))
    return out


def data_offset(file, member: Member) -> int:
    """Where a member's bytes begin, which only its local header tells."""
    head = file.read(member.offset, LOCAL_SIZE)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError(f"no local header at {member.offset}")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return member.offset + LOCAL_SIZE + n_name + n_extra


def read_member(file, member: Member) -> bytes:
    """A stored member's bytes, by one range read that is checked and repeated on its own."""
    if member.method != STORED:
        raise ValueError(f"{member.name} is compressed; members must be stored")

    def once() -> bytes:
        data = file.read(data_offset(file, member), member.size)
        if zlib.crc32(data) != member.crc:
            raise OSError(f"{member.name} at {member.offset}: checksum differs")
        return data

    return retried(file, once)


def retried(file, once):
    for left in range(TRIES - 1, -1, -1):
        try:
            return once()
        except (OSError, EOFError):
            if not left:
                raise
            time.sleep(0.1 * (TRIES - left))
            file.reopen()


class Archives:
    """One task's archives in ``folder``, each closed when it has reached ``limit`` bytes; remembers those closed."""

    def __init__(self, folder: str, suffix: str, limit: int):
        self.folder, self.suffix, self.limit = folder.rstrip("/"), suffix, limit
        self.store, self.path = file_system(self.folder)
        self.store.create_dir(self.path, recursive=True)
        self.closed: list[tuple[str, int, int]] = []
        self.writer: ZipWriter | None = None

    def current(self) -> ZipWriter:
        if self.writer is None:
            self.name = f"{uuid.uuid4().hex}.{self.suffix}"
            self.writer = ZipWriter(self.store.open_output_stream(f"{self.path}/{self.name}"))
        return self.writer

    def close(self, only_full: bool = False) -> None:
        if self.writer is None or only_full and self.writer.at < self.limit:
            return
        size = self.writer.close()
        self.writer.out.close()
        self.closed.append((f"{self.folder}/{self.name}", size, len(self.writer.members)))
        self.writer = None


@dataclass
class ByteRange:
    """The part of an archive from ``begin`` to before ``end``."""

    uri: str
    begin: int
    end: int


class Ranges(InputPartition):
    """Ranges that one task reads."""

    def __init__(self, ranges: list[ByteRange]):
        super().__init__(tuple((r.uri, r.begin, r.end) for r in ranges))
        self.ranges = ranges


def plan_ranges(manifest: str, most: int, most_partitions: int = MOST_PARTITIONS) -> list[Ranges]:
    """Ranges of at most ``most`` bytes over the archives that a manifest table lists, one for each task.

    Where that would be more than ``most_partitions`` tasks, the ranges grow with
    the archives' total size: archives are then cut into fewer, and a task gets several small ones.
    """
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, path = file_system(manifest)
    found = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    listed = [x for f in found for x in zip(*(pq.read_table(f, filesystem=store, columns=["uri", "bytes"]).column(c).to_pylist() for c in ("uri", "bytes")), strict=True)]
    share = max(most, -(-sum(n for _, n in listed) // most_partitions))
    pieces = [ByteRange(uri, at, min(n, at + share)) for uri, n in listed for at in range(0, n, share)]
    if len(pieces) <= most_partitions:
        return [Ranges([p]) for p in pieces]
    out, held, size = [], [], 0
    for p in pieces:
        held.append(p)
        size += p.end - p.begin
        if size >= share:
            out.append(Ranges(held))
            held, size = [], 0
    return [*out, Ranges(held)] if held else out


def spans(places: list[tuple[int, int]], most: int = SPAN) -> Iterator[tuple[int, int]]:
    """First and last place, by number, of runs of (offset, length) that fit one read; a longer one is a run of its own."""
    begin = 0
    for i in range(1, len(places) + 1):
        if i == len(places) or places[i][0] + places[i][1] - places[begin][0] > most:
            yield begin, i
            begin = i


def members_in(file, part: ByteRange) -> Iterator[tuple[Member, bytes]]:
    """The members whose headers begin in a range, in order, with their bytes.

    Neighbours are cut out of one read; a member that does not come out right is
    read again on its own, at its offset.
    """
    inside = sorted((m for m in directory(file) if part.begin <= m.offset < part.end), key=lambda m: m.offset)
    # A header is as long as its name and extra field, which only the header tells; the next member's begin bounds it.
    places = [(m.offset, LOCAL_SIZE + len(m.name.encode()) + 64 + m.size) for m in inside]
    for i, j in spans(places):
        at = places[i][0]
        try:
            whole = file.read(at, min(file.size, places[j - 1][0] + places[j - 1][1]) - at)
        except (OSError, EOFError):
            whole = b""
        for m in inside[i:j]:
            data = _cut(whole, m, m.offset - at)
            yield m, read_member(file, m) if data is None else data


def _cut(whole: bytes, member: Member, at: int) -> bytes | None:
    """A stored member's bytes out of a read that has its header at ``at``, or None if they aren't right."""
    if member.method != STORED or at + LOCAL_SIZE > len(whole) or struct.unpack_from("<I", whole, at)[0] != LOCAL:
        return None
    n_name, n_extra = struct.unpack_from("<HH", whole, at + 26)
    begin = at + LOCAL_SIZE + n_name + n_extra
    data = whole[begin : begin + member.size]
    return data if len(data) == member.size and zlib.crc32(data) == member.crc else None
