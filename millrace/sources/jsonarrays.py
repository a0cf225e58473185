"""Large JSON arrays of objects, read by many tasks.

A byte in the middle of a file may lie in a string or not, and at any depth of
nesting.  So each part of the file is looked at for every state that it may
begin in; the driver chains those few numbers, which gives each part the state
that it does begin in; and then each task cuts out the objects that begin in its
part, reading on to where the last one ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.files import DOCUMENT, _path
from millrace.sources.shared import file_system, qualified

#: Bytes of a part, and parts of a file at most.
PART_BYTES, PARTS = 8 << 20, 100_000
_QUOTE, _SLASH, _OPEN, _CLOSE = ord('"'), ord("\\"), b"[{", b"]}"
#: In a string or not, and whether the first byte is escaped: how a part may begin.
STATES = [(False, False), (True, False), (True, True)]


def _marks(data: np.ndarray, escaped: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """How many quotes that aren't escaped come up to each byte, what each bracket adds to the depth, and whether the next byte is escaped."""
    slash = data == _SLASH
    places = np.arange(len(data))
    # Where the run of backslashes that ends before a byte began.
    last_other = np.maximum.accumulate(np.where(slash, -1, places)) if len(data) else places
    run = places - last_other
    before = np.concatenate([[0], run[:-1]]) if len(data) else run
    reaches = before == places  # the run goes back to the part's begin
    odd = (before + (reaches & escaped)) % 2 == 1
    end = bool(len(data)) and (int(run[-1]) + (int(run[-1]) == len(data) and escaped)) % 2 == 1 if len(data) else escaped
    quotes = np.cumsum((data == _QUOTE) & ~odd)
    depth = np.isin(data, list(_OPEN)).astype(np.int64) - np.isin(data, list(_CLOSE))
    return quotes, depth, bool(end)


def summary(data: bytes) -> list[tuple[bool, bool, int]]:
    """For each of ``STATES`` that a part may begin in: the state that it ends in, and what it adds to the depth."""
    out, octets = [], np.frombuffer(data, np.uint8)
    for inside, escaped in STATES:
        quotes, depth, end = _marks(octets, escaped)
        within = (quotes + inside) % 2 == 1
        out.append((bool(within[-1]) if len(octets) else inside, end and bool(within[-1] if len(octets) else inside), int(depth[~within].sum())))
    return out


def _cuts(data: bytes, inside: bool, escaped: bool, depth: int) -> tuple[np.ndarray, np.ndarray, tuple[bool, bool, int]]:
    """Where objects of the array begin and end, and the state behind the part."""
    octets = np.frombuffer(data, np.uint8)
    quotes, change, end = _marks(octets, escaped)
    within = (quotes + inside) % 2 == 1
    change[within] = 0
    after = depth + np.cumsum(change)
    begins = np.flatnonzero((change == 1) & (after == 2))
    ends = np.flatnonzero((change == -1) & (after == 1)) + 1
    bare = (after == 1) & (change == 0) & ~np.isin(octets, list(b" \t\r\n,"))
    if bare.any() or (octets[begins] != ord("{")).any():
        raise ValueError("the array has elements that aren't objects")
    inside = bool(within[-1]) if len(octets) else inside
    return begins, ends, (inside, end and inside, int(after[-1]) if len(octets) else depth)


def objects_of(read, begin: int, length: int, size: int, state: tuple[bool, bool, int], step: int = 1 << 20) -> Iterator[bytes]:
    """The objects of an array that begin in a part; ``read`` gives bytes from a place, as many as there are."""
    data = read(begin, length)
    begins, ends, state = _cuts(data, *state)
    ends = ends[ends > begins[0]] if len(begins) else ends
    for a, z in zip(begins, ends, strict=False):
        yield data[a:z]
    if len(begins) > len(ends):
        rest, at = [data[begins[-1] :]], begin + length
        while at < size:
            more = read(at, step)
            _, ends, state = _cuts(more, *state)
            if len(ends):
                yield b"".join([*rest, more[: ends[0]]])
                return
            rest.append(more)
            at += len(more)
        raise ValueError("an object of the array has no end")


def load_array(spark: SparkSession, path: str, schema: str = DOCUMENT, part_bytes: int = PART_BYTES) -> DataFrame:
    """The objects of a JSON array, or of the arrays in all files of a folder, with the columns of ``schema``.

    Files are read in parts by tasks, through the file system of their URI; no
    task holds more than a part and one object.  Fields that an object lacks are
    null; ``text``, if it is a column, is empty then.  Files of no bytes in a
    folder have no rows, as writers leave them for empty partitions; a file that
    is no array of objects, and values of other types than the schema's, are errors.
    """
    where, store = _path(spark, path)
    found = [where] if store.getFileStatus(where).isFile() else [s.getPath() for s in store.listStatus(where) if not s.getPath().getName().startswith(("_", "."))]
    parts = []
    for n, file in enumerate(found):
        size = store.getFileStatus(file).getLen()
        step = max(part_bytes, -(-size // PARTS))
        parts += [(n, qualified(spark, file.toString()), size, at, min(step, size - at)) for at in range(0, size, step)]
    if not parts:
        if store.getFileStatus(where).isFile():
            raise ValueError(f"{path} is empty")
        return spark.createDataFrame([], schema)
    names = ["file", "uri", "size", "at", "length"]
    places = "file bigint, uri string, size bigint, at bigint, length bigint"

    def reader(uri: str):
        files, where = file_system(uri)

        def read(at: int, n: int) -> bytes:
            with files.open_input_file(where) as f:
                f.seek(at)
                return f.read(n)

        return read

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                told = [v for state in summary(reader(x["uri"])(x["at"], x["length"])) for v in state]
                yield pa.RecordBatch.from_pylist([{"file": x["file"], "at": x["at"], "told": [int(v) for v in told]}])

    tasks = min(len(parts), 4 * spark.sparkContext.defaultParallelism)
    table = spark.createDataFrame(parts, places).repartition(tasks, "at", "file")
    # A few numbers for each part, of which there are at most PARTS in a file.
    told = {(r.file, r.at): r.told for r in table.mapInArrow(looked, "file bigint, at bigint, told array<bigint>").collect()}
    states, now = [], {}
    for file, uri, size, at, length in parts:
        inside, escaped, depth = now.get(file, (False, False, 0))
        states.append((file, uri, size, at, length, inside, escaped, depth))
        k = STATES.index((inside, escaped))
        ends = told[file, at][3 * k : 3 * k + 3]
        now[file] = (bool(ends[0]), bool(ends[1]), depth + ends[2])
    if any(state != (False, False, 0) for state in now.values()):
        raise ValueError(f"{path} has an array that doesn't end")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                read, held, n = reader(x["uri"]), [], 0
                if x["at"] == 0 and not read(0, min(x["size"], 1 << 16)).removeprefix(b"\xef\xbb\xbf").lstrip(b" \t\r\n").startswith(b"["):
                    raise ValueError("the file isn't an array")
                for item in objects_of(read, x["at"], x["length"], x["size"], (x["inside"], x["escaped"], x["depth"])):
                    held.append(item.decode())
                    n += len(item)
                    if n > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                        held, n = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])

    dealt = spark.createDataFrame(states, f"{places}, inside boolean, escaped boolean, depth bigint").repartition(tasks, *names[:1], "at")
    rows = dealt.mapInArrow(cut, "value string").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("row")).select("row.*")
    return rows.withColumn("text", F.coalesce("text", F.lit(""))) if "text" in rows.columns else rows


def save_array(df: DataFrame, path: str) -> None:
    """Each partition of ``df`` as a file with one JSON array; null fields are left out."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = "["
        for batch in batches:
            made = []
            for x in batch.column(0).to_pylist():
                made.append(mark + x)
                mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], ["value"])
        yield pa.RecordBatch.from_arrays([pa.array(["]" if mark == "," else "[]"])], ["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(lines, "value string").write.text(path)
