"""Removal of repeated byte strings, found with suffix arrays.

A string of ``width`` bytes is repeated if it starts at two places of the
corpus.  Suffix arrays are built over blocks by two-stage sorting, and a string
is repeated where two neighbours in an array have a common prefix of ``width``
bytes or more.  Blocks are made so that equal strings always meet:

* Every window of ``width`` bytes is given the least hash of the shorter strings
  in it, its anchor.  Equal windows have equal anchors.  Neighbouring windows
  mostly share theirs, so a text falls into segments of consecutive windows.
* Anchors of one segment in all are dropped: their windows are unique.  Equal
  segments, as copies and shared passages have them, are counted by partial
  aggregation and become one segment with a multiplicity.
* The distinct segments of an anchor go to the same block.  An anchor with very
  many distinct segments, such as the edges of a passage in very many contexts,
  is split: its segments are treated like texts, with longer anchors, the last
  as long as the window, where a group has one distinct segment only.

Hashes only decide what is compared with what, apart from 128-bit hashes that
stand for whole texts and segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import bounded_batches, fresh, materialize, text_key, utf8

#: An anchor with more distinct segments is split by longer anchors.
HEAVY = 1024
#: Bytes in a suffix array, apart from the last anchor's segments, and in a task.
BLOCK, TASK = 1 << 18, 32 << 20
_CHUNK = 1 << 20


def anchor_lengths(width: int) -> list[int]:
    """Lengths of the anchors, level by level; the last is ``width``."""
    return sorted({max(1, width // 6), max(1, width - width // 3), max(1, width - width // 20), width})


def _gram_hashes(text: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all strings of ``k`` bytes, from hashes of their halves."""
    mul = 0x9E3779B97F4A7C15
    unit, size, made, made_size = (text.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, None, 0
    while True:
        if k & size:
            if made is None:
                made, made_size = unit, size
            else:
                n = len(text) - made_size - size + 1
                made = made[:n] * np.uint64(pow(mul, size, 1 << 64)) + unit[made_size : made_size + n]
                made_size += size
        if made_size == k:
            break
        n = len(text) - 2 * size + 1
        unit = unit[:n] * np.uint64(pow(mul, size, 1 << 64)) + unit[size : size + n]
        size *= 2
    made = made ^ (made >> np.uint64(29))
    made *= np.uint64(0x94D049BB133111EB)
    return made ^ (made >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return np.minimum(least[: len(least) - (width - size)], least[width - size :]) if size < width else least


def segments(text: bytes, width: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Anchors, first windows and numbers of windows of a text's segments.

    A segment's windows share the leftmost place of their anchor, so it has at
    most ``width - k + 1`` windows.  Long texts come part by part.
    """
    for at in range(0, len(text) - width + 1, _CHUNK):
        part = np.frombuffer(text, np.uint8)[at : at + _CHUNK + width - 1]
        grams = _gram_hashes(part, k)
        least = _sliding_min(grams, width - k + 1)
        # A window whose anchor is its very start is the last with that place.
        ends = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
        first = np.concatenate(([0], np.flatnonzero(ends) + 1))
        yield least[first].view(np.int64), first + at, np.diff(np.concatenate((first, [len(least)])))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    Suffixes smaller than their successors are sorted directly, the others
    induced by one scan over the buckets of first bytes: a suffix that stands in
    a bucket puts its predecessor, if larger, at the front of that one's bucket.
    """
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    step = np.diff(text.astype(np.int16), append=-1)
    moves = np.flatnonzero(step)
    smaller = step[moves[np.searchsorted(moves, np.arange(n))]] > 0
    direct = np.flatnonzero(smaller)
    padded = np.concatenate((text, np.zeros(depth, np.uint8)))
    views = np.ndarray((n,), dtype=f"V{depth}", buffer=padded.data, strides=(1,))
    direct = direct[np.argsort(views[direct])]
    starts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        front = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, np.int64)
        bucket = []
        while len(front):
            bucket.append(front)
            before = front[front > 0] - 1
            front = before[(text[before] == c) & ~smaller[before]]
        bucket.append(direct[starts[c] : starts[c + 1]])
        whole = np.concatenate(bucket)
        out.append(whole)
        before = whole[whole > 0] - 1
        before = before[(text[before] > c) & ~smaller[before]]
        if len(before):
            heads = text[before]
            order = np.argsort(heads, kind="stable")
            before, heads = before[order], heads[order]
            cuts = np.flatnonzero(np.diff(heads)) + 1
            for group, head in zip(np.split(before, cuts), heads[np.concatenate(([0], cuts))], strict=True):
                waiting[head].append(group)
    return np.concatenate(out)


def adjacent_prefixes(text: np.ndarray, order: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of each suffix in ``order`` with the one before it, up to ``cap``; the first has 0.

    Every suffix must have ``cap`` bytes.
    """
    out = np.zeros(len(order), np.int64)
    if len(order) < 2:
        return out
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    words = np.ndarray((len(text) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    left = np.arange(1, len(order))
    for at in range(0, cap, 8):
        differ = words[order[left] + at] ^ words[order[left - 1] + at]
        if cap - at < 8:
            differ &= np.uint64((1 << 8 * (cap - at)) - 1)
        ended = differ != 0
        lowest = differ[ended] & (~differ[ended] + np.uint64(1))
        out[left[ended]] = at + (np.log2(lowest.astype(np.float64)).astype(np.int64) >> 3)
        left = left[~ended]
        if not len(left):
            break
    out[left] = cap
    return out


def repeated_starts(parts: list[bytes], windows: list[int], counts: list[int], width: int) -> list[np.ndarray]:
    """For each part, which of its first ``windows`` places start a string of ``width`` bytes that is found elsewhere.

    A part with a count above one stands for so many equal parts.
    """
    text = np.frombuffer(b"".join(parts), np.uint8)
    begin = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    valid = np.zeros(len(text), bool)
    repeated = np.zeros(len(text), bool)
    for b, n, c in zip(begin[:-1], windows, counts, strict=True):
        valid[b : b + n] = True
        repeated[b : b + n] = c > 1
    order = suffix_array(text, width)
    order = order[valid[order]]
    alike = np.flatnonzero(adjacent_prefixes(text, order, width) >= width)
    repeated[order[alike]] = True
    repeated[order[alike - 1]] = True
    return [repeated[b : b + n] for b, n in zip(begin[:-1], windows, strict=True)]


def _cut_texts(width: int, k: int):
    """A row per text with the lists of its segments: anchor, 128-bit hash, first window, windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists: list[list] = [[], [], [], [], []]
            for x in batch.column(3):
                text = x.as_py()
                made = [np.concatenate(c) for c in zip(*segments(text, width, k), strict=True)] or [np.zeros(0, np.int64)] * 3
                ends = made[1] + made[2] + width - 1
                hashes = [xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(made[1].tolist(), ends.tolist(), strict=True)]
                pair = np.frombuffer(b"".join(hashes), ">i8").astype(np.int64).reshape(-1, 2)
                for column, value in zip(lists, (made[0], pair[:, 0], pair[:, 1], made[1], made[2].astype(np.int32)), strict=True):
                    column.append(value)
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(v) for v in lists[0]]))), pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(v), kind)) for v, kind in zip(lists, (pa.int64(),) * 4 + (pa.int32(),), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["k1", "k2", "weight", "anchor", "g1", "g2", "first", "n"])

    return run, "k1 bigint, k2 bigint, weight bigint, anchor array<bigint>, g1 array<bigint>, g2 array<bigint>, first array<bigint>, n array<int>"


def _slice(width: int):
    """Segments with their bytes, from texts and the lists of segments that they stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for x, picks in zip(batch.column(0), batch.column(1), strict=True):
                text = x.as_py()
                rows += [(p["anchor"], p["g1"], p["g2"], p["n"], p["weight"], text[p["first"] : p["first"] + p["n"] + width - 1]) for p in picks.as_py()]
                if len(rows) > 10_000:
                    yield _segment_batch(rows)
                    rows = []
            if rows:
                yield _segment_batch(rows)

    return run, "anchor bigint, g1 bigint, g2 bigint, n int, weight bigint, body binary"


def _segment_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "g1", "g2", "n", "weight", "body"])


def _sort_blocks(width: int, block: int):
    """Masks of the repeated windows of segments, which come in the order of their anchors."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        masks = repeated_starts([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], width)
        held = [(r[0], r[1], np.packbits(m, bitorder="little").tobytes()) for r, m in zip(rows, masks, strict=True) if m.any()]
        columns = list(zip(*held, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["g1", "g2", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            anchors = batch.column(0).to_pylist()
            rest = list(zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True))
            for anchor, row in zip(anchors, rest, strict=True):
                if anchor != last and size >= block:
                    yield solve(rows)
                    rows, size = [], 0
                last = anchor
                rows.append(row)
                size += len(row[4])
        if rows:
            yield solve(rows)

    return run, "g1 bigint, g2 bigint, mask binary"


def repeated_windows(texts: DataFrame, bodies: DataFrame, width: int, heavy: int = HEAVY, block: int = BLOCK, level: int = 0) -> DataFrame:
    """``k1``, ``k2`` and ``spans`` of every text with repeated windows.

    ``texts`` has k1, k2, weight and body, one row or more for each key, which
    stands for the body; ``bodies`` has k1, k2 and body, one row for each key.
    A span has a first window, a number of windows and a mask of the repeated
    ones among them, least bit first; a null mask means all of them.
    """
    lengths = anchor_lengths(width)
    lists = materialize(bounded_batches(texts).select("k1", "k2", "weight", "body").mapInArrow(*_cut_texts(width, lengths[level])))
    flat = lists.select("k1", "k2", "weight", F.inline(F.arrays_zip("anchor", "g1", "g2", "first", "n")))
    # Aggregates are written before they are joined: a join of plain tables is one whose hot anchors Spark can split.
    shared = materialize(flat.groupBy("anchor").agg(F.sum("weight").alias("total")).where("total > 1").select("anchor"))
    found = materialize(flat.join(shared, "anchor"))
    distinct = materialize(found.groupBy("anchor", "g1", "g2").agg(F.sum("weight").alias("weight"), F.min(F.struct("k1", "k2", "first", "n")).alias("at")))
    kinds = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("kinds")))
    distinct = distinct.join(kinds, "anchor")
    last = level + 1 == len(lengths)
    split = F.lit(False) if last else F.col("kinds") > heavy

    def with_bytes(wanted: DataFrame) -> DataFrame:
        picks = wanted.groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct("anchor", "g1", "g2", F.col("at.first").alias("first"), F.col("at.n").alias("n"), "weight")).alias("picks"))
        return bodies.join(picks, ["k1", "k2"]).select("body", "picks").mapInArrow(*_slice(width))

    compared = distinct.where((F.col("kinds") > 1) & ~split)
    size = compared.agg(F.sum(F.col("at.n") + F.lit(width - 1))).first()[0] or 0
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK))
    ordered = with_bytes(compared).repartition(tasks, "anchor").sortWithinPartitions("anchor")
    masks = ordered.mapInArrow(*_sort_blocks(width, block))
    # One distinct segment with a total above one is repeated as a whole.
    masks = masks.union(distinct.where(F.col("kinds") == 1).select("g1", "g2", F.lit(None).cast("binary")))
    if not last and distinct.where(split).limit(1).count():
        own = materialize(with_bytes(distinct.where(split)).select(F.col("g1").alias("k1"), F.col("g2").alias("k2"), "n", "weight", "body"))
        deeper = repeated_windows(own, own.select("k1", "k2", "body"), width, heavy, block, level + 1)
        masks = masks.union(deeper.mapInArrow(*_flatten(width)))
    marked = found.select("k1", "k2", "g1", "g2", "first", "n").join(masks, ["g1", "g2"])
    # Copies of a text list the same spans: a set, made before the shuffle too.
    return marked.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "n", "mask")).alias("spans"))


def _flags(spans: list[dict], n: int) -> np.ndarray:
    flags = np.zeros(n, bool)
    for s in spans:
        at, size = s["first"], s["n"]
        if s["mask"] is None:
            flags[at : at + size] = True
        else:
            flags[at : at + size] |= np.unpackbits(np.frombuffer(s["mask"], np.uint8), count=size, bitorder="little").astype(bool)
    return flags


def _flatten(width: int):
    """The masks of segments that were treated like texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column(2).to_pylist():
                made.append(np.packbits(_flags(x, max(s["first"] + s["n"] for s in x)), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["g1", "g2", "mask"])

    return run, "g1 bigint, g2 bigint, mask binary"


def _covered(text: bytes, spans: list[dict] | None, width: int) -> np.ndarray:
    if not spans:
        return np.zeros(len(text), bool)
    starts = np.flatnonzero(_flags(spans, len(text) - width + 1))
    edges = np.bincount(starts, minlength=len(text) + 1) - np.bincount(starts + width, minlength=len(text) + 1)
    return np.cumsum(edges[:-1]) > 0


def whole_characters(text: bytes, covered: np.ndarray) -> str:
    """The text without the covered bytes; a character goes only if all its bytes are covered."""
    if not covered.any():
        return text.decode()
    a = np.frombuffer(text, np.uint8)
    heads = np.flatnonzero((a & 0xC0) != 0x80)
    gone = np.minimum.reduceat(covered, heads)
    return a[~np.repeat(gone, np.diff(np.concatenate((heads, [len(a)]))))].tobytes().decode()


def _remove(width: int, keep_text: bool):
    names = ["k1", "k2", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kept = [], []
            for x, spans in zip(batch.column(2), batch.column(3), strict=True):
                text, spans = x.as_py(), spans.as_py()
                covered = _covered(text, spans, width)
                left = np.frombuffer(text, np.uint8)[~covered].tobytes() if spans else text
                runs = int(np.count_nonzero(np.diff(np.concatenate(([False], covered)).astype(np.int8)) == 1)) if spans else 0
                rows.append((len(text), len(text) - len(left), runs, hashlib.sha256(left).hexdigest()))
                if keep_text:
                    kept.append(whole_characters(text, covered))
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)] if rows else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, *([pa.array(kept, pa.string())] if keep_text else [])], names)

    return run, "k1 bigint, k2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * keep_text


def deduplicate(docs: DataFrame, width: int = 200, text_col: str = "text", keep_text: bool = False, heavy: int = HEAVY, block: int = BLOCK, prefix: str = "") -> DataFrame:
    """``docs`` without its text, with n_bytes, n_removed, n_spans and kept_sha256 and, with ``keep_text``, kept.

    Removed is every byte that lies in a string of ``width`` bytes which also
    starts at another place of the table, in the same text or in another row's;
    overlaps count, strings don't run over the end of a text and are judged on
    the input.  ``n_spans`` is the number of maximal runs removed,
    ``kept_sha256`` the digest of the bytes left.  ``kept`` is the text left,
    from which a character goes only if all its bytes do.  Null texts count as
    empty; texts shorter than ``width`` stay whole; repeated rows are copies of
    each other.  An empty table gives an empty result.  Names of results begin
    with ``prefix``; columns that have such names are replaced.
    """
    if width < 1:
        raise ValueError("width must be positive")
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * keep_text]
    key = fresh(docs, "key")
    named = {r: prefix + r for r in results}
    t1, t2 = text_key(F.col(text_col))
    keyed = docs.select(t1.alias("k1"), t2.alias("k2"), utf8(F.col(text_col)).alias("body"))
    bodies = keyed.groupBy("k1", "k2").agg(F.first("body").alias("body"))
    spans = repeated_windows(keyed.withColumn("weight", F.lit(1).cast("bigint")), bodies, width, heavy, block)
    done = bodies.join(spans, ["k1", "k2"], "left").select("k1", "k2", "body", "spans").mapInArrow(*_remove(width, keep_text))
    done = done.select(F.struct("k1", "k2").alias(key), *(F.col(r).alias(named[r]) for r in results))
    others = [c for c in docs.columns if c != text_col and c not in named.values()]
    own = docs.select(*others, F.struct(t1.alias("k1"), t2.alias("k2")).alias(key))
    return own.join(done, key).select(*others, *named.values())
