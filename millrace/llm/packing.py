"""Packing token sequences by bin completion.

Texts are tokenised in one pass and cut into pieces.  Only the number of pieces
of each length reaches the driver, at most one number for each length up to the
capacity, and the packing is planned on these counts: best-fit-decreasing gives
the incumbent, and where it needs more sequences than the lower bound, a branch
and bound search completes bins around the longest piece left.  At every node the
undominated fillings are enumerated one by one, those of least waste first, and
pruned by the waste that a better solution could still afford; a filling is first
repeated while its pieces last, then less often.  So the search is complete, but
for one exit: after ``WORK`` steps it settles for the best plan so far.  A plan is
a list of patterns with repeat counts, so it stays small for any number of
pieces; pieces are numbered within their lengths and look up their place.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import bounded_batches, materialize, numbered

#: Steps of the search, its one exit: places looked at, with more for a filling and for a node.  About ten seconds.
WORK, FILLING_STEPS, NODE_STEPS = 40_000_000, 20, 400
#: So many dominated fillings in a row end a window.
SILENT = 64
#: So many fillings are put in order by how often they can be repeated, before the next ones are made.
WINDOW = 24
#: Characters that both tokenizer libraries class alike; texts with others go to the slower one.
_PLAIN = re.compile("[^\\t\\n\\r\\x20-\\x7e\\u00a1-\\u024f\\u2010-\\u2027\\u20ac]")
_SPECIAL = "<|endoftext|>"
_loaded: dict[tuple[str, str | None], object] = {}

Pattern = tuple[tuple[int, int], ...]  # (length, times), longest first


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(vocabulary: str, ranks: str | None):
    """A function from text to ids, made once in each process.

    The ids are those of ``tokenizers`` with the vocabulary file.  If a file of
    ranks is given, texts of plain characters are encoded by the faster
    ``tiktoken`` from the same vocabulary; the tests hold the two equal.
    """
    key = (vocabulary, ranks)
    if key in _loaded:
        return _loaded[key]
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    fast = None
    if ranks:
        import base64

        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if fast is not None and _SPECIAL not in text and not _PLAIN.search(text):
            return np.array(fast.encode_ordinary(text), "<u4")
        return np.array(slow.encode(text, add_special_tokens=False).ids, "<u4")

    _loaded[key] = encode
    return encode


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces; only the first may be shorter than the capacity."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(docs: DataFrame, capacity: int, id_col: str, text_col: str, paths: tuple[str, str | None], end_id: int, keep_ids: bool) -> DataFrame:
    """One row per piece: id, row (a number of the input row), piece, start, length, ids_crc32 and, if wanted, ids."""
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    names = ["id", "row", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            at, out, ids = [], [[], [], [], []], []
            for i, x in enumerate(batch.column(2)):
                tokens = np.append(encode(x.as_py()), np.array([end_id], "<u4"))
                for number, (start, length) in enumerate(cut(len(tokens), capacity)):
                    part = tokens[start : start + length]
                    at.append(i)
                    for column, value in zip(out, (number, start, length, zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
                    if keep_ids:
                        ids.append(part.astype(np.int32))
            columns = [*(batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 1)), pa.array(out[0], pa.int32()), *(pa.array(x, pa.int64()) for x in out[1:])]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if keep_ids else []), names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, row bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids)


def best_fit(counts: Mapping[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit-decreasing on counts: the same bins as piece by piece, with equal bins taken together."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, n: int) -> None:
        if n:
            if room not in open_bins:
                open_bins[room] = []
                insort(rooms, room)
            open_bins[room].append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            room = rooms[i] if i < len(rooms) else capacity
            fits = room // length
            if i < len(rooms):
                pattern, n = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room]
                    rooms.pop(i)
            else:
                pattern, n = (), -(-left // fits)
            whole = min(n, left // fits)
            put(room - fits * length, (*pattern, (length, fits)), whole)
            left -= whole * fits
            n -= whole
            if left and n:
                put(room - left * length, (*pattern, (length, left)), 1)
                n, left = n - 1, 0
            put(room, pattern, n)
    return [x for room in rooms for x in open_bins[room]]


def _dense(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    out = np.zeros(capacity + 1, np.int64)
    out[list(counts)] = list(counts.values())
    return out


def lower_bound(counts: Mapping[int, int], capacity: int) -> int:
    """No packing has fewer bins: by total length, and by pieces that cannot share (Martello and Toth)."""
    return _bound(_dense(counts, capacity))


def _bound(counts: np.ndarray) -> int:
    capacity, half = len(counts) - 1, (len(counts) - 1) // 2
    number, length = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * np.arange(capacity + 1))))
    small = np.arange(half + 1)
    top = np.minimum(capacity - small + 1, capacity + 1)
    big = number[capacity + 1] - number[top]
    halves = number[top] - number[half + 1]
    spare = halves * capacity - (length[top] - length[half + 1])
    rest = length[half + 1] - length[small]
    more = np.maximum(0, -(-(rest - spare) // capacity))
    return int(max(-(-int(length[-1]) // capacity), (big + halves + more).max()))


class _Budget:
    """Steps that are left."""

    def __init__(self, steps: int):
        self.steps = steps


def _smeared(bits: int, width: int) -> int:
    """The numbers in ``bits`` plus 0 to ``width`` - 1."""
    out, have = bits, 1
    while have < width:
        step = min(have, width - have)
        out |= out << step
        have += step
    return out


def _dominated(pattern: Pattern, waste: int, counts: np.ndarray, left_out: int) -> bool:
    """Whether a piece that the filling leaves out could take the place of some of its pieces, no longer together, or of its waste.

    Sets of lengths are the bits of a number.  ``left_out`` has the lengths of all pieces at hand.
    """
    one, many = 0, 0  # sums of one piece, of two or more
    for k, n in pattern:
        if counts[k] == n:
            left_out &= ~(1 << k)
        for _ in range(n):
            many |= many << k | one << k
            one |= 1 << k
    if waste:
        many |= _smeared((1 | one | many) << 1, waste)
    return bool(left_out & many)


def fillings(counts: np.ndarray, room: int, most_waste: int | None = None, budget: _Budget | None = None) -> Iterator[Pattern]:
    """The patterns of ``_fillings``."""
    return (p for p in _fillings(counts, room, most_waste, budget or _Budget(1 << 62)) if p is not None)


def _fillings(counts: np.ndarray, room: int, most_waste: int | None, budget: _Budget) -> Iterator[Pattern | None]:
    """All undominated ways to fill ``room`` from ``counts[length]`` pieces, one by one: least waste first, then longer pieces first.

    A filling is dominated if a piece that it leaves out could take the place
    of some of its pieces, together no longer than that one, without overflow.
    Sums that pieces can't make are known beforehand, so every branch that is
    gone into ends in a filling.  A None among them stands for ``SILENT``
    dominated ones.  It ends early with the budget's steps.
    """
    silent = 0
    lengths = [int(k) for k in np.flatnonzero(counts[: room + 1])[::-1]]
    mask = (1 << room + 1) - 1
    reach = [1]  # sums of the shorter pieces, from the shortest on
    for k in reversed(lengths):
        sums, n, step = reach[-1], min(int(counts[k]), room // k), 1
        while n:
            step = min(step, n)
            sums |= sums << step * k & mask
            n -= step
            step *= 2
        reach.append(sums)
    reach.reverse()
    left_out = sum(1 << k for k in lengths)

    def walk(i: int, left: int) -> Iterator[Pattern]:
        """Fillings of exactly ``left`` by ``lengths[i:]``."""
        if not left:
            yield ()
            return
        while i < len(lengths) and reach[i] >> left & 1 and budget.steps > 0:
            k = lengths[i]
            budget.steps -= 1
            if k <= left:
                for n in range(min(int(counts[k]), left // k), 0, -1):
                    if reach[i + 1] >> left - n * k & 1:
                        for rest in walk(i + 1, left - n * k):
                            yield ((k, n), *rest)
            i += 1

    least = 0 if most_waste is None else max(0, room - most_waste)
    for total in range(room, least - 1, -1):
        if reach[0] >> total & 1:
            for pattern in walk(0, total):
                budget.steps -= FILLING_STEPS
                if budget.steps <= 0:
                    return
                if _dominated(pattern, room - total, counts, left_out):
                    silent += 1
                    if silent % SILENT == 0:
                        yield None
                else:
                    yield pattern


class _Completions:
    """Bins around the longest piece left, with the number of times: each filling as often as its pieces last, then each less often.

    Only the window at hand is kept.  When it is used up, the enumeration begins
    again and passes over what was taken before: a search holds very many of
    these, but seldom comes back to one.
    """

    def __init__(self, counts: np.ndarray, most_waste: int, budget: _Budget):
        self.counts, self.most_waste, self.budget = counts, most_waste, budget
        self.top = int(np.flatnonzero(counts)[-1])
        self.window: list[tuple[Pattern, int]] = []
        self.taken, self.fewer = 0, False

    def next(self) -> tuple[Pattern, int] | None:
        """The next completion, None after the last or when the budget is used up."""
        while not self.window:
            made = self._made()
            if made is None:
                if self.fewer:
                    return None
                self.taken, self.fewer = 0, True
                continue
            if self.fewer:
                made = [(pattern, n) for pattern, most in made for n in range(most - 1, 0, -1)]
            self.window = made[::-1]
        return self.window.pop()

    def _made(self) -> list[tuple[Pattern, int]] | None:
        """The next window's fillings with the piece, and how often they can be repeated; None if there are no more."""
        rest = self.counts.copy()
        rest[self.top] -= 1
        all_fillings = islice(_fillings(rest, len(rest) - 1 - self.top, self.most_waste, self.budget), self.taken, None)
        ready, seen = [], False
        for filling in all_fillings:
            self.taken, seen = self.taken + 1, True
            if filling is None:
                break  # nothing but dominated ones come: what there is will do for a window
            parts = dict(filling)
            parts[self.top] = parts.get(self.top, 0) + 1
            ready.append((tuple(sorted(parts.items(), reverse=True)), min(int(self.counts[k]) // m for k, m in parts.items())))
            if len(ready) == WINDOW:
                break
        # Frequent lengths are used up along the way; the sort keeps the order of equals.
        ready.sort(key=lambda x: (sum(k * m for k, m in x[0]), x[1]), reverse=True)
        return ready if seen else None


def complete_bins(counts: Mapping[int, int], capacity: int, work: int = WORK) -> list[tuple[Pattern, int]]:
    """Patterns and repeat counts that hold every piece in as few bins as the search finds, never more than best-fit.

    The result has the fewest possible bins if it reaches the lower bound or the
    search ends before ``work`` steps.
    """
    counts = {k: n for k, n in counts.items() if n}
    if any(not 0 < k <= capacity for k in counts):
        raise ValueError("a piece is longer than a bin, or empty")
    if not counts:
        return []
    best = best_fit(counts, capacity)
    fewest, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total, budget = sum(k * n for k, n in counts.items()), _Budget(work)
    seen: set[bytes] = set()

    def slack(waste: int) -> int:
        """The waste that a better plan could still afford."""
        return (fewest - 1) * capacity - total - waste

    whole = _dense(counts, capacity)
    # Depth first: counts left, bins used, their waste, what they are, and the completions still to try.
    stack: list[tuple] = [(whole, 0, 0, None, _Completions(whole, slack(0), budget))]
    while stack and fewest > bound and budget.steps > 0:
        left, used, waste, made, options = stack[-1]
        option = options.next()
        if option is None:
            stack.pop()
            continue
        pattern, n = option
        waste += n * (capacity - sum(k * m for k, m in pattern))
        if slack(waste) < 0:
            continue
        used, made, left = used + n, (option, made), left.copy()
        for k, m in pattern:
            left[k] -= n * m
        if not left.any():
            best, fewest = [], used
            while made:
                best.append(made[0])
                made = made[1]
            continue
        budget.steps -= NODE_STEPS
        state = hashlib.blake2b(left.tobytes() + used.to_bytes(8, "little"), digest_size=16).digest()
        if state in seen or used + _bound(left) >= fewest:
            continue
        seen.add(state)
        stack.append((left, used, waste, made, _Completions(left, slack(waste), budget)))
    return best


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", paths: tuple[str, str | None] | None = None, end_id: int = 0, keep_ids: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per piece: ``id_col``, piece, start, length, ids_crc32, sequence_id, offset and, with ``keep_ids``, ids.

    ``row_col`` is the name of a further column that numbers the rows of
    ``docs``: it tells pieces of repeated rows apart.  A document's ids end with ``end_id``; null and empty texts have that one
    only.  Documents longer than ``capacity`` are cut, others stay whole.
    Offsets within a sequence have no gaps.  Repeated rows and null ids are
    documents like others; a very long text is held whole by one task while it
    is tokenised.  An empty table gives an empty result; other columns are not
    read.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    made = pieces(docs, capacity, id_col, text_col, paths or tokenizer_paths(), end_id, keep_ids)
    made = materialize(made.withColumn("row_id", F.monotonically_increasing_id()))
    counts = {r.length: r.n for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    place: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in counts}
    begin, sequence = dict.fromkeys(counts, 0), 0
    for pattern, n in complete_bins(counts, capacity):
        offset = 0
        for k, times in pattern:
            place[k].append((begin[k], times, sequence, offset))
            begin[k] += n * times
            offset += k * times
        sequence += n
    spans = docs.sparkSession.createDataFrame([(k, x) for k, x in place.items()], "length bigint, spans array<struct<begin:bigint,times:bigint,sequence:bigint,offset:bigint>>")
    there = numbered(made, "length", list(counts.items()), "row_id", "number").join(F.broadcast(spans), "length")
    span = F.element_at(F.filter("spans", lambda s: s["begin"] <= F.col("number")), -1)
    inside = there.withColumn("span", span).withColumn("inside", F.col("number") - F.col("span.begin"))
    return inside.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("span.sequence") + F.floor(F.col("inside") / F.col("span.times"))).alias("sequence_id"),
        (F.col("span.offset") + F.pmod("inside", "span.times") * F.col("length")).alias("offset"),
        *["ids"] * keep_ids,
        *([] if row_col is None else [F.col("row").alias(row_col)]),
    )
