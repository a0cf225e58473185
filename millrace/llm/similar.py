"""Links between texts that share most of their word shingles.

Candidates come from a prefix filter: shingles are put in one order, rare ones
first, and two texts of a Jaccard similarity ``s`` share a shingle among the
first ``n - ceil(s * n) + 1`` of their ``n``, so no pair is missed.  Shingles
are hashed for this only: every link is verified on the texts' own shingles.
How common a shingle is, is counted on a sample; this decides the order only.

Texts that share a prefix shingle are a bucket, of any size, and never held as a
whole.  In a large bucket all are first compared with a few pivots, texts with few
rarer shingles, as those have that others are copies of: this links most of a
group of near copies in a time that goes with its size.  After that only pairs of
different components are looked at.  Those of small buckets are listed once and,
unless the places of what they share rule them out, verified in a join; in a large
one the texts outside its most frequent component meet all others in cells of
bounded size, where a component that is linked already is passed over.

Texts themselves move only where their sketches meet.  A sketch has a bit or two
for each shingle, the parity of the shingles that are hashed to it, so two sets
differ in at least as many shingles as their sketches do in bits.  Pairs that
differ in too many for their sizes can't be similar; no similar pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import bounded_batches, drop_since, mark, materialize, text_key, utf8
from millrace.llm.graphs import components
from millrace.operators.tables import likely

#: A bucket of more texts is large: it has pivots, so many, and its texts are compared in cells of two blocks of about so many.
LARGE, PIVOTS, BLOCK = 32, 8, 2048
#: Texts (on average) and shingles that the order is made from.
SAMPLE_TEXTS, COMMON = 20_000, 200_000
_SEEN, _COLUMNS = 1 << 18, 2048
_TOKEN = ["token", "id", "n", "at"]


def shingles(text: bytes, words: int = 5) -> set[bytes]:
    """The distinct word shingles, words as in ``simhash.fingerprint``; a shorter text has one, a text without words none."""
    found = text.lower().split()
    if len(found) < words:
        return {b" ".join(found)} if found else set()
    return {b" ".join(w) for w in zip(*(found[i:] for i in range(words)), strict=False)}


def prefix_length(n: int, similarity: Fraction) -> int:
    """So many of the first shingles of ``n`` hold one of any text that is similar enough."""
    return n - -(-similarity.numerator * n // similarity.denominator) + 1 if n else 0


def similar(a: set[bytes], b: set[bytes], similarity: Fraction) -> bool:
    """Whether the Jaccard similarity is at least ``similarity``."""
    num, den = similarity.numerator, similarity.denominator
    if min(len(a), len(b)) * den < num * max(len(a), len(b)):
        return False
    both = len(a & b)
    return both * den >= num * (len(a) + len(b) - both)


def similar_cells(left: Iterable[set[bytes]], right: Iterable[set[bytes]], similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places of all similar pairs of two series of sets; what they share is counted by products of matrices of some shingles at a time.

    Sets are taken one by one: only each distinct shingle is held, and a number for each member.
    """
    codes: dict[bytes, int] = {}
    made = [[np.fromiter((codes.setdefault(s, len(codes)) for s in x), np.int32, len(x)) for x in side] for side in (left, right)]
    sizes = [np.array([len(x) for x in side], np.int64) for side in made]
    left, right = map(len, sizes)
    row = np.repeat(np.arange(left + right, dtype=np.int32), np.concatenate(sizes))
    code = np.concatenate([*made[0], *made[1], np.zeros(0, np.int32)])
    often = np.bincount(code, minlength=len(codes)) > 1
    codes.clear()
    made.clear()
    held = often[code]
    row, code = row[held], (np.cumsum(often) - 1)[code[held]]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    both = np.zeros((left, right), np.float32)
    for begin in range(0, int(often.sum()), _COLUMNS):
        i, j = np.searchsorted(code, [begin, begin + _COLUMNS])
        part = np.zeros((left + right, _COLUMNS), np.float32)
        part[row[i:j], code[i:j] - begin] = 1
        both += part[:left] @ part[left:].T
    num, den, at, to = similarity.numerator, similarity.denominator, [], []
    for i, n in enumerate(sizes[0]):  # row by row: a cell needs no more matrices of its size
        total = n + sizes[1]
        found = np.flatnonzero((both[i] >= -(-num * total // (num + den))) & (total > 0))  # exact below 2^24 shingles in common
        at.append(np.full(len(found), i))
        to.append(found)
    return (np.concatenate(at), np.concatenate(to)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _shared_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of tokens that several ids have, each id once, of rows sorted by token and id; one row is held over between batches."""
    last, handed_on = None, False
    for batch in batches:
        rows = pa.Table.from_batches([batch] if last is None else [*last.to_batches(), batch]).combine_chunks()
        if not rows.num_rows:
            continue
        token, ident = (rows.column(c).to_numpy() for c in ("token", "id"))
        at = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (ident[1:] != ident[:-1]))))
        same = token[at][1:] == token[at][:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same))
        done = bool(keep[-1]) or (len(at) == 1 and handed_on)
        keep[0] &= not handed_on
        yield from rows.take(pa.array(at[keep])).to_batches()
        # The last one is looked at again: its token may go on.
        last, handed_on = rows.slice(int(at[-1]), 1), done


def _shared_and_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_shared_tokens`` of the rows of tokens; those of sketches, whose ``at`` is -1, are handed on."""
    aside: list[pa.RecordBatch] = []

    def tokens() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch = pc.equal(batch.column("at"), -1)
            aside.append(batch.filter(sketch))
            yield batch.filter(pc.invert(sketch))

    for rows in _shared_tokens(tokens()):
        yield from aside
        aside.clear()
        yield rows
    yield from aside


def sketch(hashes: np.ndarray) -> bytes:
    """For each of ``n`` to ``2 n`` bits (a power of two, at least 64) the parity of the hashes that fall to it, least bit first."""
    bits = max(64, 1 << (len(hashes) - 1).bit_length())
    odd = np.bincount(hashes.view(np.uint64) & np.uint64(bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def may_be_similar(a: bytes, b: bytes, n: int, similarity: Fraction) -> bool:
    """Whether two sketches differ in no more bits than similar sets of ``n`` members together do; the longer sketch is folded."""
    if len(a) < len(b):
        a, b = b, a
    x, size = int.from_bytes(a, "little"), 8 * len(a)
    while size > 8 * len(b):
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    num, den = similarity.numerator, similarity.denominator
    return (x ^ int.from_bytes(b, "little")).bit_count() * (num + den) <= (den - num) * n


def sketched_cells(sketches: list[bytes], n: np.ndarray, label: np.ndarray, asks: np.ndarray, similarity: Fraction) -> np.ndarray:
    """Which rows of a cell may be similar to one of the other side that has another label; ``asks`` tells the sides."""
    num, den, keep = similarity.numerator, similarity.denominator, np.zeros(len(n), bool)
    size = np.array([len(s) // 8 for s in sketches])

    def folded(at: np.ndarray, width: int) -> np.ndarray:
        words = np.frombuffer(b"".join(sketches[i] for i in at), "<u8").reshape(len(at), -1, width)
        return np.bitwise_xor.reduce(words, axis=1)

    for b in np.unique(size[asks]):
        for c in np.unique(size[~asks]):
            x, y = np.flatnonzero(asks & (size == b)), np.flatnonzero(~asks & (size == c))
            if max(n[x].min() * num - n[y].max() * den, n[y].min() * num - n[x].max() * den) > 0:
                continue
            left, right = folded(x, min(b, c)), folded(y, min(b, c))
            for i, row in zip(x, left, strict=True):
                apart = np.bitwise_count(right ^ row).sum(axis=1, dtype=np.int64)
                near = y[(apart * (num + den) <= (den - num) * (n[i] + n[y])) & (label[y] != label[i])]
                keep[i] |= len(near) > 0
                keep[near] = True
    return keep


def _hashes(text: bytes, words: int) -> np.ndarray:
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles(text, words)), np.uint64).view(np.int64))


def similar_links(docs: DataFrame, text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """Similar pairs ``(a, b)`` of text hashes, ``t1`` of ``text_key``, whose components are those of all similar pairs.

    Texts are similar if the Jaccard similarity of their distinct word shingles
    is at least ``similarity``, which must be above 0.  Texts without words have
    no links, and equal texts are one; null texts count as empty, very long ones
    are held whole.  The result is a table in the shared folder.
    """
    level = Fraction(str(similarity))
    if not 0 < level <= 1:
        raise ValueError("similarity must be above 0 and at most 1")
    texts = bounded_batches(docs).select(text_key(F.col(text_col))[0], utf8(F.col(text_col)).alias("body"))

    def tokens(common: np.ndarray | None = None, counts: np.ndarray | None = None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in batches:
                for key, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if key in seen:
                        continue
                    if len(seen) == _SEEN:
                        seen.clear()
                    seen.add(key)
                    made = _hashes(body.as_py(), words)
                    n = len(made)
                    if common is not None and n:
                        short = sketch(made)
                        rank = np.zeros(n, np.int64)
                        if len(common):
                            at = np.minimum(np.searchsorted(common, made), len(common) - 1)
                            rank = np.where(common[at] == made, counts[at], 0)
                        made = made[np.lexsort((made, rank))][: prefix_length(n, level)]
                    at = np.arange(len(made), dtype=np.int32)
                    rows = [made, np.full(len(made), key, np.int64), np.full(len(made), n, np.int32), at]
                    if common is None:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], _TOKEN)
                    elif n:
                        more = [pa.array(np.append(x, np.array(y, x.dtype))) for x, y in zip(rows, (key, key, n, -1), strict=True)]
                        yield pa.RecordBatch.from_arrays([*more, pa.concat_arrays([pa.nulls(len(made), pa.binary()), pa.array([short], pa.binary())])], [*_TOKEN, "sketch"])

        return run

    kind = "token bigint, id bigint, n int, at int"
    share = max(1, -(-docs.count() // SAMPLE_TEXTS))
    sample = texts.where(F.pmod(F.col("t1"), F.lit(share)) == 0).mapInArrow(tokens(), kind)
    often = sample.groupBy("token").agg(F.count("*").alias("c")).where("c > 2").orderBy(F.desc("c"), "token").limit(COMMON).orderBy("token").toArrow()
    common, counts = (often.column(c).to_numpy() for c in ("token", "c"))

    point = mark()
    kind += ", sketch binary"
    rows = texts.mapInArrow(tokens(common, counts), kind)
    both = materialize(rows.repartition("token").sortWithinPartitions("token", "id").mapInArrow(_shared_and_sketches, kind))
    listed = both.where("at >= 0").drop("sketch")
    sketches = materialize(both.where("at < 0").groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def with_bodies(ids: DataFrame) -> DataFrame:
        """``id`` and ``body`` of the texts with these ids; of the others hardly any is moved."""
        ids = ids.toDF("t1")
        # Not a semi-join, which Spark would put before the filter; with the hint texts are dealt out by id once, for the join and the grouping.
        needed = likely(texts, "t1", ids).join(ids.hint("merge"), "t1")
        return materialize(needed.groupBy("t1").agg(F.first("body").alias("body")).withColumnRenamed("t1", "id"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n = (batch.column(i).to_pylist() for i in (2, 3, 4))
            yield batch.select(["a", "b"]).filter(pa.array([may_be_similar(*p, level) for p in zip(x, y, n, strict=True)], pa.bool_()))

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs ``a``, ``b`` that are similar."""
        # Tables of their own, so that their sizes are known before the texts are joined.
        x, y = (sketches.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")) for end in ("a", "b"))
        pairs = materialize(materialize(pairs).join(x, "a").join(y, "b").select("a", "b", "sketch_a", "sketch_b", F.col("n_a") + F.col("n_b")).mapInArrow(near, "a bigint, b bigint"))
        bodies = with_bodies(materialize(pairs.select("a").union(pairs.select("b")).distinct()))
        both = pairs.join(bodies.select(F.col("id").alias("a"), F.col("body").alias("left")), "a").join(bodies.select(F.col("id").alias("b"), F.col("body").alias("right")), "b")

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[int, set[bytes]] = {}  # pivots come again and again
            for batch in batches:
                ok = []
                for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if a not in held:
                        if len(held) == PIVOTS:
                            held.clear()
                        held[a] = shingles(x.as_py(), words)
                    ok.append(similar(held[a], shingles(y.as_py(), words), level))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return materialize(both.select("a", "b", "left", "right").mapInArrow(check, "a bigint, b bigint"))

    fits = F.least("x.n", "y.n") * F.lit(level.denominator) >= F.greatest("x.n", "y.n") * F.lit(level.numerator)
    sizes = listed.groupBy("token").agg(F.count("*").alias("all"))
    inside = listed.join(sizes.where(F.col("all") > LARGE).select("token"), "token")
    rank = F.row_number().over(Window.partitionBy("token").orderBy("at", F.xxhash64("id"), "id"))
    pivots = inside.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).drop("rank")
    met = inside.alias("y").join(pivots.alias("x"), F.col("x.token") == F.col("y.token"))
    first = verified(met.where((F.col("x.id") != F.col("y.id")) & fits).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct())

    roots = components(first).withColumnRenamed("node", "id")
    labelled = materialize(listed.join(roots, "id", "left").select("token", "id", "n", "at", F.coalesce("root", "id").alias("label")))
    groups = labelled.groupBy("token", "label").agg(F.count("*").alias("many"))
    largest = F.max_by(F.struct("label", "many"), F.struct("many", "label")).alias("main")
    mixed = materialize(groups.groupBy("token").agg(F.sum("many").alias("all"), F.count("*").alias("kinds"), largest).where("kinds > 1").select("token", "all", "main"))
    left = labelled.join(mixed.select("token", "all", "main.label", "main.many").toDF("token", "all", "main", "n_main"), "token")

    few = left.where(F.col("all") <= LARGE).groupBy("token").agg(F.collect_list(F.struct("id", "n", "at", "label")).alias("held"))
    both = few.select(F.explode("held").alias("x"), "held").select("x", F.explode("held").alias("y"))
    shared = both.where((F.col("x.id") < F.col("y.id")) & (F.col("x.label") != F.col("y.label")) & fits)
    counted = shared.groupBy(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.n").alias("m"), F.col("y.n").alias("n"))
    # Besides the shared prefix shingles only those after the last of them can be common.  Large buckets' shingles aren't counted, but their pairs are found there.
    most = F.col("c") + F.least(F.col("m") - F.col("i"), F.col("n") - F.col("j")) - 1
    enough = most * F.lit(level.numerator + level.denominator) >= (F.col("m") + F.col("n")) * F.lit(level.numerator)
    second = verified(counted.agg(F.count("*").alias("c"), F.max("x.at").alias("i"), F.max("y.at").alias("j")).where(enough).select("a", "b"))

    # Blocks of all texts, and of those outside the main component; each of these meets every block, in one cell.
    large = left.where(F.col("all") > LARGE).withColumn("outside", F.col("label") != F.col("main"))
    n_blocks, n_outer = (F.ceil(c / F.lit(BLOCK)).cast("int") for c in (F.col("all"), F.col("all") - F.col("n_main")))
    block, outer = F.pmod(F.xxhash64("id"), n_blocks).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), n_outer).cast("int")
    here = large.select("token", "id", "label", F.lit(False).alias("asks"), block.alias("i"), F.explode(F.sequence(F.lit(0), n_outer - 1)).alias("j"))
    asking = large.where("outside").select("token", "id", "label", F.lit(True).alias("asks"), F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("i"), outer.alias("j"))
    placed = materialize(here.union(asking))
    kind = "token bigint, id bigint, label bigint, asks boolean, i int, j int"

    def meet(group: pa.Table) -> pa.Table:
        n, label = (np.asarray(group.column(c).combine_chunks()).astype(np.int64) for c in ("n", "label"))
        asks = np.array(group.column("asks").to_pylist(), bool)
        return group.filter(pa.array(sketched_cells(group.column("sketch").to_pylist(), n, label, asks, level))).select(["token", "id", "label", "asks", "i", "j"])

    # Texts that no sketch comes near are out before the others are fetched.
    cells = materialize(placed.join(sketches, "id").groupBy("token", "i", "j").applyInArrow(meet, kind))
    bodies = with_bodies(materialize(cells.select("id").distinct()))

    def search(group: pa.Table) -> pa.Table:
        ids, label, asks = (np.asarray(group.column(c).combine_chunks()) if c != "asks" else np.array(group.column(c).to_pylist(), bool) for c in ("id", "label", "asks"))
        x, y = np.flatnonzero(asks), np.flatnonzero(~asks)
        at, to = similar_cells(*((shingles(group.column("body")[int(i)].as_py(), words) for i in side) for side in (x, y)), level)
        at, to = x[at], y[to]
        apart = label[at] != label[to]
        # One link between two components will do.
        _, first_ones = np.unique(np.stack([label[at[apart]], label[to[apart]]]), axis=1, return_index=True)
        return pa.table({"a": pa.array(ids[at[apart]][first_ones], pa.int64()), "b": pa.array(ids[to[apart]][first_ones], pa.int64())})

    searched = cells.join(bodies, "id").groupBy("token", "i", "j").applyInArrow(search, "a bigint, b bigint")
    second = second.union(searched)
    links = materialize(first.union(second))
    drop_since(point, links)
    return links
