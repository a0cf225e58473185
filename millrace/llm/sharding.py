"""Shards of near equal size by best-fit-decreasing bin packing.

Rows with equal texts form an indivisible group.  Groups above a fixed share of
all bytes are items of their own, of which there can only be a bounded number;
the other groups are dealt by hash into a fixed number of bundles, each a small
share of a shard.  Only these items reach the driver, where they are packed,
largest first, each into the open bin with the tightest remaining capacity that
still takes it, found in a balanced tree.  The least capacity that needs no more
than the wanted number of bins is found by bisection.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import materialize, numbered, text_key, utf8

#: Bundles, and largest number of groups with an item of their own, for each shard.
BUNDLES, LARGE = 512, 200


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key: tuple[int, int]):
        self.key, self.level, self.left, self.right = key, 1, None, None


class RoomTree:
    """An AA tree of (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: _Node | None = None

    @staticmethod
    def _skew(t: _Node) -> _Node:
        if t.left and t.left.level == t.level:
            low = t.left
            t.left, low.right = low.right, t
            return low
        return t

    @staticmethod
    def _split(t: _Node) -> _Node:
        if t.right and t.right.right and t.right.right.level == t.level:
            high = t.right
            t.right, high.left = high.left, t
            high.level += 1
            return high
        return t

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def _add(self, t: _Node | None, key: tuple[int, int]) -> _Node:
        if t is None:
            return _Node(key)
        if key < t.key:
            t.left = self._add(t.left, key)
        else:
            t.right = self._add(t.right, key)
        return self._split(self._skew(t))

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, t: _Node | None, key: tuple[int, int]) -> _Node | None:
        if t is None:
            return None
        if key < t.key:
            t.left = self._remove(t.left, key)
        elif key > t.key:
            t.right = self._remove(t.right, key)
        elif t.left is None:
            return t.right
        elif t.right is None:
            return t.left
        else:
            heir = t.right
            while heir.left:
                heir = heir.left
            t.key = heir.key
            t.right = self._remove(t.right, heir.key)
        want = 1 + min(t.left.level if t.left else 0, t.right.level if t.right else 0)
        if want < t.level:
            t.level = want
            if t.right and t.right.level > want:
                t.right.level = want
        t = self._skew(t)
        if t.right:
            t.right = self._skew(t.right)
            if t.right.right:
                t.right.right = self._skew(t.right.right)
        t = self._split(t)
        if t.right:
            t.right = self._split(t.right)
        return t

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The least entry with room for ``size``."""
        t, best = self.root, None
        while t:
            if t.key[0] >= size:
                t, best = t.left, t.key
            else:
                t = t.right
        return best


def best_fit_decreasing(sizes: Sequence[int], capacity: int, most: int | None = None) -> list[int] | None:
    """The bin of each item; None where more than ``most`` bins would be needed.

    No bin holds more than ``capacity``.  Equal sizes keep their order.
    """
    if sizes and max(sizes) > capacity:
        raise ValueError("an item is larger than a bin")
    room, bins, count = RoomTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = room.tightest(sizes[i])
        if found is None:
            if most is not None and count == most:
                return None
            found = (capacity, count)
            count += 1
        else:
            room.remove(found)
        bins[i] = found[1]
        room.add((found[0] - sizes[i], found[1]))
    return bins


def even_bins(sizes: Sequence[int], n_bins: int) -> list[int]:
    """Bins 0 to ``n_bins`` - 1 by best-fit-decreasing with the least capacity that bisection finds.

    An item above the mean of what is left has a bin of its own, so that it
    doesn't set the capacity of the others.
    """
    if not sizes:
        return []
    top, rest = max(range(len(sizes)), key=lambda i: sizes[i]), sum(sizes)
    if sizes[top] * n_bins > rest and n_bins > 1:
        others = even_bins([*sizes[:top], *sizes[top + 1 :]], n_bins - 1)
        return [*others[:top], n_bins - 1, *others[top:]]
    low = max(sizes[top], -(-rest // n_bins))
    high, best = low, best_fit_decreasing(sizes, low, n_bins)
    step = max(1, low // 1000)
    while best is None:
        low, high = high + 1, high + step
        best, step = best_fit_decreasing(sizes, high, n_bins), 2 * step
    while high - low > max(1, high // 100_000):
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle, n_bins)
        if tried is None:
            low = middle + 1
        else:
            high, best = middle, tried
    return best


def shard(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, size, text_crc32, shard and slot.

    ``size`` is the text's UTF-8 bytes plus 8 (null: 8, with the checksum of no
    bytes, and one group with the empty texts).  Rows with equal texts share a
    shard; apart from that the shards' bytes are near equal, as far as the
    largest group allows.  ``slot`` counts a shard's rows from 0 without gaps.
    Repeated rows and null ids each keep a row and a slot of their own.  An
    empty table gives an empty result; other columns are not read.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark, body, bundles = docs.sparkSession, utf8(F.col(text_col)), BUNDLES * n_shards
    rows = materialize(
        docs.select(
            F.col(id_col), (F.octet_length(body) + 8).cast("bigint").alias("size"), F.crc32(body).alias("text_crc32"),
            *text_key(F.col(text_col)), F.monotonically_increasing_id().alias("row_id"),
        )
    )
    groups = materialize(rows.groupBy("t1", "t2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")))
    total = groups.agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).first()
    if not total.n:
        return rows.select(id_col, "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("bigint").alias("slot"))
    least = total.bytes // (LARGE * n_shards)  # at most LARGE * n_shards groups are larger
    large = groups.where(F.col("bytes") > least).orderBy("t1", "t2").collect()
    bundle = F.pmod(F.col("t1"), F.lit(bundles)).cast("int")
    small = groups.where(F.col("bytes") <= least).groupBy(bundle.alias("bundle")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")).orderBy("bundle").collect()
    items = [*large, *small]
    placed, used = [], [0] * n_shards
    for i, (x, b) in enumerate(zip(items, even_bins([x.bytes for x in items], n_shards), strict=True)):
        placed.append((i, b, used[b]))
        used[b] += x.n
    own = spark.createDataFrame([(x.t1, x.t2, *p) for x, p in zip(large, placed, strict=False)], "t1 bigint, t2 bigint, own_item bigint, own_shard int, own_base bigint")
    shared = spark.createDataFrame([(x.bundle, *p) for x, p in zip(small, placed[len(large) :], strict=True)], "bundle int, item bigint, shard int, base bigint")
    # Both have a bounded number of rows, whatever the input: LARGE and BUNDLES times the shards.
    dealt = rows.join(F.broadcast(own), ["t1", "t2"], "left").withColumn("bundle", bundle).join(F.broadcast(shared), "bundle", "left")
    dealt = dealt.select(
        id_col, "size", "text_crc32", "row_id",
        *(F.coalesce(f"own_{c}", c).alias(c) for c in ("item", "shard", "base")),
    )
    within = numbered(dealt, "item", [(i, x.n) for i, x in enumerate(items)], "row_id", "number")
    return within.select(id_col, "size", "text_crc32", "shard", (F.col("base") + F.col("number")).alias("slot"))
