import random
import zlib
from collections import Counter, defaultdict

import pytest

from millrace.llm import sharding
from millrace.llm.queries import QUERIES


def plain_best_fit(sizes, capacity):
    bins, where = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [(room, b) for b, room in enumerate(bins) if room >= sizes[i]]
        if fits:
            where[i] = min(fits)[1]
        else:
            bins.append(capacity)
            where[i] = len(bins) - 1
        bins[where[i]] -= sizes[i]
    return where


def test_tree_like_plain_best_fit():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randint(20, 200)
        sizes = [rng.randint(0, capacity) for _ in range(rng.randint(0, 150))]
        assert sharding.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)


def test_limits():
    with pytest.raises(ValueError):
        sharding.best_fit_decreasing([5], 4)
    assert sharding.best_fit_decreasing([3, 3, 3], 4, most=2) is None
    assert sharding.even_bins([], 3) == []
    assert sorted(sharding.even_bins([100, 1, 1, 1, 1], 3)) == [0, 0, 1, 1, 2]


def holds(rows, n):
    """rows: (id, size, shard, slot, text key)."""
    slots, shards = defaultdict(list), defaultdict(set)
    for _, _, shard, slot, key in rows:
        slots[shard].append(slot)
        shards[key].add(shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in shards.values())
    assert all(0 <= s < n for s in slots)


def test_odd_rows(odd_docs, odd_rows):
    rows = sharding.shard(odd_docs, 4).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    holds([(r.doc_id, r["size"], r.shard, r.slot, r.text_crc32) for r in rows], 4)


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op2_sharding"](spark, sf_dir).collect()
    assert {(r.doc_id, r["size"], r.text_crc32) for r in rows} == {(i, len(t.encode()) + 8, zlib.crc32(t.encode())) for i, t in docs.items()}
    holds([(r.doc_id, r["size"], r.shard, r.slot, docs[r.doc_id]) for r in rows], 24)
    assert {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}


def test_sizes_are_near_equal(spark):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "x" * rng.randint(1, 400) + str(i)) for i in range(4000)], "doc_id bigint, text string")
    total = Counter()
    for r in sharding.shard(docs, 8).collect():
        total[r.shard] += r["size"]
    assert max(total.values()) - min(total.values()) < 0.005 * sum(total.values()) / 8


def test_many_rows_of_one_text_are_numbered_in_cells(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "if(id < 2500, 'same', cast(id as string)) as text")
    holds([(r.doc_id, r["size"], r.shard, r.slot, r.text_crc32) for r in sharding.shard(docs, 3).collect()], 3)


def test_empty_table(no_docs):
    assert sharding.shard(no_docs).count() == 0
