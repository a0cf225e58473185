import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered
from millrace.operators.ordered import as_of, overlapping

START = datetime(2024, 1, 1)


def at(i):
    return None if i is None else START + timedelta(hours=i)


def plain_as_of(left, right):
    out = []
    for k, t, x in left:
        found = [r for r in right if r[0] == k and r[1] is not None and t is not None and k is not None and r[1] <= t]
        best = max(found, key=lambda r: (r[1], r[2]), default=None)
        out.append((k, t, x, *(best[1:] if best else (None, None))))
    return Counter(out)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_as_of_like_brute_force(spark, ranges):
    rng = random.Random(ranges)
    key = lambda: rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(key(), rng.choice([None, *range(60)]), i % 37) for i in range(300)]
    right = [(key(), rng.choice([None, *range(60)]), i) for i in range(120)]
    left += left[:5]
    l = spark.createDataFrame([(k, at(t), x) for k, t, x in left], "k string, t timestamp, x int")
    r = spark.createDataFrame([(k, at(t), y) for k, t, y in right], "k string, since timestamp, y int")
    made = as_of(l, r, "k", "t", "since", ["y"], ranges)
    assert made.columns == ["k", "t", "x", "since", "y"]
    assert Counter(map(tuple, made.collect())) == Counter({(k, at(t), x, at(s), y): n for (k, t, x, s, y), n in plain_as_of(left, right).items()})


def test_as_of_edges(spark):
    l = spark.createDataFrame([(1, 2, 5)], "a int, b int, t int")
    none = spark.createDataFrame([], "a int, b int, s int, millrace_key string")
    assert [tuple(r) for r in as_of(l, none, ["a", "b"], "t", "s").collect()] == [(1, 2, 5, None, None)]
    assert as_of(l.limit(0), none, ["a", "b"], "t", "s").count() == 0
    two = spark.createDataFrame([(1, 2, 5, "x"), (1, 3, 5, "y")], "a int, b int, s int, millrace_key string")
    assert [tuple(r) for r in as_of(l, two, ["a", "b"], "t", "s").collect()] == [(1, 2, 5, 5, "x")]
    with pytest.raises(ValueError, match="both sides"):
        as_of(l, l, ["a", "b"], "t", "t")


def test_as_of_splits_a_hot_key(spark):
    left = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("t"))
    right = spark.range(200).select(F.lit(1).alias("k"), (F.col("id") * 100).alias("s"))
    made = as_of(left, right, "k", "t", "s", ranges=8)
    assert made.where("s = int(t / 100) * 100").count() == 20_000
    dealt = ordered.ranges_of(left, ["k", "t"], "part", 8).groupBy("part").count().collect()
    assert len(dealt) == 8 and max(r["count"] for r in dealt) < 5000


def plain_overlaps(left, right):
    good = lambda x: x[0] is not None and None not in x[1:3] and x[1] <= x[2]
    return Counter((a[3], b[3]) for a in left for b in right if good(a) and good(b) and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])


@pytest.mark.parametrize(("ranges", "block"), [(1, 512), (5, 512), (30, 7), (4, 1)])
def test_overlaps_like_brute_force(spark, monkeypatch, ranges, block):
    monkeypatch.setattr(ordered, "SWEEP_ROWS", block)
    rng = random.Random(ranges)

    def rows(first, n):
        out = []
        for i in range(n):
            a = rng.choice([None, *range(50)])
            z = rng.choice([None, 60, *([a + rng.choice([-1, 0, 0, 1, 3, 9])] * 9 if a is not None else [5])])
            out.append((rng.choice(["hot"] * 5 + ["a", "b", None]), a, z, first + i))
        return out

    left, right = rows(0, 150), rows(1000, 150)
    l = spark.createDataFrame(left, "k string, a int, z int, l int")
    r = spark.createDataFrame(right, "k string, a int, z int, r int")
    assert Counter(map(tuple, overlapping(l, r, ["k"], ("a", "z"), ("a", "z"), "l", "r", ranges).collect())) == plain_overlaps(left, right)


def test_overlaps_edges_and_plan(spark):
    spans = spark.createDataFrame([(1, at(0), at(5)), (2, at(5), at(6)), (3, at(7), at(7))], "i bigint, a timestamp, z timestamp")
    other = spans.withColumnRenamed("i", "j")
    made = overlapping(spans, other, [], ("a", "z"), ("a", "z"), "i", "j")
    assert sorted(map(tuple, made.collect())) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 3)]
    assert overlapping(spans.limit(0), other, [], ("a", "z"), ("a", "z"), "i", "j").count() == 0
    keyed = overlapping(spans.withColumn("k", F.lit(1.5)), other.withColumn("k", F.lit(1.5)), ["k"], ("a", "z"), ("a", "z"), "i", "j")
    assert keyed.count() == 5 and "Cartesian" not in keyed._jdf.queryExecution().executedPlan().toString()
