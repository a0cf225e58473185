import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.operators import knn
from millrace.operators.nearest import nearest


def table(spark, rows, label="int"):
    return spark.createDataFrame(rows, f"id bigint, v array<double>, label {label}")


def plain(queries, rows, k, metric, others_only):
    out = set()
    for i, q in queries:
        def value(v, q=q):
            if metric == "euclidean":
                return math.sqrt(sum((a - b) ** 2 for a, b in zip(q, v, strict=True)))
            n = math.sqrt(sum(a * a for a in q)) * math.sqrt(sum(a * a for a in v))
            return sum(a * b for a, b in zip(q, v, strict=True)) / n if n else 0.0

        found = [(value(v), j) for j, v in rows if not (others_only and i == j)]
        found.sort(key=lambda x: (x[0], x[1]) if metric == "euclidean" else (-x[0], -x[1]))
        out |= {(i, rank + 1, j) for rank, (_, j) in enumerate(found[:k])}
    return out


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("others_only", [False, True])
@pytest.mark.parametrize("k", [1, 5, 500])
def test_like_brute_force(spark, metric, others_only, k):
    rng = random.Random(k)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(150)]  # many ties
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(4)
    queries = df.where("id % 10 = 0")
    found = nearest(queries, df, k, metric, others_only, block=4).collect()
    got = {(r.query_id, r["rank"], r.id) for r in found}
    expected = plain([r for r in rows if r[0] % 10 == 0], rows, k, metric, others_only)
    if metric == "euclidean":
        assert got == expected
    else:  # equal similarities may differ in the last bit here: compare the number, and the values by rank
        vectors = dict(rows)

        def cosine(i, j):
            a, b = vectors[i], vectors[j]
            n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
            return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0

        assert len(got) == len(expected)
        best = {(i, rank): cosine(i, j) for i, rank, j in expected}
        for r in found:
            assert math.isclose(r.value, best[r.query_id, r["rank"]], abs_tol=1e-12) and math.isclose(r.value, cosine(r.query_id, r.id), abs_tol=1e-12)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_repeated_query_rows(spark, metric):
    rows = [(i, [float(i), 1.0]) for i in range(40)] + [(7, [7.0, 1.0])] * 6
    df = spark.createDataFrame(rows, "id bigint, v array<double>").repartition(1)
    found = nearest(df.where("id = 7"), df, 5, metric, others_only=True).collect()
    assert len(found) == 5 and all(r.query_id == 7 != r.id for r in found)


def test_errors(spark):
    train = table(spark, [(1, [0.0, 0.0], 1)])
    for k in (0, -2):
        with pytest.raises(ValueError):
            nearest(train, train, k)
    with pytest.raises(ValueError):
        nearest(train, train, 1, "taxi")
    with pytest.raises(ValueError):
        knn.classify(train, train.limit(0))
    with pytest.raises(Exception, match="unequal width"):
        nearest(train, table(spark, [(2, [1.0], 1)]), 1).collect()


def test_no_queries(spark):
    train = table(spark, [(1, [0.0, 0.0], 1)])
    assert nearest(train.limit(0), train, 3).count() == 0


@pytest.mark.parametrize(("labels", "kind", "expected"), [([3, 3, 1, 1, 2], "int", 1), (["b", "b", "a", "a", "c"], "string", "a"), ([-1, -1, -5, -5, 0], "int", -5), ([True, True, False, False], "boolean", False)])
def test_vote_ties_go_to_the_smallest_label(spark, labels, kind, expected):
    train = table(spark, [(i, [float(i), 0.0], x) for i, x in enumerate(labels)], kind)
    query = spark.createDataFrame([(9, [0.0, 0.0])], "id bigint, v array<double>")
    assert knn.classify(query, train, 5).first().label == expected


def test_k_above_the_rows_takes_all(spark):
    train = table(spark, [(0, [0.0, 0.0], 7), (1, [9.0, 9.0], 8), (2, [9.0, 9.0], 8)])
    query = spark.createDataFrame([(5, [0.0, 0.0])], "id bigint, v array<double>")
    assert knn.classify(query, train, 50).first().label == 8
    assert knn.classify(query, train, 1).first().label == 7


def test_grid(spark):
    points = knn.grid(spark, (0, 1, 3), (5, 6, 2)).orderBy("id").collect()
    assert [(p.gi, p.gj, p.gx, p.gy) for p in points] == [(0, 0, 0.0, 5.0), (0, 1, 0.5, 5.0), (0, 2, 1.0, 5.0), (1, 0, 0.0, 6.0), (1, 1, 0.5, 6.0), (1, 2, 1.0, 6.0)]
    train = table(spark, [(0, [0.0, 5.0], 1), (1, [1.0, 6.0], 2)])
    labels = {(r.gi, r.gj): r.label for r in knn.classify_grid(train, (0, 1, 2), (5, 6, 2), 1).collect()}
    assert labels[0, 0] == 1 and labels[1, 1] == 2 and len(labels) == 4


def test_blobs(spark):
    rng = random.Random(0)
    rows = [(i, [rng.gauss(c, 1), rng.gauss(c, 1)], label) for i, (c, label) in enumerate([(2, 0)] * 30 + [(-2, 1)] * 30)]
    train = table(spark, rows)
    ends = knn.bounds(train.select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))
    assert ends[0] == min(r[1][0] for r in rows) - 1.5
    got = knn.classify(train.select("id", "v"), train, 5)
    right = Counter(r.label == rows[r.query_id][2] for r in got.collect())
    assert right[True] >= 57
    with pytest.raises(ValueError):
        knn.bounds(train.limit(0).select(F.col("v")[0].alias("x"), F.col("v")[1].alias("y")))
