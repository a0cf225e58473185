import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import topk
from millrace.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, k, wanted, scale=256.0):
    sound = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in sound:
        if wanted(q):
            score = {i: max(-(1 << 63), min((1 << 63) - 1, sum(x * y for x, y in zip(a, b, strict=False)))) for i, b in sound if i != q}
            out |= {(q, n + 1, i, score[i]) for n, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:k])}
    return out


def got(df, k, **options):
    return {tuple(r) for r in topk.exact_top_k(df, F.col("vec_id") % 5 == 0, k, **options).collect()}


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_ties_nulls_and_odd_numbers(spark, k):
    rng = random.Random(k)
    rows = [(i, [np.float32(rng.choice([-0.5, 0.0, 0.25, 0.3])).item() for _ in range(4)]) for i in range(200)]
    rows += [(500, None), (505, [1.0, None, 0.0, 0.0]), (510, [float("nan")] * 4), (515, [float("inf")] * 4), (None, [1.0] * 4), (520, [0.5, 0.5]), (521, [])]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit("own")).withColumn("score", F.lit("own")).repartition(5)
    assert got(df, k, query_block=7) == plain(rows, k, lambda q: q % 5 == 0)


def test_one_hot_vector(spark):
    rows = [(i, [0.5, 0.5]) for i in range(3000)] + [(3000 + i, [i / 10, 0.1]) for i in range(10)]
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(3), 5) == plain(rows, 5, lambda q: q % 5 == 0)


@pytest.mark.parametrize("k", [1, 5, 60])
def test_repeated_query_rows(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.0, 0.5, 2.0]) for _ in range(3)]) for i in range(43)]
    rows += [(i, [9.0, 9.0, 9.0]) for i in range(0, 43, 5) for _ in range(6)]  # every query row six times more, above all others
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    answered = {}
    for q, rank, i, score in got(df, k):
        answered.setdefault(q, []).append((rank, score, i))
    for q, found in answered.items():
        own = {tuple(math.floor(256 * x) for x in v) for i, v in rows if i == q}
        others = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i != q]
        assert len(found) == min(k, len(others))
        best = [sorted(((sum(a * b for a, b in zip(v, w, strict=True)), -i) for i, w in others), reverse=True)[:k] for v in own]
        assert [(s, -i) for _, s, i in sorted(found)] in best  # either of the rows that share the id is the query
    assert len(answered) == 9


def test_large_numbers_are_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [3e9, 2.0]), (2, [-3e9, 3.0]), (5, [3.1e12, 0.5]), (6, [1e30, 1.0])]
    assert got(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), 5) == plain(rows, 5, lambda q: q % 5 == 0)


def test_query_like_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert {tuple(r) for r in QUERIES["op6_topk"](spark, sf_dir).collect()} == plain(rows, 5, lambda q: q % 50 == 0)


def test_empty_and_errors(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(empty, 3) == set()
    assert got(spark.createDataFrame([(5, [1.0])], SCHEMA), 3) == set()
    with pytest.raises(ValueError):
        got(empty, 0)
