import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import mixing


def u(seed, key, part):
    return (int(hashlib.md5(f"{seed}|{'' if key is None else key}|{part}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def draw(x, mean):
    k, p, total = 0, math.exp(-mean), math.exp(-mean)
    while total <= x and k < mixing.TERMS + 1:
        k += 1
        p *= mean / k
        total += p
    return k


def plain(rows, weights=None, budget=1.0, seed=0):
    size = Counter()
    for _, text, _, source, _ in rows:
        size[source] += len((text or "").encode()) + 1
    w = {s: math.sqrt(n) if weights is None else weights.get(s, 0.0) for s, n in size.items()}
    out = Counter()
    for i, text, _, source, _ in rows:
        rate = w[source] / (sum(w.values()) or 1.0) * sum(size.values()) * budget / size[source]
        parts = max(1, math.ceil(rate / mixing.PART_MEAN))
        for c in range(sum(draw(u(seed, i, j), rate / parts) for j in range(parts))):
            out[i, text, source, c] += 1
    return out


@pytest.mark.parametrize(("weights", "budget"), [(None, 1.0), (None, 40.0), ({"s0": 1.0, "s2": 3.0}, 2.0), ({}, 1.0)])
def test_like_a_plain_version(odd_docs, odd_rows, weights, budget):
    made = mixing.replicate(odd_docs, weights, budget=budget, seed=9)
    assert set(made.columns) == {*odd_docs.columns, "mix_key"}
    assert Counter((r.doc_id, r.text, r.source, r.mix_copy) for r in made.collect()) == plain(odd_rows, weights, budget, 9)


def test_shares_reach_the_weights(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('x', 9) as text", "if(id % 10 = 0, 'rare', 'hot') as source")
    counts = {r.source: r["count"] for r in mixing.replicate(docs, {"rare": 1.0, "hot": 1.0}).groupBy("source").count().collect()}
    assert abs(counts["rare"] - 10_000) < 500 and abs(counts["hot"] - 10_000) < 500


def test_one_random_order(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "'x' as text", "'s' as source")
    made = mixing.replicate(docs, seed=1)
    rows = made.select("doc_id", "mix_key", F.spark_partition_id().alias("p")).collect()
    keys = [r.mix_key for r in rows]
    assert keys == sorted(keys) and len({r.p for r in rows}) > 1
    ids = [r.doc_id for r in rows]
    close = sum(abs(a - b) < 50 for a, b in zip(ids, ids[1:], strict=False))
    assert close < 0.05 * len(ids)
    assert ids != [r.doc_id for r in mixing.replicate(docs, seed=2).collect()]


def test_no_python_in_the_plan(odd_docs):
    plan = mixing.replicate(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_many_sources_are_joined(spark, odd_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert Counter((r.doc_id, r.text, r.source, r.mix_copy) for r in mixing.replicate(odd_docs, seed=4).collect()) == plain(odd_rows, seed=4)


def test_empty_and_errors(no_docs):
    assert mixing.replicate(no_docs).count() == 0
    with pytest.raises(ValueError):
        mixing.replicate(no_docs, {"a": -1.0})
