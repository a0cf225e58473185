import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as t
from millrace.operators import embedding
from millrace.sources.providers import HashEmbedding

TEXTS = [None, "", "123 456", "漢字", "Don't DON'T don't", "the cat, the dog", "ends'", "Größe"]


def plain(text, dim):
    return Counter(int(hashlib.md5(w.encode()).hexdigest(), 16) % dim for w in re.findall("[a-z']+", (text or "").lower()))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")


@pytest.mark.parametrize("dim", [64, 7, 1024, 1_000_003])
def test_buckets(docs, dim):
    got = {i: Counter() for i in range(len(TEXTS))}
    for r in embedding.bucket_counts(docs, dim=dim).collect():
        got[r.doc_id][r.bucket] = r.n
    assert got == {i: plain(x, dim) for i, x in enumerate(TEXTS)}


def test_vectors_like_the_provider(docs):
    for r in embedding.embed(docs).collect():
        expected = HashEmbedding().embed([TEXTS[r.doc_id] or ""])[0]
        assert len(r.embedding) == 64 and all(math.isclose(a, b) for a, b in zip(r.embedding, expected, strict=True))
        assert math.isclose(sum(x * x for x in r.embedding), 1.0) or not any(r.embedding)


def test_weights(docs):
    for r in embedding.bucket_weights(docs).collect():
        counts = plain(TEXTS[r.doc_id], 64)
        assert math.isclose(r.weight, counts[r.bucket] / math.sqrt(sum(n * n for n in counts.values())))


def test_search(docs):
    rows = embedding.search(docs, ["don't", "xyzzy plugh", ""], 20).collect()
    best = {q: [r for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in range(3)}
    assert [len(x) for x in best.values()] == [len(TEXTS)] * 3  # more than there are gives all
    assert best[0][0].doc_id == 4 and best[0][0].score == 1.0
    assert [r.doc_id for r in best[2]] == list(range(len(TEXTS)))[::-1]  # ties: larger id first
    assert all(r.score == 0.0 for r in best[2])


def test_equal_texts_have_equal_scores(spark):
    docs = spark.createDataFrame([(i, "one two three two") for i in range(5)], "doc_id bigint, text string")
    rows = embedding.search(docs, ["two"], 3).orderBy("rank").collect()
    assert [r.doc_id for r in rows] == [4, 3, 2] and len({r.score for r in rows}) == 1


@pytest.mark.parametrize("k", [0, -1])
def test_k_must_be_positive(docs, k):
    with pytest.raises(ValueError):
        embedding.search(docs, ["a"], k)
    with pytest.raises(ValueError):
        embedding.search_vectors(docs, [1.0], k)


def test_dense_search(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 0.0])], "vec_id bigint, embedding array<float>")
    got = [(r.vec_id, r.score) for r in embedding.search_vectors(rows, [2.0, 0.0], 9).orderBy("rank").collect()]
    assert got == [(2, 1.0), (0, 1.0), (1, 0.0), (3, -1.0)]


def test_strip_and_dim(spark):
    assert spark.range(1).select(t.stripped(F.lit(" \t\n quit \r\n")).alias("x")).first().x == "quit"
    with pytest.raises(ValueError):
        t.bucket(F.lit("a"), 0)


def test_no_shuffle_before_the_lists(spark):
    docs = spark.range(0, 100, 1, 16).selectExpr("id as doc_id", "'a b' as text")
    plan = embedding.search(docs, ["a"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "CartesianProduct" not in plan
    assert "Exchange" not in embedding.bucket_counts(docs)._jdf.queryExecution().executedPlan().toString()
    assert embedding.bucket_counts(docs.coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
