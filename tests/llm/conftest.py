import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows, other scripts."""
    rng = random.Random(3)
    passage, long = words(rng, 60), words(rng, 30_000)
    texts = [None, "", " ", "a", words(rng, 5), "ÄÖ ß 漢字 " * 40, long, "Und " * 500, passage, words(rng, 40) + passage + words(rng, 30), words(rng, 20) + "é" + passage + "é" + words(rng, 9), "x" * 5000, words(rng, 300), words(rng, 300)]
    texts += [texts[12]] * 3 + [texts[12] + " more"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*rows, rows[12], rows[1], (None, words(rng, 50), "en", "s1", 3), (None, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The odd rows with extra columns whose names operators use inside or return."""
    docs = spark.createDataFrame(odd_rows, SCHEMA)
    for name in ("score", "fp", "t1", "k1", "body", "id", "mix_copy", "mark", "key", "size", "shard", "slot", "n_bytes", "kept", "length", "piece", "spans", "verdict", "member", "millrace_key", "millrace_body", "rank"):
        from pyspark.sql import functions as F

        docs = docs.withColumn(name, F.lit("own"))
    return docs.repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
