import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.queries import QUERIES


def hashed(words, k):
    """The hash of every k-gram of bytes, plainly."""
    mask, out = (1 << 64) - 1, []
    for i in range(len(words) - k + 1):
        out.append(sum((b + 1) * pow(quality._MUL, j, 1 << 64) for j, b in enumerate(words[i : i + k])) & mask)
    return out


def test_features_like_a_plain_version():
    text = b"ab ab cd, \xc3\xa9\n\tab"
    words = text.split()
    got = [x.tolist() for x in quality.features(text)]
    whole = [hashed(w, len(w))[0] for w in words]
    expected = [quality._buckets(np.array(whole, np.uint64), 1).tolist()]
    pairs = [(b * 31 + a) & (1 << 64) - 1 for a, b in zip(whole, whole[1:], strict=False)]
    expected.append(quality._buckets(np.array(pairs, np.uint64), 2).tolist())
    expected.append(quality._buckets(np.zeros(1, np.uint64), 3).tolist() * 1)
    expected += [quality._buckets(np.array(hashed(text, k), np.uint64), 3 + k).tolist() for k in quality.NGRAMS]
    assert got == expected


def test_odd_texts_have_scores():
    model = quality.train([(1, *quality.feature_counts(b"good words here")), (0, *quality.feature_counts(b"BAD!! BAD!!"))])
    for text in (b"", b" ", b"x", b"\xff" * 10, b"word " * 300_000, b"y" * (3 << 18)):
        assert 0 <= model.score(text) <= 1
    assert model.score(b"good words") > model.score(b"BAD!! BAD!!")
    assert quality.train([]).score(b"") == 0.5


def test_parts_of_long_texts(monkeypatch):
    monkeypatch.setattr(quality, "_CHUNK", 100)
    text = b"some words and more " * 50 + b"z" * 350 + b" end"
    assert b"".join(quality._chunks(text)) == text and max(map(len, quality._chunks(text))) <= 100


def test_rows_keep_their_columns(spark, odd_docs, odd_rows):
    labels = spark.createDataFrame([(r[0], i % 2, None) for i, r in enumerate(odd_rows)] + [(None, 1, 1), (4, None, 0), (5, 7, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(odd_docs, labels, sample_rows=8)
    rows = quality.score(odd_docs, model)
    assert rows.columns == [*(c for c in odd_docs.columns if c != "score"), "score"]
    made = rows.collect()
    assert len(made) == len(odd_rows) and all(0 <= r.score <= 1 for r in made)
    by_text = {}
    for r in made:
        assert by_text.setdefault(r.text or "", r.score) == r.score
    other = quality.score(odd_docs, model, name="p")
    assert other.columns == [*odd_docs.columns, "p"]


def test_labels_of_the_held_out_fold_and_ids_do_not_matter(spark, sf_dir, tmp_path):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    docs.withColumn("lang", F.lit("?")).withColumn("source", F.lit("?")).write.parquet(str(tmp_path / "documents.parquet"))
    labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(str(tmp_path / "labels.parquet"))
    a = {r.doc_id: r for r in QUERIES["op10_quality"](spark, sf_dir).collect()}
    b = {r.doc_id: r for r in QUERIES["op10_quality"](spark, str(tmp_path)).collect()}
    assert a == b
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for i, r in a.items())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op10_quality"](spark, folder).collect() if r.held_out and r.doc_id in labels]
    good, bad = ([r.score for r in rows if labels[r.doc_id] == x] for x in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.97
    assert np.mean([r.predicted == labels[r.doc_id] for r in rows]) > 0.93
    assert np.mean([s >= 0.5 for s in good]) > 0.97


def test_empty_tables(spark, no_docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.fit(no_docs, labels)
    assert quality.score(no_docs, model).count() == 0 and model.score(b"x") == 0.5


def test_sample_is_bounded(spark):
    rng = random.Random(0)
    docs = spark.createDataFrame([(i, f"text {rng.random()}") for i in range(50)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    assert isinstance(quality.fit(docs, labels, sample_rows=10), quality.QualityModel)


def test_sample_is_drawn_from_joined_rows(spark):
    docs = spark.createDataFrame([(i, f"word{i} good text {i % 3}") for i in range(8)] + [(3, "another text")] * 3, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id bigint, quality int")
    absent = spark.createDataFrame([(i, 1) for i in range(1000, 3000)], "doc_id bigint, quality int")
    whole = quality.fit(docs, labels, sample_rows=11)
    more = quality.fit(docs, labels.union(absent), sample_rows=11)
    assert (whole.odds == more.odds).all() and whole.bias == more.bias
    first = quality.fit(docs.repartition(1), labels, sample_rows=6)
    assert all((first.odds == quality.fit(docs.repartition(n), labels, sample_rows=6).odds).all() for n in (3, 5))


def plain_features(text):
    """Buckets with how often each is met, one string after the other."""
    mask, count = (1 << 64) - 1, {}

    def add(value, kind):
        x = (value + (kind * 0x632BE59BD9B4E019 & mask)) * 0xD6E8FEB86659FD93 & mask
        x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & mask
        key = x >> 64 - quality.BUCKET_BITS
        count[key] = count.get(key, 0) + 1

    def value(b):
        return sum((c + 1) * pow(quality._MUL, j, 1 << 64) for j, c in enumerate(b)) & mask

    words = [value(w) for w in text.split()]
    for w in words:
        add(w, 1)
    for a, b in zip(words, words[1:], strict=False):
        add((b * 31 + a) & mask, 2)
        if a == b:
            add(0, 3)
    for k in quality.NGRAMS:
        for i in range(len(text) - k + 1):
            add(value(text[i : i + k]), 3 + k)
    return count


def plain_train(examples, epochs, rate, seed):
    """The same descent with full vectors of shares, entry by entry."""
    rng = np.random.default_rng(seed)
    size = 1 << quality.BUCKET_BITS
    vectors, layer = rng.uniform(-0.5, 0.5, (size, quality.DIMENSIONS)), np.zeros((2, quality.DIMENSIONS))
    bias = [np.log(1 + sum(label == c for label, _ in examples)) for c in (0, 1)]
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, shares = examples[i]
            lr = rate * (1 - done / (epochs * len(examples)))
            done += 1
            mean = sum(s * vectors[b] for b, s in shares.items())
            logits = [float(layer[c] @ mean) + bias[c] for c in (0, 1)]
            p = [np.exp(x - max(logits)) for x in logits]
            wrong = [p[c] / sum(p) - (c == label) for c in (0, 1)]
            pull = wrong[0] * layer[0] + wrong[1] * layer[1]
            for c in (0, 1):
                layer[c] = layer[c] - lr * wrong[c] * mean
            squares = sum(s * s for s in shares.values())
            for b, s in shares.items():
                vectors[b] = vectors[b] - lr / 4 * s / squares * pull
    return vectors, layer, bias


def test_scores_like_a_plain_version(spark):
    texts = ["a good text it is", "bad bad bad", "one more good text", "bad bad text bad bad", "so good", "\u00e9t\u00e9 bon"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int("bad" not in t)) for i, t in enumerate(texts)], "doc_id bigint, quality int")
    order = [r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    made = {i: plain_features(t.encode()) for i, t in enumerate(texts)}
    shares = {i: {b: n / sum(c.values()) for b, n in c.items()} for i, c in made.items()}
    vectors, layer, bias = plain_train([(int("bad" not in texts[i]), shares[i]) for i in order], quality.EPOCHS, quality.RATE, 7)
    for r in quality.score(docs, quality.fit(docs, labels)).collect():
        mean = sum(s * vectors[b] for b, s in shares[r.doc_id].items())
        plain = 1 / (1 + np.exp(-(float((layer[1] - layer[0]) @ mean) + bias[1] - bias[0])))
        assert abs(plain - r.score) < 1e-5


def test_bytes_to_the_driver_are_bounded(spark, monkeypatch):
    texts = ["long " + " ".join(f"w{j}" for j in range(500 if i == 2 else 5)) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    taken = []
    monkeypatch.setattr(quality, "train", lambda examples: taken.append(examples))
    sizes = {i: 8 * len(quality.feature_counts(t.encode())[0]) for i, t in enumerate(texts)}
    quality.fit(docs, labels, sample_bytes=sizes[0] * 4)
    assert len(taken[0]) >= 3 and sum(8 * len(b) for _, b, _ in taken[0]) <= sizes[0] * 4 < sizes[2]
    quality.fit(docs, labels)
    assert len(taken[1]) == 12
