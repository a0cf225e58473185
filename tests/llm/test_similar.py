import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import similar
from millrace.llm._shared import text_key


def plain_sets(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_pairs(texts):
    sets = [plain_sets(t) for t in texts]
    return [(i, j) for j in range(len(texts)) for i in range(j) if sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def plain_classes(n, pairs):
    root = list(range(n))
    for a, b in pairs:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    return {frozenset(i for i in range(n) if root[i] == r) for r in root}


def edited(rng, n, most):
    """A text and versions of it with some words changed."""
    base = [f"w{rng.randrange(5000)}" for _ in range(n)]
    yield " ".join(base)
    while True:
        made = list(base)
        for at in rng.sample(range(n), rng.randint(1, most)):
            made[at] = f"x{rng.randrange(10**6)}"
        yield " ".join(made)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = []
    for n, most, many in ((5, 1, 3), (40, 3, 12), (150, 6, 80), (400, 20, 25)):
        made = edited(rng, n, most)
        out += [next(made) for _ in range(many)]
    line = " ".join(f"l{i}" for i in range(30))
    out += [line + " " + " ".join(f"u{k}v{i}" for i in range(12)) for k in range(40)]
    return list(dict.fromkeys([*out, "", "a b", "a b c", "A b", "a\tb c"]))


def test_recall_like_brute_force(spark, texts):
    docs = spark.createDataFrame([(t,) for t in [*texts, *texts[:5], None]], "text string").repartition(3)
    keys = {r.t1: i for i, r in enumerate(spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(text_key(F.col("text"))[0]).collect())}
    links = [(keys[r.a], keys[r.b]) for r in similar.similar_links(docs).collect()]
    expected = plain_pairs(texts)
    assert {tuple(sorted(x)) for x in links} <= set(expected)
    assert plain_classes(len(texts), links) == plain_classes(len(texts), expected)
    assert any(len(c) > similar.LARGE for c in plain_classes(len(texts), expected))


def test_cells_like_pairs(monkeypatch):
    rng = random.Random(2)
    for columns in (1, 7, 2048):
        monkeypatch.setattr(similar, "_COLUMNS", columns)
        sets = [{b"%d" % rng.randrange(12) for _ in range(rng.randrange(9))} for _ in range(60)]
        at, to = similar.similar_cells(sets[:25], sets[25:], Fraction(4, 5))
        expected = {(i, j) for i in range(25) for j in range(35) if sets[i] | sets[25 + j] and similar.similar(sets[i], sets[25 + j], Fraction(4, 5))}
        assert set(zip(at.tolist(), to.tolist(), strict=True)) == expected


def test_shared_tokens_over_batches():
    rng = random.Random(5)
    for size in (1, 2, 3, 7, 100):
        rows = sorted((rng.randrange(12) * rng.choice([1, 1, 5]), rng.randrange(4)) for _ in range(60))
        table = pa.table({"token": [t for t, _ in rows], "id": [i for _, i in rows], "n": [9] * 60, "at": [1] * 60})
        found = [(r["token"], r["id"]) for b in similar._shared_tokens(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        ids = {}
        for t, i in rows:
            ids.setdefault(t, set()).add(i)
        assert sorted(found) == sorted((t, i) for t, x in ids.items() if len(x) > 1 for i in x)


@pytest.mark.parametrize("block", [2048, 20])
def test_chains_that_pivots_do_not_see(spark, monkeypatch, block):
    monkeypatch.setattr(similar, "BLOCK", block)
    # Texts in a row, each similar to the next only, in one bucket with many near copies of one of them.
    words = [f"c{i}" for i in range(400)]
    chain = [" ".join(["same", "old", "rare", "opening", "words"] * 3 + words[4 * i : 4 * i + 80]) for i in range(60)]
    rng = random.Random(3)
    near = [chain[30] + f" extra{rng.randrange(10**6)}" for _ in range(120)]
    texts = list(dict.fromkeys(chain + near))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    keys = {r.t1: i for i, r in enumerate(spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i").select(text_key(F.col("text"))[0]).collect())}
    links = [(keys[r.a], keys[r.b]) for r in similar.similar_links(docs).collect()]
    assert plain_classes(len(texts), links) == plain_classes(len(texts), plain_pairs(texts))


def test_stage_leaves_no_similar_pair(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert any(a != b for a, b in plain_pairs([r.text for r in docs.select("text").distinct().collect()]))
    kept = corpus_pipeline.simhash_near_dedup(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    assert not plain_pairs([r.text for r in kept.collect()])


def test_sketches_lose_no_similar_pair():
    rng = random.Random(8)
    for level in (Fraction(4, 5), Fraction(1, 2), Fraction(1, 10)):
        pool = np.array([rng.getrandbits(64) for _ in range(1500)], np.uint64).view(np.int64)
        bases = [rng.sample(range(1500), n) for n in (1, 3, 60, 130, 700)]
        sets = [sorted(set(rng.sample(b, max(1, len(b) - rng.randrange(1 + len(b) // 3))) + rng.sample(range(1500), rng.randrange(1 + len(b) // 9)))) for b in bases for _ in range(14)]
        sketches, n = [similar.sketch(pool[x]) for x in sets], np.array([len(x) for x in sets])
        label, asks = np.array([rng.randrange(40) for _ in sets]), np.array([rng.random() < 0.5 for _ in sets])
        kept = similar.sketched_cells(sketches, n, label, asks, level)
        near, far = 0, 0
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                alike = len(set(a) & set(b)) >= level * len(set(a) | set(b))
                may = similar.may_be_similar(sketches[i], sketches[j], int(n[i] + n[j]), level)
                assert may or not alike
                near, far = near + alike, far + (not may)
                assert not (alike and asks[i] and not asks[j] and label[i] != label[j]) or (kept[i] and kept[j])
        assert near > len(sets) and (far > 0 or level < Fraction(1, 2))


def test_texts_without_a_near_sketch_stay_where_they_are(spark, monkeypatch):
    """Long texts that share a rare opening, in large buckets, but little else: before, the bodies of all were fetched."""
    rng = random.Random(4)
    opening = " ".join(f"o{i}" for i in range(12))
    docs = spark.createDataFrame([(opening + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(40)),) for _ in range(90)], "text string")
    made, real = [], similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda df: made.append(real(df)) or made[-1])
    monkeypatch.setattr(similar, "drop_since", lambda *_: None)
    assert similar.similar_links(docs, similarity=0.3).count() == 0
    assert [df.count() for df in made if "body" in df.columns] == [0, 0, 0]
