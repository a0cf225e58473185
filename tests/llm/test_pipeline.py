from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import quality
from test_mixing import plain as plain_mix
from test_packing import check_rows
from test_simhash import plain_components, plain_fingerprint
from test_similar import plain_sets
from test_suffix_dedup import plain as plain_dedup

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    """Each stage's input and output as lists of rows."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
        out.append((docs, made))
        docs = made
    return out


def test_columns(steps):
    assert all(after.dtypes == steps[0][0].dtypes for _, after in steps[:-1])


def test_classifier_rejects_by_score(spark, steps, sf_dir):
    before, after = steps[0]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~corpus_pipeline.held_out("doc_id"))
    model = quality.fit(before, labels)
    assert Counter(after.collect()) == Counter(r for r in before.collect() if model.score(r.text.encode()) >= 0.5)


def plain_classes(ids, texts):
    """The least id of each row's class: links by three bits or fewer, or by a similarity of 0.8 of shingles of five words."""
    prints = [plain_fingerprint(t) for t in texts]
    least = plain_components(ids, prints)
    by_text = [plain_sets(t) for t in texts]
    for _ in ids:  # until nothing changes
        before = list(least)
        for i, a in enumerate(by_text):
            for j in range(i):
                b = by_text[j]
                if least[i] != least[j] and a and 5 * len(a & b) >= 4 * len(a | b):
                    low, high = sorted((least[i], least[j]))
                    least = [low if x == high else x for x in least]
        if least == before:
            return least


def test_one_of_each_class(steps):
    before, after = (x.collect() for x in steps[1])
    ids = [r.doc_id for r in before]
    least = plain_classes(ids, [r.text for r in before])
    assert Counter(after) == Counter(r for r, c in zip(before, least, strict=True) if r.doc_id == c)


def test_repeats_are_removed(steps):
    before, after = (sorted(x.collect(), key=lambda r: r.doc_id) for x in steps[2])
    for a, b, (_, removed, _, _) in zip(before, after, plain_dedup([r.text.encode() for r in before], 200), strict=True):
        assert (a.doc_id, a.lang, a.source) == (b.doc_id, b.lang, b.source) and b.n_chars == len(b.text)
        # Characters that lose some of their bytes stay whole: at most three bytes at each end of a run.
        assert len(a.text.encode()) - removed <= len(b.text.encode()) <= len(a.text.encode()) - removed + 6 * (removed // 200)


def test_mixture(steps):
    before, after = (x.select(*COLUMNS).collect() for x in steps[3])
    expected = Counter()
    for (i, text, source, _), n in plain_mix([tuple(r) for r in before], seed=17).items():
        expected[i, text, source] += n
    assert Counter((r.doc_id, r.text, r.source) for r in after) == expected


def test_packing(steps):
    before, after = (x.collect() for x in steps[4])
    check_rows(after, [(r.doc_id, r.text) for r in before], 2048)
    assert len({r.row for r in after}) == len(before) and len({(r.row, r.piece) for r in after}) == len(after)
    assert all(len(r.ids) == r.length for r in after)


def test_run_is_the_stages(spark, sf_dir, steps):
    pick = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
    def rows(df):
        return Counter((*r[:-1], tuple(r.ids)) for r in df.select(*pick).collect())

    assert rows(corpus_pipeline.run(spark, sf_dir)) == rows(steps[-1][1])


def test_odd_rows_and_names(spark, odd_docs, no_docs, sf_dir):
    for docs in (odd_docs, no_docs, odd_docs.withColumn("kept_kept", F.lit(1)).withColumn("millrace_score", F.lit(2))):
        kinds = docs.dtypes
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir))
            assert docs.dtypes == kinds
        assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= docs.count()
