import random
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from millrace.llm import simhash
from millrace.llm.queries import QUERIES


def plain_fingerprint(text):
    words = [w for w in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints):
    least = {i: i for i in range(len(ids))}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                least[root(i)] = root(j)
    lows = {}
    for i, x in enumerate(ids):
        if x is not None:
            lows[root(i)] = min(x, lows.get(root(i), x))
    return [lows.get(root(i)) for i in range(len(ids))]


def test_like_brute_force_on_odd_rows(spark, odd_docs, odd_rows):
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    expected = Counter(zip([r[0] for r in odd_rows], prints, plain_components([r[0] for r in odd_rows], prints), strict=True))
    got = Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(odd_docs).collect())
    assert got == expected


def test_query_like_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    prints = [plain_fingerprint(r.text) for r in rows]
    expected = {(r.doc_id, f"{p:016x}", c) for r, p, c in zip(rows, prints, plain_components([r.doc_id for r in rows], prints), strict=True)}
    assert {tuple(r) for r in QUERIES["op3_simhash"](spark, sf_dir).collect()} == expected


def test_links_are_complete(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 5))) for b in base for _ in range(6)]
    signed = [x - (1 << 64) if x >> 63 else x for x in {*base, *near}]
    links = simhash.hamming_links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    expected = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 3}
    assert {tuple(r) for r in links.distinct().collect()} == expected


def test_long_chains_have_one_root(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102)]
    got = dict(simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect())
    assert got == dict.fromkeys(range(41), 0) | dict.fromkeys(range(100, 103), 100)


def test_one_of_each_class_stays(spark, odd_docs, odd_rows):
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    numbered = plain_components(list(range(len(odd_rows))), prints)
    kept = simhash.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = kept.collect()
    assert len(rows) == len(set(numbered))
    assert Counter(plain_fingerprint(r.text) for r in rows).most_common(1)[0][1] == 1


def test_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.keep_one(no_docs).count() == 0
    assert simhash.hamming_links(no_docs.select(F.col("doc_id").alias("fp"))).count() == 0


def test_texts_are_dealt_out_once(spark, sf_dir):
    kept = simhash.keep_one(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kept.collect()
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("SortMergeJoin")]
