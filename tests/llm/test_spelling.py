import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from millrace.llm import queries
from millrace.llm.spelling import near_words, one_lost, spelling_variants, variants, word_counts


def lower(run):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in run)


def counted(rows, every=None, min_length=6, min_count=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= min_length
    return {w: c for w, c in n.items() if c >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n, ratio=5):
    form, out = {}, []
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
        out.append((w, len(others)))
    rows = set()
    for w, k in out:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n[w], k, n[form[w]] if form[w] else None))
    return rows


def rows_of(df):
    found = df.select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len(found) == len({r.word for r in found})
    return set(map(tuple, found))


def test_chains_and_ties(spark):
    n = {"abcdef": 5, "abcdeg": 30, "abcdgg": 200, "abcggg": 9000, "zzzzzz": 7, "zzzzzy": 35, "zzzzzx": 35, "zzzzzzz": 35, "lonely": 6, "yenlol": 6, "fedcba": 400, "abcdefg": 24}
    made = rows_of(variants(spark.createDataFrame(list(n.items()), "word string, n bigint")))
    assert made == plain(n)
    by = {r[0]: r for r in made}
    assert by["abcdef"][1:3] == ("abcdeg", "abcggg") and by["zzzzzz"][1] == "zzzzzx" and by["lonely"] == ("lonely", None, "lonely", 6, 0, None)
    with pytest.raises(ValueError):
        variants(spark.createDataFrame(list(n.items()), "word string, n bigint"), ratio=1)


@pytest.mark.parametrize("letters", ["ab", "abcé", "aàÿ÷ñ"])
def test_generated_words(spark, letters):
    rng = random.Random(len(letters))
    n = {"".join(rng.choice(letters) for _ in range(rng.randint(2, 9))): rng.choice([5, 6, 30, 200, 1500]) for _ in range(250)}
    words = spark.createDataFrame(list(n.items()), "word string, n bigint")
    pairs = near_words(words).select("a", "b", "n_a", "n_b").collect()
    assert Counter(map(tuple, pairs)) == Counter((a, b, n[a], n[b]) for a in n for b in n if a < b and near(a, b))
    assert rows_of(variants(words)) == plain(n)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = [(r[0], r[1]) for r in odd_rows]
    for every in (None, 3):
        edit = one_lost(every) if every else None
        n = counted(rows, every)
        got = {r.word: r.n for r in word_counts(odd_docs, edit=edit).collect()}
        assert got == n and n
    few = {"min_length": 3, "min_count": 40}
    assert rows_of(spelling_variants(odd_docs, edit=one_lost(3), **few)) == plain(counted(rows, 3, 3, 40))
    empty = spelling_variants(no_docs)
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_query_on_a_whole_table(spark, sf_dir):
    con = duckdb.connect()
    rows = con.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    expected = plain(counted(rows, 199))
    assert rows_of(queries.op11_spelling(spark, sf_dir)) == expected
    assert any(r[1] for r in expected) and any(r[4] for r in expected)


def test_words_meet_by_key_and_half(spark):
    """Words that are orders of the same syllables share a key; few of them share a half too."""
    rng = random.Random(1)
    parts = ["an", "re", "on", "th", "er", "ing"]
    words = {"".join(rng.sample(parts, 6)) for _ in range(400)}
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n bigint")
    plan = near_words(table)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert near_words(table).count() == sum(near(a, b) for a in words for b in words if a < b)
