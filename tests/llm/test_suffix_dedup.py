import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffix_dedup as sd
from millrace.llm.queries import QUERIES


def plain(texts, width):
    """Bytes, bytes removed, runs and digest of each text, and the covered places."""
    starts = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - width + 1):
            if starts[t[i : i + width]] > 1:
                covered[i : i + width] = b"\1" * width
        runs = sum(covered[i] and (i == 0 or not covered[i - 1]) for i in range(len(t)))
        left = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        out.append((len(t), sum(covered), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("letters", [1, 2, 4, 256])
def test_suffix_array_like_sorting(letters):
    rng = np.random.default_rng(letters)
    for n in (*range(1, 12), 100, 700):
        text = rng.integers(0, letters, n).astype(np.uint8)
        body = text.tobytes()
        order = sd.suffix_array(text, n)
        assert order.tolist() == sorted(range(n), key=lambda i: body[i:])
        cap = max(1, n // 3)
        order = order[order <= n - cap]
        prefixes = sd.adjacent_prefixes(text, order, cap)
        for j in range(1, len(order)):
            a, b = body[order[j - 1] : order[j - 1] + cap], body[order[j] : order[j] + cap]
            assert prefixes[j] == next((i for i in range(cap) if a[i] != b[i]), cap)


@pytest.mark.parametrize(("width", "heavy"), [(200, 1024), (200, 1), (50, 1), (7, 2), (1, 1)])
def test_like_brute_force_on_odd_rows(spark, odd_docs, odd_rows, width, heavy):
    short = [r for r in odd_rows if len(r[1] or "") < 6000]
    docs = odd_docs.where("text is null or length(text) < 6000")
    expected = Counter((r[0], *x) for r, x in zip(short, plain([(r[1] or "").encode() for r in short], width), strict=True))
    made = sd.deduplicate(docs, width=width, heavy=heavy, block=3000, keep_text=True)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in made.collect())
    assert got == expected


def test_query_like_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    expected = {(r.doc_id, *x) for r, x in zip(rows, plain([r.text.encode() for r in rows], 200), strict=True)}
    assert {tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, sf_dir).collect()} == expected


def test_random_repeats_with_few_letters(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for width, heavy in ((12, 3), (20, 1)):
        expected = {(i, *x) for i, x in enumerate(plain([t.encode() for t in texts], width))}
        assert {tuple(r) for r in sd.deduplicate(docs, width=width, heavy=heavy).collect()} == expected


def test_parts_of_long_texts(monkeypatch):
    rng = np.random.default_rng(2)
    text = rng.integers(0, 3, 5000).astype(np.uint8).tobytes()
    monkeypatch.setattr(sd, "_CHUNK", 300)
    seen = [(int(a), int(a + n)) for _, first, many in sd.segments(text, 40, 7) for a, n in zip(first, many, strict=True)]
    assert seen[0][0] == 0 and seen[-1][1] == 5000 - 39
    assert all(a[1] == b[0] for a, b in zip(seen, seen[1:], strict=False))


def test_characters_stay_whole():
    text = "aéb漢c".encode()
    covered = np.array([0, 0, 1, 1, 1, 1, 1, 0], bool)  # half of é, b, all of 漢
    assert sd.whole_characters(text, covered) == "aéc"


def test_empty_table(no_docs):
    assert sd.deduplicate(no_docs, keep_text=True).count() == 0
