import hashlib
import random
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import queries
from millrace.llm.branches import DELETE, REPLACE, line_operations, merge_added, merge_tables

COUNTS = ["n_clean", "n_edit_edit", "n_edit_delete", "n_insert_insert"]


def code(branch, doc, name):
    return zlib.crc32(f"{branch}:{'' if doc is None else doc}:{name}".encode()) % 17


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def state(branch, doc, lang, source, lines):
    """Column values, lines (None: dropped) and gaps of a branch."""
    ends = {1: "!", 2: "?"}
    values = ["" if (c := code(branch, doc, n)) == 0 else v + ends.get(c, "") for n, v in (("lang", lang), ("source", source))]
    codes = [code(branch, doc, i) for i in range(len(lines))]
    return values, [None if c == 0 else x + ends.get(c, "") for c, x in zip(codes, lines, strict=True)], [{3: "!", 4: "?"}.get(c) for c in codes]


def whole(lines, gaps):
    return "\n".join(x for pair in zip(lines, gaps, strict=True) for x in pair if x is not None)


def plain(rows):
    out, added = [], {"L": {}, "R": {}}
    for doc, text, lang, source in rows:
        lang, source, lines = lang or "", source or "", (text or "").split("\n")
        base = ([lang, source], lines, [None] * len(lines))
        l, r = (state(b, doc, lang, source, lines) for b in "LR")
        for b, first in (("L", -1), ("R", -5)):
            if code(b, doc, "row") in (3, 4):
                at, row = None if doc is None else first - doc, (lang, source, "!" if code(b, doc, "row") == 3 else "?")
                added[b][at] = min(row, added[b].get(at, row))
        gone = [code(b, doc, "row") == 0 for b in "LR"]
        if any(gone):
            stays = None if all(gone) else (l, r)[gone[0]]
            clash = stays is not None and stays != base
            n = [int(not clash), 0, int(clash), 0]
            out.append((doc, *l[0], sha(whole(*l[1:])), *n) if clash and gone[1] else (doc, None, None, None, *n))
            continue
        n, merged = [0] * 4, ([], [], [])
        for k in range(3):
            for old, a, b in zip(base[k], l[k], r[k], strict=True):
                merged[k].append(b if a == old else a)
                if a != old and b != old and a != b:
                    n[3 if k == 2 else 2 if k == 1 and None in (a, b) else 1] += 1
                elif a != old or b != old:
                    n[0] += 1
        out.append((doc, *merged[0], sha(whole(*merged[1:])), *n))
    for doc in {**added["L"], **added["R"]}:
        l, r = added["L"].get(doc), added["R"].get(doc)
        clash = l is not None and r is not None and l != r
        row = l or r
        out.append((doc, row[0], row[1], sha(row[2]), int(not clash), 0, 0, int(clash)))
    return Counter(out)


def got(df):
    return Counter(map(tuple, df.select("doc_id", "lang", "source", "text_sha256", *COUNTS).collect()))


def run(spark, docs, folder):
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    return queries.op12_branches(spark, str(folder))


def test_odd_rows(spark, odd_docs, odd_rows, no_docs, tmp_path):
    assert got(run(spark, odd_docs, tmp_path / "a")) == plain([r[:4] for r in odd_rows])
    assert run(spark, no_docs, tmp_path / "b").count() == 0


def test_many_small_documents_and_sql(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, rng.choice([None, "", "a", "\n", "a\nb\n\nb", "x\r\ny", "é\n漢\n" * 3]), rng.choice([None, "", "en", "e!"]), rng.choice([None, "s1", "s1", "?"])) for i in range(3000)]
    rows += [(None, "a\nb", "en", "s"), (7, "again", "de", "t"), (rows[9]), (-3, "base has this id", "en", "s")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    found = got(run(spark, docs, tmp_path))
    assert found == plain(rows)
    assert all(sum(r[k] * n for r, n in found.items()) > 20 for k in range(4, 8))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    answer = con.execute(f"SELECT doc_id, lang, source, text_sha256, {', '.join(COUNTS)} FROM ({queries.OP12_SQL})").fetchall()
    assert Counter(answer) == found


def test_given_table(spark, sf_dir):
    rows = duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{sf_dir}/documents.parquet'").fetchall()
    made = queries.op12_branches(spark, sf_dir)
    assert got(made) == plain(rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Broadcast" not in plan and "SinglePartition" not in plan and plan.count("Exchange") == 1


def apply(old, ops, gaps):
    out = list(gaps[0])
    for x, (op, line), gap in zip(old, ops, gaps[1:], strict=True):
        out += ([] if op == DELETE else [line if op == REPLACE else x]) + gap
    return out


def test_line_operations_make_the_branch():
    rng = random.Random(2)
    for _ in range(400):
        old, new = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 9))] for _ in range(2))
        assert apply(old, *line_operations(old, new)) == new
    ops, gaps = line_operations(list("abcdef"), list("aXcdYZef"))
    assert [o for o, _ in ops] == ["retain", REPLACE, "retain", "retain", "retain", "retain"] and gaps[4] == ["Y", "Z"]
    many = [str(i) for i in range(60_000)]
    ops, gaps = line_operations(many, [x for x in many if int(x) % 7] + ["end"])
    assert sum(o == DELETE for o, _ in ops) == len(range(0, 60_000, 7)) and gaps[-1] == ["end"]


def test_merge_of_tables(spark):
    schema = "doc_id int, text string, lang string, source string, op string"
    base = [(1, "a\nb\nc", "en", "s", "x"), (2, "a\nb", "en", "s", "x"), (3, "q", "en", None, "x"), (4, "k", "en", "s", "x"), (5, None, "en", "s", "x")]
    left = [(1, "a\nB\nc\nd", "en", "s", "x"), (2, "a\nL", "en", "s", "x"), (4, "k", "en", "s", "x"), (5, None, "de", "s", "x"), (8, "new", "en", "s", "x"), (9, "one", "en", "s", "x")]
    right = [(1, "0\na\nb\nC", "fr", "s", "x"), (2, "a\nR", "en", "s", "x"), (3, "q!", "en", None, "x"), (5, "", "es", "s", "x"), (9, "two", "en", "s", "x")]
    made = merge_tables(*(spark.createDataFrame(t, schema) for t in (base, left, right)))
    rows = {r.doc_id: tuple(r)[1:] for r in made.select("doc_id", "text", "lang", *COUNTS).collect()}
    assert rows[1] == ("0\na\nB\nC\nd", "fr", 5, 0, 0, 0)
    assert rows[2] == ("a\nL", "en", 0, 1, 0, 0)
    assert rows[3] == (None, None, 0, 0, 1, 0) and rows[4] == (None, None, 1, 0, 0, 0)
    assert rows[5] == ("", "de", 0, 1, 0, 0)
    assert rows[8] == ("new", "en", 1, 0, 0, 0) and rows[9] == ("one", "en", 0, 0, 0, 1)
    same = merge_tables(*[spark.createDataFrame(base, schema)] * 3).agg(*(F.sum(c) for c in COUNTS)).first()
    assert tuple(same) == (0, 0, 0, 0)


@pytest.mark.parametrize("hot", [2000])
def test_an_id_that_is_added_often(spark, hot):
    rows = spark.createDataFrame([(7, f"l{i}", "s", "t") for i in range(hot)], "doc_id int, lang string, source string, text string")
    assert [tuple(r) for r in merge_added(rows, rows.limit(0)).collect()] == [(7, "l0", "s", "t", 1, 0, 0, 0)]
