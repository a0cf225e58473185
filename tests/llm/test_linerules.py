import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from millrace.llm import linerules
from millrace.llm.linerules import cleaned, line_rules, line_rules_sql, repeated_words

NAMES = "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed".split()


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    places = {p for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(places))
    return (*counts, len(words) < 20 or 100 * len(places) > 30 * len(words))


def verdicts(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    return [r.kept for r in line_rules(docs).orderBy("doc_id").collect()]


PROSE = "The river rose in the night and took the lower road with it. By morning two boats lay in the field.\nNobody had slept, and few had eaten; the mill stood."


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = line_rules(odd_docs, prefix="r_").select("text", *(f"r_{c}" for c in NAMES), "r_kept", "kept").collect()
    assert Counter((r[0], *r[1:7]) for r in rows) == Counter((x[1], *plain(x[1])) for x in odd_rows)
    assert all(r.kept == "own" for r in rows) and not any(r.r_kept for r in rows if not r.text)
    assert line_rules(no_docs).count() == 0 and "kept" in line_rules(no_docs).columns


def test_windows(spark):
    w = [f"w{i}" for i in range(12)]
    cases = {"once": w, "twice": w + w, "overlapping": ["a"] * 9, "seven": w[:7] + ["x"] + w[:7], "far": w[:8] + ["y", "z"] + w[2:10] + w[:8]}
    got = spark.createDataFrame(list(cases.items()), "k string, words array<string>").select("k", repeated_words(F.col("words")).alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: plain(" ".join(v))[4] for k, v in cases.items()}
    with pytest.raises(ValueError):
        repeated_words(F.col("words"), 6)


def test_lines(spark):
    menu = "Home | News | Sport | Weather | About us\n"
    shout = "THE!! RIVER!! ROSE!! IN!! THE!! NIGHT!! AND!! TOOK!! ALL!! ROADS!!\n"
    foot = "All Rights Reserved. Privacy Policy. Subscribe now to our letter.\n"
    table = "\n".join(f"cell{i} | value{i} | sum{i} |" for i in range(30))
    assert verdicts(spark, PROSE, PROSE + "\n" + menu + foot, shout + PROSE, table, menu * 3 + foot + table, None, "") == [True, True, True, False, False, False, False]
    assert verdicts(spark, PROSE + " " + " ".join(f"{w}***" for w in "one two three".split())) == [True]
    assert verdicts(spark, "\n".join(f"w{i}### x{i}&&& y{i}$$$ z{i}." for i in range(20))) == [False]
    assert verdicts(spark, "\n".join(f"item number {i} without a stop" for i in range(20))) == [False]


def test_clean_text_and_failures(spark):
    docs = spark.createDataFrame([(1, "Home | News | Sport | Weather\n\n" + PROSE + "\nClick here to read more.", "x")], "doc_id int, text string, judged string")
    row = line_rules(docs).first()
    assert row.clean_text == "\n" + PROSE and row.failures == {"boilerplate": 1, "navigation": 1, "marks": 0, "unended": 0}
    assert (row.n_lines, row.n_lines_removed, row.judged) == (4, 2, "x")
    kept = cleaned(docs)
    assert kept.columns == docs.columns and kept.first().text == "\n" + PROSE


def test_rules_of_ones_own(spark):
    docs = spark.createDataFrame([(1, PROSE)], "doc_id int, text string")
    rule = {"rivers": linerules.Rule(lambda line: F.contains(line, F.lit("river")))}
    row = line_rules(docs, rule).first()
    assert row.failures == {"rivers": 1} and row.clean_text == PROSE.split("\n")[1] and not row.kept


def test_no_python_and_no_shuffle(spark, sf_dir):
    plan = line_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_like_sql(spark, odd_docs, sf_dir, tmp_path):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate(["Home » News » Sport » Weather. " * 3, "x\r\n\x0b\nA b c. D\x0ce f!", "Use Cookies " * 9, "Ein Satz… und „noch“ einer.\n" * 30, "w " * 40 + "."])], "doc_id bigint, text string")
    path = str(tmp_path / "d")
    odd_docs.select("doc_id", "text").union(extra).write.parquet(path)
    names = [*NAMES, "n_lines", "n_lines_removed", "lost_chars", "kept"]
    for where in (f"{path}/*.parquet", f"{sf_dir}/documents.parquet"):
        got = Counter(map(tuple, line_rules(spark.read.parquet(where)).select("doc_id", *names).collect()))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}'")
        assert got == Counter(con.sql(f"SELECT doc_id, {', '.join(names)} FROM ({line_rules_sql()})").fetchall())


def test_labelled_documents(spark):
    """Of documents that pass the base no good one is rejected, and nearly all bad ones are."""
    made = line_rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("not base_failed")
    found = made.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in found}
    assert n.get((1, False), 0) == 0 and n.get((0, True), 0) <= 0.05 * n[(0, False)]
