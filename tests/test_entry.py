"""Every query with SQL against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from millrace.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations clicks sales sale_lines clients client_changes vendors items stamps".split()


def text(row):
    return tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in row)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_like_duckdb(spark, sf_dir, duck, name):
    rows = entry.queries()[name](spark, sf_dir)
    columns = sorted(rows.columns)
    answer = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    expected = sorted(text(r[names.index(c)] for c in columns) for r in answer.fetchall())
    assert sorted(names) == columns
    assert sorted(text(r) for r in rows.select(*columns).collect()) == expected


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_names():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_corpus_operators():
    top = Path(__file__).parent.parent / "millrace"
    for path in top.rglob("*.py"):
        if "llm" not in path.relative_to(top).parts:
            assert "llm" not in path.read_text(), path


def test_rows_without_sql(spark, sf_dir):
    rows = QUERIES["ann_search"](spark, sf_dir)
    assert rows.count() == 10 * rows.select("query_id").distinct().count() > 0
