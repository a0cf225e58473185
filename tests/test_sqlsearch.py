import pytest

from millrace.operators import embedding
from millrace.plans import sqlsearch


def test_like_the_dataframe_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.createOrReplaceTempView("sqlsearch_docs")
    for query in ("the nation that is with the thing", "isn't it? \\ 'x'", "", "zzz"):
        made = sqlsearch.search(spark, "sqlsearch_docs", query, 7)
        plain = embedding.search(docs, [query], 7)
        assert [tuple(r) for r in made.orderBy("rank").collect()] == [tuple(r) for r in plain.select("rank", "doc_id", "score").orderBy("rank").collect()]


def test_edges(spark):
    sqlsearch.register(spark, "string")
    rows = spark.createDataFrame([("a", None), (None, "x y"), ("b", "")], "name string, body string")
    rows.createOrReplaceTempView("sqlsearch_rows")
    made = spark.sql(sqlsearch.search_sql("sqlsearch_rows", "x", 5, "name", "body"))
    assert made.columns == ["rank", "name", "score"] and made.count() == 3 and made.orderBy("rank").first().name is None
    rows.limit(0).createOrReplaceTempView("sqlsearch_none")
    assert spark.sql(sqlsearch.search_sql("sqlsearch_none", "x", 5, "name", "body")).count() == 0
    for call in ("TABLE(SELECT '1'), 'x', 3", "TABLE(SELECT '1', 'a'), 'x', 0", "1, 'x', 3"):
        with pytest.raises(Exception):  # noqa: B017
            spark.sql(f"SELECT * FROM text_search({call})").collect()
