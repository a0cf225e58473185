"""Hashed bag-of-words vectors, and search by them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import DIMENSIONS, bag, bag_cosine, bag_dot, bag_squares, bag_weights, dense
from millrace.functions.vectors import cosine, doubles, norm
from millrace.operators.nearest import positive, ranked
from millrace.operators.tables import spread


def _entries(docs: DataFrame, id_col: str, text_col: str, bag_of, names: Sequence[str]) -> DataFrame:
    # Outer, since Spark guards an inner generator by a filter that would make the bag once more.
    rows = spread(docs.select(id_col, text_col)).select(id_col, F.inline_outer(bag_of))
    return rows.where(F.col("bucket").isNotNull()).select(id_col, *names)


def bucket_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = DIMENSIONS) -> DataFrame:
    """``id_col``, ``bucket`` and ``n``: one row for each bucket that a document's words fall into."""
    return _entries(docs, id_col, text_col, bag(F.col(text_col), dim), ["bucket", "n"])


def bucket_weights(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = DIMENSIONS) -> DataFrame:
    """``id_col``, ``bucket`` and ``weight``, the count over the document's norm."""
    return _entries(docs, id_col, text_col, bag_weights(F.col(text_col), dim), ["bucket", "weight"])


def embed(docs: DataFrame, text_col: str = "text", dim: int = DIMENSIONS, name: str = "embedding") -> DataFrame:
    """``docs`` with the vector of each text; texts without words, and null ones, have the zero vector."""
    own = [c for c in docs.columns if c != name]
    counted = spread(docs).select(*own, bag(F.col(text_col), dim).alias("_bag"))
    rooted = counted.withColumn("_root", F.sqrt(bag_squares(F.col("_bag")).cast("double")))
    return rooted.select(*own, dense(F.col("_bag"), F.col("_root"), dim).alias(name))


def search(docs: DataFrame, queries: Sequence[str], k: int, id_col: str = "doc_id", text_col: str = "text", dim: int = DIMENSIONS) -> DataFrame:
    """``query_id``, ``rank``, ``id_col`` and ``score`` of the k texts most like each query, best first.

    The score is the cosine similarity of the bags, computed from whole numbers;
    ties go to the larger id, and without common words it is 0.  Queries become
    maps in the plan, so documents are scored where they are read, and each
    task's best k are all that is shuffled.
    """
    positive(k)
    if not queries:
        return docs.sparkSession.createDataFrame([], f"query_id int, rank int, {id_col} bigint, score double")
    spark = docs.sparkSession
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "i int, q string").select("i", bag(F.col("q"), dim).alias("bag")).collect()
    bags = {r.i: {x["bucket"]: x["n"] for x in r.bag} for r in asked}
    rows = spread(docs.select(id_col, text_col)).select(id_col, bag(F.col(text_col), dim).alias("bag")).withColumn("squares", bag_squares(F.col("bag")))
    scores = []
    for i in range(len(queries)):
        pairs = [F.lit(x) for b, n in bags[i].items() for x in (b, n)]
        weights = (F.create_map(*pairs) if pairs else F.create_map()).cast("map<int,bigint>")
        squares = F.lit(sum(n * n for n in bags[i].values())).cast("bigint")
        scores.append(F.struct(F.lit(i).alias("query_id"), bag_cosine(bag_dot(F.col("bag"), weights), F.col("squares"), squares).alias("score")))
    scored = rows.select(id_col, F.inline(F.array(*scores)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc(id_col))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def search_vectors(rows: DataFrame, query: Sequence[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k vectors most like ``query`` by cosine similarity, with ``score`` and ``rank``; ties go to the larger id."""
    positive(k)
    wanted = F.array(*(F.lit(float(x)) for x in query))
    v = doubles(F.col(vector_col))
    scored = rows.select(id_col, cosine(v, wanted, norm_b=norm(wanted)).alias("score"))
    return ranked(scored, "score", id_col, k).select("rank", id_col, "score")
