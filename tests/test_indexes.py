import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import blockjoin, knn
from millrace.operators.ann import AnnIndex
from millrace.operators.metric import MetricIndex
from millrace.operators.nearest import nearest

ROWS = "id bigint, v array<double>"


def table(spark, m, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(m)], ROWS)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "rank", "id", "value").collect()))


def clustered(seed, n, width=3):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 6, (n, 1)) * 10.0 + rng.normal(size=(n, width))


@pytest.mark.parametrize(("pivots", "rings", "block", "others"), [(1, 1, 10_000, False), (7, 3, 16, True), (40, 8, 50, True), (12, 4, 1, False)])
def test_cells_like_nearest(spark, pivots, rings, block, others):
    m = clustered(pivots, 300)
    m[:100] = m[0]  # a third of the rows is one vector
    train = table(spark, m).union(table(spark, m[:3]))  # repeated ids
    asked = table(spark, m[::20]).union(table(spark, [[500.0, 0.0, 0.0], [0.5, 0.5, 0.5]], 9000))
    found = MetricIndex(train, pivots, rings, block).search(asked, 6, others)
    assert rows(found) == rows(nearest(asked, train, 6, others_only=others))


def test_cells_skip_rows(spark):
    m = clustered(3, 3000, 2)
    index = MetricIndex(table(spark, m), pivots=60)
    found = index.search(table(spark, m[::50]), 5, others_only=True)
    assert found.count() == 300
    seen = index.compared.agg(F.sum("rows")).first()[0]
    assert seen < 0.1 * 60 * 3000


def test_cells_edges(spark):
    none, one = table(spark, []), table(spark, [[1.0, 2.0]])
    assert MetricIndex(none).search(one, 3).count() == 0 and MetricIndex(one).search(none, 3).count() == 0
    assert rows(MetricIndex(one).search(one, 3)) == [(0, 1, 0, 0.0)] and MetricIndex(one).search(one, 3, others_only=True).count() == 0
    with pytest.raises(ValueError):
        MetricIndex(table(spark, [[1.0], [1.0, 2.0]]))
    with pytest.raises(ValueError):
        MetricIndex(one).search(one, 0)


def test_votes_of_repeated_ids(spark):
    train = spark.createDataFrame([(1, [1.0], "A"), (1, [1.1], "A"), (2, [1.2], "B"), (3, [1.3], "B"), (4, [1.4], "B"), (5, [9.0], "A")], "id bigint, v array<double>, label string")
    query = spark.createDataFrame([(0, [0.0])], ROWS)
    for cells in (None, 3):
        assert [tuple(r) for r in knn.classify(query, train, 5, cells=cells).collect()] == [(0, "B")]
    mixed = spark.createDataFrame([(1, [1.0], 7), (1, [1.0], 5), (1, [1.0], None)], "id bigint, v array<double>, label int")
    assert [tuple(r) for r in knn.classify(query, mixed, 1).collect()] == [(0, 5)]


def test_knn_by_cells_like_knn(spark):
    m = clustered(8, 400)
    train = table(spark, m).withColumn("label", (F.col("id") % 4).cast("int"))
    asked = table(spark, m[::7] + 0.01)
    assert sorted(map(tuple, knn.classify(asked, train, cells=20).collect())) == sorted(map(tuple, knn.classify(asked, train).collect()))


def test_many_queries_for_one_block(spark, monkeypatch):
    monkeypatch.setattr(blockjoin, "QUERIES", 10)
    m = np.zeros((200, 2))
    asked, train = table(spark, m, 1000), table(spark, m[:4])
    assert rows(MetricIndex(train, 2).search(asked, 3)) == rows(nearest(asked, train, 3))


def test_index_recall(spark):
    """Recall at 10 of queries with an id divisible by 50 against all rows, by brute force."""
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    asked = v.where("id % 50 = 0")
    exact = {(r.query_id, r.id) for r in nearest(asked, v, 10, others_only=True).collect()}
    index = AnnIndex(v, lists=32)
    assert index.rows.count() == v.count()
    found = {(r.query_id, r.id) for r in index.search(asked, 10, probe=20, depth=400, others_only=True).collect()}
    assert len(found) == len(exact) and len(found & exact) >= 0.9 * len(exact)


def test_index_with_all_lists_is_exact(spark):
    m = clustered(5, 500, 4)
    m[:150] = m[0]
    train, asked = table(spark, m), table(spark, m[::25])
    index = AnnIndex(train, lists=8, parts=2, block_rows=40)
    assert rows(index.search(asked, 5, probe=8, depth=500, others_only=True)) == rows(nearest(asked, train, 5, others_only=True))
    assert index.search(asked, 3, probe=1).count() == 20 * 3
    with pytest.raises(ValueError):
        AnnIndex(train, parts=3)
    assert AnnIndex(train.limit(0)).search(asked, 3).count() == 0
