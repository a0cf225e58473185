"""Classification by the nearest training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import linspace
from millrace.operators.metric import MetricIndex
from millrace.operators.nearest import nearest

DEFAULT_K = 5


def vote(neighbours: DataFrame, label_col: str = "label") -> DataFrame:
    """``query_id`` and the most frequent label, which keeps its type; ties go to the smallest."""
    return neighbours.groupBy("query_id").agg(F.mode(label_col, True).alias(label_col))


def classify(queries: DataFrame, train: DataFrame, k: int = DEFAULT_K, others_only: bool = False, cells: int | None = None) -> DataFrame:
    """``query_id`` and ``label`` by a vote of the k nearest rows of ``train(id, v, label)``; of all rows if there are fewer.

    Each row has one vote, also where ids are repeated.  With ``cells`` the
    rows are in so many cells of an index, of which a query sees only those
    that can hold a neighbour; the result is the same.
    """
    if not train.limit(1).count():
        raise ValueError("there are no training rows")
    if cells:
        return vote(MetricIndex(train, cells, carry="label").search(queries, k, others_only))
    return vote(nearest(queries, train, k, "euclidean", others_only, carry="label"))


def bounds(points: DataFrame, x: str = "x", y: str = "y", padding: float = 1.5) -> tuple[float, float, float, float]:
    """x_min, x_max, y_min and y_max of the points, widened by ``padding``."""
    r = points.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if r[0] is None:
        raise ValueError("there are no points")
    return r[0] - padding, r[1] + padding, r[2] - padding, r[3] + padding


def grid(spark, x: tuple[float, float, int], y: tuple[float, float, int]) -> DataFrame:
    """``gi``, ``gj``, ``gx`` and ``gy`` of a grid, x fastest; each axis is first, last and number."""
    (x0, x1, nx), (y0, y1, ny) = x, y
    cells = spark.range(nx * ny)
    rows = cells.select(F.col("id"), (F.col("id") / nx).cast("int").alias("gi"), (F.col("id") % nx).cast("int").alias("gj"))
    return rows.select("id", "gi", "gj", linspace(F.col("gj"), x0, x1, nx).alias("gx"), linspace(F.col("gi"), y0, y1, ny).alias("gy"))


def classify_grid(train: DataFrame, x: tuple[float, float, int], y: tuple[float, float, int], k: int = DEFAULT_K) -> DataFrame:
    """``gi``, ``gj`` and ``label`` at every point of a grid; ``train`` has id, v of width 2, and label."""
    points = grid(train.sparkSession, x, y)
    labels = classify(points.select("id", F.array("gx", "gy").alias("v")), train, k)
    return points.join(labels, points["id"] == labels["query_id"]).select("gi", "gj", "label")
