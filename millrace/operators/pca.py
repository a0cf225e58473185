"""Principal components from a distributed covariance matrix.

Means and centred products are summed where the rows are; the driver only gets
numbers of the order of the width squared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import doubles, linspace, total

MOST_COLUMNS = 4096


def means(rows: DataFrame, vector_col: str = "v") -> DataFrame:
    """``pos`` and ``mean`` of each component."""
    return rows.select(F.posexplode(doubles(F.col(vector_col))).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("mean"))


def group_means(rows: DataFrame, key: str, vector_col: str = "v") -> DataFrame:
    """``key``, ``pos`` and ``mean`` of each component in each group."""
    return rows.select(key, F.posexplode(doubles(F.col(vector_col))).alias("pos", "x")).groupBy(key, "pos").agg(F.avg("x").alias("mean"))


def _mean_vector(rows: DataFrame, vector_col: str) -> list[float]:
    found = means(rows, vector_col).orderBy("pos").limit(MOST_COLUMNS + 1).collect()
    if len(found) > MOST_COLUMNS:
        raise ValueError(f"more than {MOST_COLUMNS} components")
    return [r["mean"] for r in found]


def _products(rows: DataFrame, vector_col: str, mean: list[float]) -> DataFrame:
    """``i``, ``s`` (the ``i``-th row of the sum of centred products) and ``n``, one row for each component."""
    centre, width = np.array(mean, float), len(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, n = np.zeros((width, width)), 0
        for batch in batches:
            flat = np.asarray(batch.column(0).flatten())
            if len(flat) != width * batch.num_rows:
                raise ValueError("vectors of unequal width")
            x = flat.reshape(-1, width) - centre
            gram += x.T @ x
            n += len(x)
        if n:
            ends = pa.array(np.arange(0, width * width + 1, width), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), pa.ListArray.from_arrays(ends, pa.array(gram.ravel())), pa.array(np.full(width, n), pa.int64())], ["i", "s", "n"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come in the order of their rows, so that one row's sum is held at a time."""
        at, total, n = None, None, 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([total], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["i", "s", "n"])

        for batch in batches:
            for i, part, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if i != at and at is not None:
                    yield row()
                if i != at:
                    at, total, n = i, np.zeros(width), 0
                total, n = total + np.asarray(part.values), n + m
        if at is not None:
            yield row()

    kind = "i int, s array<double>, n bigint"
    parts = rows.select(doubles(F.col(vector_col)).alias("v")).mapInArrow(run, kind)
    return parts.repartition("i").sortWithinPartitions("i").mapInArrow(added, kind)


def covariance(rows: DataFrame, vector_col: str = "v", mean: list[float] | None = None) -> DataFrame:
    """``i``, ``j`` and sample covariance ``value`` of all pairs of components, in two passes; none for fewer than two rows.

    A task hands on one row of sums for each component, not one for each pair.
    """
    mean = _mean_vector(rows, vector_col) if mean is None else mean
    sums = _products(rows, vector_col, mean).where("n > 1")
    return sums.select("i", "n", F.posexplode("s").alias("j", "s")).select("i", "j", (F.col("s") / (F.col("n") - 1)).alias("value"))


@dataclass(frozen=True)
class PcaModel:
    """Components as rows, the mean, and each component's share of the variance."""

    components: list[list[float]]
    mean: list[float]
    shares: list[float]

    def scores(self, v: Column) -> Column:
        """The centred vector's coordinates along the components."""
        centred = F.zip_with(doubles(v), F.array(*map(F.lit, self.mean)), lambda x, m: x - m)
        return F.array(*(total(F.zip_with(centred, F.array(*map(F.lit, c)), lambda x, w: x * w)) for c in self.components))

    def restored(self, scores: Column) -> Column:
        """The vector that the scores stand for."""
        return F.array(*(sum((F.element_at(scores, k + 1) * c[i] for k, c in enumerate(self.components)), F.lit(m)) for i, m in enumerate(self.mean)))


def fit(rows: DataFrame, k: int, vector_col: str = "v") -> PcaModel:
    """The first k components, or as many as there are.

    A component's largest coefficient, the first of equal ones, is positive.
    One row or none, and rows without any variance, are errors.
    """
    if k < 1:
        raise ValueError("k must be positive")
    n, mean = rows.count(), _mean_vector(rows, vector_col)
    if n < 2:
        raise ValueError("components need two rows or more")
    matrix = np.zeros((len(mean), len(mean)))
    sums = _products(rows, vector_col, mean).toArrow()  # a row for each component
    for i, s in zip(sums.column("i").to_pylist(), sums.column("s"), strict=True):
        matrix[i] = np.asarray(s.values) / (n - 1)
    values, vectors = np.linalg.eigh(matrix)
    if values[-1] <= 0:
        raise ValueError("the rows have no variance")
    k = min(k, n, len(mean))
    chosen = vectors[:, ::-1].T[:k]
    chosen = [c * np.sign(c[np.argmax(np.round(np.abs(c), 12))]) for c in chosen]
    return PcaModel([[float(x) for x in c] for c in chosen], mean, [float(x) for x in (values[::-1] / values.sum())[:k]])


def project(rows: DataFrame, model: PcaModel, id_col: str, vector_col: str = "v") -> DataFrame:
    """``id_col`` and ``scores``."""
    return rows.select(id_col, model.scores(F.col(vector_col)).alias("scores"))


def principal_line(rows: DataFrame, model: PcaModel, n: int = 100, vector_col: str = "v") -> DataFrame:
    """``i`` and ``points``: the first component through the mean, over the range of the centred first column."""
    ends = rows.select((F.element_at(doubles(F.col(vector_col)), 1) - model.mean[0]).alias("x")).agg(F.min("x"), F.max("x")).first()
    t = linspace(F.col("id"), ends[0], ends[1], n)
    points = F.array(*(F.lit(m) + t * c for m, c in zip(model.mean, model.components[0], strict=True)))
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("i"), points.alias("points"))


def two_columns(rows: DataFrame, x: str, y: str) -> DataFrame:
    """One row with ``mx``, ``my``, and the first component ``dx``, ``dy`` of two columns, in closed form, by one aggregation."""
    moments = rows.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("c"))
    angle = F.atan2(F.col("c") * 2.0, F.col("vx") - F.col("vy")) * 0.5
    turned = moments.select("mx", "my", F.cos(angle).alias("a"), F.sin(angle).alias("b"))
    sign = F.when(F.abs("a") >= F.abs("b"), F.signum("a")).otherwise(F.signum("b"))
    return turned.select("mx", "my", (F.col("a") * sign).alias("dx"), (F.col("b") * sign).alias("dy"))
