"""Principal components of wide vectors, without a covariance matrix.

A block of random directions is multiplied by the rows and by their transpose,
round by round.  In each round tasks give a triangular factor of their part of
the product, and factors are merged in a tree; the directions of the next round
are sums over the rows.  All that is held is as wide as a vector, times the
number of directions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import doubles
from millrace.sources.shared import materialize

#: Components of a piece of a sum, and tasks that merge the factors of all others.
PIECE, FAN = 1024, 8
_PARTS = "i int, s array<double>"


def _batch(i: list[int], rows: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array([x.ravel() for x in rows], pa.list_(pa.float64()))], ["i", "s"])


def _pieces(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, at in enumerate(range(0, len(matrix), PIECE)):
        yield _batch([i], [matrix[at : at + PIECE]])


def _summed(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of matrices that tasks gave in pieces; a task adds up a piece at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for batch in batches:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i != at:
                    if at is not None:
                        yield _batch([at], [held])
                    at, held = i, 0.0
                held = held + np.asarray(s.values)
        if at is not None:
            yield _batch([at], [held])

    found = parts.repartition("i").sortWithinPartitions("i").mapInArrow(run, _PARTS).toArrow()
    out = {i: np.asarray(s.values) for i, s in zip(found.column("i").to_pylist(), found.column("s"), strict=True)}
    return np.concatenate([out[i] for i in sorted(out)]).reshape(shape) if out else np.zeros(shape)


def _triangle(parts: DataFrame, l: int) -> np.ndarray:  # noqa: E741
    """The triangular factor of all rows, from those of the tasks."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, l))
        for batch in batches:
            for s in batch.column(1):
                held = np.linalg.qr(np.concatenate([held, np.asarray(s.values).reshape(-1, l)]), mode="r")
        if len(held):
            yield _batch([0], [held])

    held = np.zeros((0, l))
    for s in parts.repartition(FAN).mapInArrow(merge, _PARTS).toArrow().column("s"):  # FAN of them at most
        held = np.linalg.qr(np.concatenate([held, np.asarray(s.values).reshape(-1, l)]), mode="r")
    return held


@dataclass(frozen=True)
class WidePca:
    """Components as rows, the mean, standard deviations along components, and their shares of the variance."""

    components: np.ndarray
    mean: np.ndarray
    deviations: np.ndarray
    shares: np.ndarray

    def project(self, rows: DataFrame, id_col: str, vector_col: str = "v") -> DataFrame:
        """``id_col`` and ``scores``."""
        components, mean = self.components, self.mean
        kind = rows.schema[id_col].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = (_matrix(batch.column(1), len(mean)) - mean) @ components.T
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(scores), pa.list_(pa.float64()))], [id_col, "scores"])

        return rows.select(id_col, doubles(F.col(vector_col)).alias("v")).mapInArrow(run, f"`{id_col}` {kind}, scores array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = np.asarray(column.flatten())
    if len(flat) != width * len(column):
        raise ValueError("vectors of unequal width")
    return flat.reshape(-1, width)


def fit_wide(rows: DataFrame, k: int, vector_col: str = "v", more: int = 10, rounds: int = 8, seed: int = 0) -> WidePca:
    """About the first k components of vectors of any width, by ``k + more`` directions and so many rounds.

    The error of a component falls in each round by the square of the ratio of
    the first variance left out to its own; with as many directions as the
    vectors are wide, or as there are rows, the result is exact.  A component's
    largest coefficient, the first of equal ones, is positive.  Fewer than two
    rows, rows without any variance and null vectors are errors.
    """
    if k < 1:
        raise ValueError("k must be positive")
    first = rows.select(F.size(vector_col).alias("n")).first()
    if first is None:
        raise ValueError("components need two rows or more")
    width = first.n
    vectors = rows.select(doubles(F.col(vector_col)).alias("v"))

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width + 2)
        for batch in batches:
            x = _matrix(batch.column(0), width)
            held += np.concatenate([x.sum(axis=0), [len(x), (x * x).sum()]])
        yield from _pieces(held)

    sums = _summed(vectors.mapInArrow(moments, _PARTS), (width + 2,))
    n = int(sums[width])
    if n < 2:
        raise ValueError("components need two rows or more")
    mean = sums[:width] / n

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = 0.0
        for batch in batches:
            x = _matrix(batch.column(0), width) - mean
            spread += float((x * x).sum())
        yield _batch([0], [np.array([spread])])

    whole = float(_summed(vectors.mapInArrow(scatter, _PARTS), (1,))[0])
    if whole <= 0:
        raise ValueError("the rows have no variance")
    l = min(k + more, width)  # noqa: E741
    directions = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, l)))[0]
    sizes = np.zeros(0)
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], directions: np.ndarray = directions) -> Iterator[pa.RecordBatch]:
            factor, back = np.zeros((0, directions.shape[1])), np.zeros_like(directions)
            for batch in batches:
                x = _matrix(batch.column(0), width) - mean
                y = x @ directions
                factor = np.linalg.qr(np.concatenate([factor, y]), mode="r")
                back += x.T @ y
            if len(factor):
                yield _batch([-1], [factor])
                yield from _pieces(back)

        parts = materialize(vectors.mapInArrow(run, _PARTS))
        _, s, turn = np.linalg.svd(_triangle(parts.where("i < 0"), directions.shape[1]), full_matrices=False)
        kept = s > s[0] * 1e-12
        back = _summed(parts.where("i >= 0"), directions.shape)
        # The rows' product with an orthonormal basis of the product before.
        directions, sizes, _ = np.linalg.svd(back @ turn[kept].T / s[kept], full_matrices=False)
    k = min(k, len(sizes))
    chosen = [c * np.sign(c[np.argmax(np.round(np.abs(c), 12))]) for c in directions.T[:k]]
    return WidePca(np.array(chosen), mean, sizes[:k] / np.sqrt(n - 1), sizes[:k] ** 2 / whole)
