"""Nearest rows of many queries: blocks of queries against chunks of candidates.

Queries are written to the shared folder once.  Every task takes its candidates
in chunks of bounded size, reads the queries block by block from there and keeps
each query's best k of the chunk; Spark merges the lists.  The driver sees
neither queries nor candidates.  With one query, ``ranked`` sorts and limits
within Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import doubles
from millrace.sources.shared import blocks, written

#: Bytes of a block of queries and of a chunk of candidates in a task.
BLOCK_BYTES, CHUNK_BYTES = 8 << 20, 32 << 20
TILE_QUERIES, TILE_ROWS = 64, 1024
#: Whether larger values come first, and larger ids among equal values.
METRICS = {"euclidean": False, "cosine": True}


def positive(k: int) -> None:
    if k < 1:
        raise ValueError("k must be positive")


def ranked(rows: DataFrame, value: Column | str, id_col: str, k: int, larger: bool = True) -> DataFrame:
    """The best k rows with their ``rank``; ties by larger id if larger values come first, else by smaller id."""
    positive(k)
    value = F.col(value) if isinstance(value, str) else value
    order = (value.desc(), F.col(id_col).desc()) if larger else (value.asc(), F.col(id_col).asc())
    best = rows.orderBy(*order).limit(k)
    # At most k rows from here on.
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def _values(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        squares = np.zeros((len(queries), len(rows)))
        for j in range(queries.shape[1]):  # term by term, as a row-wise sum would add them
            step = queries[:, j, None] - rows[None, :, j]
            squares += step * step
        return np.sqrt(squares)
    product = np.einsum("qd,cd->qc", queries, rows)  # the same for equal rows, wherever they stand
    sizes = np.sqrt(np.einsum("qd,qd->q", queries, queries))[:, None] * np.sqrt(np.einsum("cd,cd->c", rows, rows))[None, :]
    return np.divide(product, sizes, out=np.zeros_like(product), where=sizes > 0)


def _first(query: np.ndarray, value: np.ndarray, ids: np.ndarray, row: np.ndarray, k: int, larger: bool):
    order = np.lexsort((row, -ids, -value, query) if larger else (row, ids, value, query))
    query, value, ids, row = query[order], value[order], ids[order], row[order]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], value[keep], ids[keep], row[keep]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if (np.diff(np.asarray(column.offsets)) != width).any():
        raise ValueError("vectors of unequal width")
    return np.asarray(column.flatten()).reshape(-1, width)


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array | None]]:
    """Ids, vectors and what is carried, if anything is, of as many batches as fit a chunk; rows are in order of what is carried."""
    held, size = [], 0

    def chunk() -> tuple[np.ndarray, np.ndarray, pa.Array | None]:
        ids, vectors = (np.concatenate([x[i] for x in held]) for i in (0, 1))
        if held[0][2] is None:
            return ids, vectors, None
        carried = pa.concat_arrays([x[2] for x in held])
        order = pa.compute.array_sort_indices(carried)
        return ids[order], vectors[order], carried.take(order)

    for batch in batches:
        held.append((np.asarray(batch.column(0)), _matrix(batch.column(1), width), batch.column(2) if batch.num_columns > 2 else None))
        size += held[-1][1].nbytes
        if size >= CHUNK_BYTES:
            yield chunk()
            held, size = [], 0
    if held:
        yield chunk()


def _best(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, metric: str, others_only: bool, carried: pa.Array | None = None) -> pa.RecordBatch:
    """The k best rows of a chunk for each query of a block."""
    larger = METRICS[metric]
    held = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for c in range(0, len(ids), TILE_ROWS):
        parts, tile = [held], ids[c : c + TILE_ROWS]
        for q in range(0, len(query_ids), TILE_QUERIES):
            value = _values(queries[q : q + TILE_QUERIES], rows[c : c + TILE_ROWS], metric)
            wanted = np.ones_like(value, bool)
            rank = value.copy()
            if others_only:
                # Own rows, however often they are repeated, must not take places among the k.
                wanted = query_ids[q : q + TILE_QUERIES, None] != tile[None, :]
                rank[~wanted] = -np.inf if larger else np.inf
            if value.shape[1] > k:
                wanted &= rank >= np.partition(rank, -k, axis=1)[:, [-k]] if larger else rank <= np.partition(rank, k - 1, axis=1)[:, [k - 1]]
            at, col = np.nonzero(wanted)
            parts.append(_first(at + q, value[at, col], tile[col], col + c, k, larger))
        held = _first(*(np.concatenate(x) for x in zip(*parts, strict=True)), k, larger)
    columns = [pa.array(query_ids[held[0]], pa.int64()), pa.array(held[2], pa.int64()), pa.array(held[1], pa.float64())]
    if carried is None:
        return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "value"])
    return pa.RecordBatch.from_arrays([*columns, carried.take(pa.array(held[3]))], ["query_id", "id", "value", "carried"])


def nearest(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "euclidean", others_only: bool = False, block: int | None = None, carry: str | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``id`` and ``value`` of each query's k best candidates, or of all if there are fewer.

    Both tables have ``id`` and ``v``.  Distances ascend and ties go to the
    smaller id; similarities descend and ties go to the larger id.
    ``others_only`` leaves out the candidates with the query's own id.  A
    repeated query is answered once, a repeated candidate counts each time.
    ``block`` is the number of queries in a block, ``BLOCK_BYTES`` otherwise.
    ``carry`` names a column of the candidates that each neighbour keeps; among
    repeated candidates of one value it breaks ties, nulls last.
    """
    positive(k)
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    spark = candidates.sparkSession
    carried = [F.col(carry).alias("carried")] if carry else []
    rows = candidates.select(F.col("id").cast("bigint"), doubles(F.col("v")).alias("v"), *carried)
    schema = "query_id bigint, id bigint, value double" + (f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else "")
    asked = written(queries.select(F.col("id").cast("bigint"), doubles(F.col("v")).alias("v")).dropDuplicates(["id"]))
    widths = spark.read.schema("id bigint, v array<double>").parquet(asked).agg(F.min(F.size("v")).alias("low"), F.max(F.size("v")).alias("high")).first()
    if widths.low is None:
        return spark.createDataFrame([], schema.replace("query_id bigint,", "query_id bigint, rank int,")).withColumnRenamed("carried", carry or "carried")
    if widths.low != widths.high:
        raise ValueError("vectors of unequal width")
    width = widths.low
    block = block or max(1, BLOCK_BYTES // (8 * max(1, width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix, kept in _chunks(batches, width):
            for part in blocks(asked, block):
                yield _best(np.asarray(part.column(0)), _matrix(part.column(1), width), ids, matrix, k, metric, others_only, kept)

    lists = rows.mapInArrow(run, schema)
    order = [F.desc("value"), F.desc("id")] if METRICS[metric] else [F.asc("value"), F.asc("id")]
    order += [F.asc_nulls_last("carried")] if carry else []
    best = lists.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "id", "value", *([F.col("carried").alias(carry)] if carry else []))
