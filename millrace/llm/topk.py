"""Exact top-k inner-product search by tiled matrix products.

Queries are written to the shared folder once.  Every task takes its candidates
in chunks of bounded size and reads the queries block by block from there; a
block meets a chunk in tiles, with partial selection within each tile and one
top list per query.  The lists are merged in a tree: first within groups of
tasks, then over the groups.  The driver sees neither queries nor candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm._shared import blocks, written

#: Bytes of a block of queries and of a chunk of candidates in a task.
BLOCK_BYTES, CHUNK_BYTES = 32 << 20, 32 << 20
TILE_QUERIES, TILE_CANDIDATES = 1024, 2048
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def quantized(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``v``, floor(scale * x) of each component as double; rows that cannot take part are left out."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(sound).select(F.col(id_col).cast("bigint").alias("id"), F.transform(v, lambda x: _floor(x, scale)).alias("v"))


def _floor(x: Column, scale: float) -> Column:
    # floor() returns bigint and would overflow; doubles from 2^52 on are whole already.
    y = x * F.lit(scale)
    return F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal width; missing components count as zero, as they would in the inner product."""
    ends = np.asarray(column.offsets)
    flat = np.asarray(column.values)
    lengths = np.diff(ends)
    if len(lengths) and (lengths == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width)
    out = np.zeros((len(lengths), width))
    for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        n = min(b - a, width)
        out[i, :n] = flat[a : a + n]
    return out


def _scores(queries: np.ndarray, tile: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers; float64 where it is exact, else Python integers within 64 bits."""
    shared = min(queries.shape[1], tile.shape[1])
    queries, tile = queries[:, :shared], tile[:, :shared]
    bound = shared * float(np.abs(queries).max(initial=0)) * float(np.abs(tile).max(initial=0))
    if bound < 1 << 53:
        return queries @ tile.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(queries).astype(object) @ whole(tile).astype(object).T, _LOW, _HIGH)


def _best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first k entries of each row by score, larger first, then by id."""
    order = np.lexsort((ids, -score, row)) if score.dtype != object else np.array(sorted(range(len(row)), key=lambda i: (row[i], -score[i], ids[i])), int)
    row, score, ids = row[order], score[order], ids[order]
    first = np.searchsorted(row, row, side="left")
    keep = np.arange(len(row)) - first < k
    return row[keep], score[keep], ids[keep]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of as many batches as fit a chunk; shorter vectors are filled up with zeros."""
    held, size = [], 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        whole = pa.Table.from_batches(held).combine_chunks()
        vectors = whole.column(1).combine_chunks()
        return whole.column(0).to_numpy(), _matrix(vectors, int(np.diff(np.asarray(vectors.offsets)).max(initial=0)))

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield joined()
            held, size = [], 0
    if held:
        yield joined()


def _against(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, k: int):
    """The k best of a chunk for each query of a block: query, score and id."""
    held = (np.zeros(0, int), np.zeros(0), np.zeros(0, np.int64))
    for c in range(0, len(ids), TILE_CANDIDATES):
        tile, tile_ids = matrix[c : c + TILE_CANDIDATES], ids[c : c + TILE_CANDIDATES]
        parts = [held]
        for q in range(0, len(query_ids), TILE_QUERIES):
            score = _scores(queries[q : q + TILE_QUERIES], tile)
            other = query_ids[q : q + TILE_QUERIES, None] != tile_ids[None, :]
            if score.dtype != object and len(tile_ids) > k:
                # A query's own rows, however often they are repeated, take no places among the k.
                rank = np.where(other, score, -np.inf)
                other &= rank >= np.partition(rank, -k, axis=1)[:, [-k]]
            row, col = np.nonzero(other)
            parts.append(_best(row + q, score[row, col], tile_ids[col], k))
        held = _best(*(np.concatenate(x) for x in zip(*parts, strict=True)), k)
    return held


def _search(asked: str, block: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, matrix in _chunks(batches):
            for part in blocks(asked, block):
                query_ids, vectors = np.asarray(part.column(0)), part.column(1)
                queries = _matrix(vectors, int(np.diff(np.asarray(vectors.offsets)).max(initial=0)))
                row, score, found = _against(query_ids, queries, ids, matrix, k)
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[row]), pa.array(found, pa.int64()), pa.array([int(x) for x in score], pa.int64())], ["query_id", "id", "score"])

    return run


def _merge(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best k of each list; Spark limits each task's lists before it shuffles them."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return lists.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int | None = None) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id_col`` and ``score`` of each query's k best candidates.

    Queries are the rows where ``is_query`` holds, candidates all rows with
    another id.  The score is the inner product of the quantized vectors,
    floor(scale * x); ties go to the smaller id.  Rows with a null id, a null
    vector or a null or non-finite component take no part.  Components that one
    of two vectors lacks count as zero; scores beyond 64 bits stop at the ends
    of that range.  A query row that is repeated is answered once, a repeated
    candidate counts each time.  Very long vectors only make blocks of fewer
    rows: ``query_block`` is the number of queries in a block, otherwise as many
    as ``BLOCK_BYTES`` holds.  No queries or no candidates give no rows; other
    columns are not read.
    """
    if k < 1:
        raise ValueError("k must be positive")
    spark = vectors.sparkSession
    sound = quantized(vectors, scale, id_col, vector_col)
    asked = written(quantized(vectors.where(is_query), scale, id_col, vector_col).dropDuplicates(["id"]))
    width = spark.read.schema(sound.schema).parquet(asked).agg(F.max(F.size("v")).alias("width")).first().width
    if width is None:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score bigint")
    block = query_block or max(1, BLOCK_BYTES // (8 * max(1, width)))
    lists = sound.mapInArrow(_search(asked, block, k), "query_id bigint, id bigint, score bigint").withColumn("part", F.spark_partition_id())
    fan = max(1, round(max(2, spark.sparkContext.defaultParallelism) ** 0.5))
    near = _merge(lists.withColumn("part", F.pmod("part", F.lit(fan))), ["query_id", "part"], k).drop("rank")
    return _merge(near, ["query_id"], k).select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
