"""Approximate nearest rows: inverted lists of product-quantised codes, and an exact order of what they find.

List centres come from rounds over all rows, summed where the rows lie.  What a
row differs by from its centre is stored as one byte for each of some parts of
the vector; the codebooks are fitted on a bounded sample.  A query sees the
lists of its nearest centres, by codes, and the vectors of the best of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import doubles, euclidean
from millrace.operators.blockjoin import meet
from millrace.operators.nearest import _matrix, positive
from millrace.sources.shared import materialize

#: Codes of a part's codebook, and rows that codebooks are fitted on at most.
CODES, SAMPLE_ROWS = 256, 20_000


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)[None], 0)


def _means(rows: np.ndarray, n: int, rounds: int) -> np.ndarray:
    """Centres of at most ``n`` groups of a sample."""
    centres = rows[np.linspace(0, len(rows) - 1, min(n, len(rows))).astype(int)].copy()
    for _ in range(rounds):
        at = _squares(rows, centres).argmin(axis=1)
        count = np.bincount(at, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, at, rows)
        centres[count > 0] = sums[count > 0] / count[count > 0, None]
    return centres


class AnnIndex:
    """An index of all of ``candidates(id, v)``.

    ``lists`` centres, after ``rounds`` rounds over all rows; ``parts`` bytes
    for a row, which must divide the vectors' width; blocks of lists have about
    ``block_rows`` rows.  ``seed`` picks what centres start from.
    """

    def __init__(self, candidates: DataFrame, lists: int = 64, parts: int = 16, rounds: int = 5, block_rows: int = 8192, seed: int = 0) -> None:
        self.spark = candidates.sparkSession
        rows = materialize(candidates.select(F.col("id").cast("bigint"), doubles(F.col("v")).alias("v")).withColumn("row", F.monotonically_increasing_id()))
        order = F.xxhash64(F.lit(seed), "row")
        start = [r.v for r in rows.orderBy(order).limit(lists).collect()]
        self.width = len(start[0]) if start else 0
        if not start:
            return
        if self.width % parts:
            raise ValueError("parts must divide the width")
        self.parts, self.centres = parts, np.array(start)
        for _ in range(rounds):
            self._round(rows)
        sample = np.array([r.v for r in rows.orderBy(F.xxhash64(F.lit(seed + 1), "row")).limit(SAMPLE_ROWS).collect()])
        rest = sample - self.centres[_squares(sample, self.centres).argmin(axis=1)]
        self.books = [_means(p, CODES, rounds) for p in np.split(rest, parts, axis=1)]
        self.rows = self._stored(rows, block_rows)

    def _round(self, rows: DataFrame) -> None:
        """Each centre becomes the mean of its rows; tasks hand on one sum for each list."""
        centres, width = self.centres, self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, count = np.zeros_like(centres), np.zeros(len(centres), np.int64)
            for batch in batches:
                m = _matrix(batch.column(0), width)
                at = _squares(m, centres).argmin(axis=1)
                np.add.at(sums, at, m)
                count += np.bincount(at, minlength=len(centres))
            seen = np.flatnonzero(count)
            if len(seen):
                yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(count[seen]), pa.array(list(sums[seen]), pa.list_(pa.float64()))], ["list", "n", "total"])

        part = rows.select("v").mapInArrow(run, "list int, n bigint, total array<double>")
        spread = part.select("list", "n", F.posexplode("total").alias("pos", "x"))
        means = spread.groupBy("list", "pos").agg((F.sum("x") / F.sum("n")).alias("mean")).collect()  # as many numbers as centres have
        new = centres.copy()
        for r in means:
            new[r.list, r.pos] = r.mean
        self.centres = new

    def _stored(self, rows: DataFrame, block_rows: int) -> DataFrame:
        centres, books, width, parts = self.centres, self.books, self.width, self.parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = _matrix(batch.column(1), width)
                at = _squares(m, centres).argmin(axis=1)
                rest = np.split(m - centres[at], parts, axis=1)
                codes = np.stack([_squares(p, b).argmin(axis=1).astype(np.uint8) for p, b in zip(rest, books, strict=True)], axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())], ["id", "v", "row", "list", "code"])

        coded = materialize(rows.mapInArrow(run, "id bigint, v array<double>, row bigint, list int, code binary"))
        sizes = np.zeros(len(centres), np.int64)
        for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect():
            sizes[r.list] = r.n
        self.blocks = -(-sizes // block_rows)
        self.first = np.cumsum(self.blocks) - self.blocks
        at = lambda x: F.get(F.array(*(F.lit(int(i)) for i in x)), F.col("list"))
        block = at(self.first) + F.pmod(F.xxhash64("row"), at(self.blocks))
        return coded.withColumn("block", block.cast("bigint"))

    def search(self, queries: DataFrame, k: int, probe: int = 8, depth: int = 100, others_only: bool = False) -> DataFrame:
        """``query_id``, ``rank``, ``id`` and ``value`` (Euclidean distance) of about the k nearest rows of each query.

        Each query sees its ``probe`` nearest lists; the ``depth`` best rows by
        their codes are put in order by their vectors.  With all lists and a
        depth of all rows the result is exact.  Ties go to the smaller id, a
        repeated query is answered once, repeated candidates count each time.
        """
        positive(k)
        if not self.width:
            return self.spark.createDataFrame([], "query_id bigint, rank int, id bigint, value double")
        centres, books, width, parts, first, blocks = self.centres, self.books, self.width, self.parts, self.first, self.blocks
        owner = np.repeat(np.arange(len(centres)), blocks)
        asked = materialize(queries.select(F.col("id").cast("bigint").alias("query_id"), doubles(F.col("v")).alias("q")).dropDuplicates(["query_id"]))

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    part = batch.slice(at, 1024)
                    near = np.argsort(_squares(_matrix(part.column(1), width), centres), axis=1)[:, :probe]
                    out = [(b, i) for i, lists in enumerate(near) for x in lists for b in range(first[x], first[x] + blocks[x])]
                    if out:
                        block, i = (np.array(x) for x in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i))], ["block", "query_id", "q"])

        def work(table: pa.Table, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            block = table.column("block")[0].as_py()
            codes = np.frombuffer(b"".join(table.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            ids, rows = (np.asarray(table.column(c).combine_chunks()) for c in ("id", "row"))
            names = asks.schema.get_field_index
            who, q = np.asarray(asks.column(names("query_id"))), _matrix(asks.column(names("q")), width)
            rest = np.split(q - centres[owner[block]], parts, axis=1)
            away = [_squares(p, b) for p, b in zip(rest, books, strict=True)]
            out = [np.zeros((3, 0))]
            for i in range(len(who)):
                score = sum(t[i][codes[:, m]] for m, t in enumerate(away))
                score = np.where(ids == who[i], np.inf, score) if others_only else score
                best = np.argpartition(score, depth)[:depth] if len(score) > depth else np.arange(len(score))
                best = best[np.isfinite(score[best])]
                out.append(np.stack([np.full(len(best), i), best, score[best]]))
            i, at, score = np.concatenate(out, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(who[i.astype(int)], pa.int64()), pa.array(rows[at.astype(int)], pa.int64()), pa.array(score)], ["query_id", "row", "score"])

        visits = asked.mapInArrow(visit, "block bigint, query_id bigint, q array<double>")
        found = meet(self.rows.select("block", "id", "row", "code"), visits, "block", work, "query_id bigint, row bigint, score double")
        by = Window.partitionBy("query_id")
        deep = found.withColumn("place", F.row_number().over(by.orderBy("score", "row"))).where(F.col("place") <= depth)
        told = deep.select("query_id", "row").join(self.rows.select("row", "id", "v"), "row").join(asked, "query_id")
        exact = told.select("query_id", "id", euclidean(F.col("q"), F.col("v")).alias("value"))
        return exact.withColumn("rank", F.row_number().over(by.orderBy("value", "id"))).where(F.col("rank") <= k).select("query_id", "rank", "id", "value")
