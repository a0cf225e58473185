"""Exact nearest rows with an index of cells around pivots.

Every candidate belongs to the cell of its nearest pivot, and in it to a ring of
distances from the pivot.  By the triangle inequality, and by the plane between
two pivots, a ring is nowhere nearer to a query than a bound; rings whose bound
is above a distance within which the query has its k neighbours are skipped.
That distance comes from the rings' sizes first, then from the query's own cell.
The driver holds pivots and a few numbers for each ring; rings are cut into
blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.vectors import doubles
from millrace.operators.blockjoin import meet
from millrace.operators.nearest import _best, _matrix, _values, positive
from millrace.sources.shared import materialize


class MetricIndex:
    """Cells and rings of ``candidates(id, v)``, for searches by Euclidean distance.

    ``pivots`` are vectors drawn by a hash, at most so many; ``rings`` are the
    rings of a cell; a block has about ``block_rows`` rows.  ``carry`` names a
    column that results keep.  Vectors of unequal width are an error, null
    vectors and ids too; without candidates searches find nothing.
    """

    def __init__(self, candidates: DataFrame, pivots: int = 64, rings: int = 8, block_rows: int = 2048, carry: str | None = None) -> None:
        self.spark, self.carry, self.n_rings = candidates.sparkSession, carry, rings
        carried = [F.col(carry).alias("carried")] if carry else []
        rows = candidates.select(F.col("id").cast("bigint"), doubles(F.col("v")).alias("v"), *carried)
        # Twice as many as are wanted, since vectors may be repeated.
        drawn = [tuple(r.v) for r in rows.orderBy(F.xxhash64("id", "v")).limit(2 * pivots).collect()]
        if len({len(v) for v in drawn}) > 1:
            raise ValueError("vectors of unequal width")
        self.pivots = np.array(list(dict.fromkeys(drawn))[:pivots])
        if not drawn:
            return
        self.rows = self._blocks(materialize(self._placed(rows)), block_rows)

    def _placed(self, rows: DataFrame) -> DataFrame:
        pivots, width = self.pivots, self.pivots.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 4096):
                    part = batch.slice(at, 4096)
                    far = _values(_matrix(part.column(1), width), pivots, "euclidean")
                    cell = far.argmin(axis=1)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far[np.arange(len(cell)), cell])], [*part.schema.names, "cell", "far"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        return rows.mapInArrow(run, f"{kinds}, cell int, far double")

    def _blocks(self, placed: DataFrame, block_rows: int) -> DataFrame:
        n, rings = len(self.pivots), self.n_rings
        radius = np.zeros(n)
        for r in placed.groupBy("cell").agg(F.max("far").alias("far")).collect():
            radius[r.cell] = r.far
        wide = F.get(F.array(*(F.lit(float(x)) for x in radius)), F.col("cell"))
        ring = F.when(wide > 0, F.least(F.floor(F.col("far") / wide * rings), F.lit(rings - 1))).otherwise(F.lit(0)).cast("int")
        told = placed.withColumn("ring", F.col("cell") * rings + ring)
        self.low, self.high, self.sizes = np.full(n * rings, np.inf), np.full(n * rings, -np.inf), np.zeros(n * rings, np.int64)
        for r in told.groupBy("ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count("*").alias("n")).collect():
            self.low[r.ring], self.high[r.ring], self.sizes[r.ring] = r.low, r.high, r.n
        self.parts = -(-self.sizes // block_rows)
        self.first = np.cumsum(self.parts) - self.parts
        at = lambda x: F.get(F.array(*(F.lit(int(i)) for i in x)), F.col("ring"))
        block = at(self.first) + F.pmod(F.xxhash64("id", "v"), at(self.parts))
        return told.withColumn("block", block.cast("bigint")).drop("cell", "far", "ring")

    def _visits(self, asked: DataFrame, k: int, home: bool) -> DataFrame:
        """``block``, ``query_id``, ``q`` and ``rows`` of the blocks that each query has to see: of its home cell, or of the others."""
        pivots, rings, width = self.pivots, self.n_rings, self.pivots.shape[1]
        low, high, sizes, parts, first = self.low, self.high, self.sizes, self.parts, self.first
        apart = _values(pivots, pivots, "euclidean")
        cell_of = np.repeat(np.arange(len(pivots)), rings)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    far = _values(_matrix(part.column(1), width), pivots, "euclidean")
                    own, limit = (part.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                    out = []
                    for i, d in enumerate(far):
                        mine = int(d.argmin())
                        there = d[cell_of]
                        most = there + high
                        order = np.argsort(most)
                        enough = np.searchsorted(np.cumsum(sizes[order]), k + own[i])
                        theta = min(limit[i], most[order[enough]] if enough < len(order) else np.inf)
                        plane = np.divide(d * d - d[mine] ** 2, 2 * apart[mine], out=np.zeros_like(d), where=apart[mine] > 0)[cell_of]
                        least = np.maximum(np.maximum(there - high, low - there), plane)
                        # A little more than the distance, for what rounding adds.
                        wanted = np.flatnonzero((sizes > 0) & (least <= theta + 1e-9 * (1 + theta)) & ((cell_of == mine) == home))
                        out += [(b, i, sizes[w] / parts[w]) for w in wanted for b in range(first[w], first[w] + parts[w])]
                    if out:
                        block, i, rows = (np.array(x) for x in zip(*out, strict=True))
                        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)), pa.array(rows, pa.float64())], ["block", "query_id", "q", "rows"])

        return asked.select("query_id", "q", "own", "limit").mapInArrow(run, "block bigint, query_id bigint, q array<double>, rows double")

    def _met(self, visits: DataFrame, k: int, others_only: bool) -> DataFrame:
        width, carry = self.pivots.shape[1], bool(self.carry)
        schema = "query_id bigint, id bigint, value double" + (f", carried {self.rows.schema['carried'].dataType.simpleString()}" if carry else "")

        def work(table: pa.Table, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            if carry:
                table = table.take(pc.array_sort_indices(table.column("carried").combine_chunks()))
            column = lambda c: table.column(c).combine_chunks()
            held = column("v")
            rows = np.asarray(held.flatten()).reshape(-1, width)
            queries = _matrix(asks.column(asks.schema.get_field_index("q")), width)
            ids = np.asarray(asks.column(asks.schema.get_field_index("query_id")))
            yield _best(ids, queries, np.asarray(column("id")), rows, k, "euclidean", others_only, column("carried") if carry else None)

        return meet(self.rows, visits.drop("rows"), "block", work, schema)

    def search(self, queries: DataFrame, k: int, others_only: bool = False) -> DataFrame:
        """``query_id``, ``rank``, ``id`` and ``value``, as ``nearest`` has them, and the carried column.

        ``compared`` is then a table of ``query_id`` and ``rows``: how many
        candidates each query was compared with, about.
        """
        positive(k)
        kept = [F.col("carried").alias(self.carry)] if self.carry else []
        if not len(self.pivots):
            return self.spark.createDataFrame([], "query_id bigint, rank int, id bigint, value double").withColumns({self.carry: F.lit(None)} if self.carry else {})
        asked = queries.select(F.col("id").cast("bigint").alias("query_id"), doubles(F.col("v")).alias("q")).dropDuplicates(["query_id"])
        own = F.lit(0).cast("bigint")
        if others_only:
            asked = asked.join(self.rows.groupBy(F.col("id").alias("query_id")).agg(F.count("*").alias("copies")), "query_id", "left")
            own = F.coalesce("copies", F.lit(0))
        asked = materialize(asked.select("query_id", "q", own.alias("own"), F.lit(float("inf")).alias("limit")))
        near = materialize(self._visits(asked, k, True))
        order = [F.asc("value"), F.asc("id"), *([F.asc_nulls_last("carried")] if self.carry else [])]
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
        home = materialize(self._met(near, k, others_only).withColumn("rank", place).where(F.col("rank") <= k))
        limits = home.where(F.col("rank") == k).select("query_id", F.col("value").alias("seen"))
        told = asked.join(limits, "query_id", "left").withColumn("limit", F.coalesce("seen", "limit")).drop("seen")
        rest = materialize(self._visits(told, k, False))
        self.compared = near.select("query_id", "rows").union(rest.select("query_id", "rows")).groupBy("query_id").agg(F.sum("rows").alias("rows"))
        both = home.drop("rank").unionByName(self._met(rest, k, others_only))
        best = both.withColumn("rank", place).where(F.col("rank") <= k)
        return best.select("query_id", "rank", "id", "value", *kept)
