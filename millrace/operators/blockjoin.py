"""Queries that meet blocks of rows: each task streams sorted rows, a block first and then the queries that ask for it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A block's rows go to further tasks, once more for every so many queries that ask for it.
QUERIES = 20_000

Work = Callable[[pa.Table, pa.RecordBatch], Iterator[pa.RecordBatch]]


def meet(rows: DataFrame, asked: DataFrame, block: str, work: Work, schema: str) -> DataFrame:
    """What ``work`` makes of each block of ``rows`` and the rows of ``asked`` for it, batch by batch.

    Both have the column ``block``, and may have others of their own.  A task
    holds one block of ``rows``, so blocks must be of bounded size; those of
    ``asked`` are streamed, and blocks that very many ask for are copied to more
    tasks, by the number of askers.
    """
    copies = asked.groupBy(block).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_copies"))
    mine = rows.join(copies, block).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies").withColumn("_asks", F.lit(False))
    spread = F.pmod(F.xxhash64(*asked.columns), F.col("_copies")).cast("int")
    theirs = asked.join(copies, block).withColumn("_copy", spread).drop("_copies").withColumn("_asks", F.lit(True))
    dealt = mine.unionByName(theirs, allowMissingColumns=True).repartition(block, "_copy").sortWithinPartitions(block, "_copy", "_asks")
    names = dealt.columns
    keys = [names.index(c) for c in (block, "_copy", "_asks")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        table = None
        for batch in batches:
            if not batch.num_rows:
                continue
            which, copy, asks = (np.asarray(batch.column(k).to_numpy(zero_copy_only=False)) for k in keys)
            cuts = np.flatnonzero((which[1:] != which[:-1]) | (copy[1:] != copy[:-1]) | (asks[1:] != asks[:-1])) + 1
            for a, z in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, z - a)
                if (which[a], copy[a]) != now:
                    now, held, table = (which[a], copy[a]), [], None
                if not asks[a]:
                    held.append(part)
                elif held:
                    table = pa.Table.from_batches(held).combine_chunks() if table is None else table
                    yield from work(table, part)

    return dealt.mapInArrow(run, schema)
