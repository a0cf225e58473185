"""Shared-folder tables and small column helpers used by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.tables import spread
from millrace.sources.shared import blocks, drop_shared, drop_since, file_system, mark, materialize, shared_dir, written

__all__ = ["blocks", "bounded_batches", "drop_shared", "drop_since", "file_system", "fresh", "mark", "materialize", "numbered", "shared_dir", "text_key", "utf8", "written"]

# Settings of Arrow batches, Spark's defaults for them, and what they become.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df`` for Python workers: its session's Arrow batches made fit for rows of long texts, and no core without rows.

    Spark's default batches take tens of MB in an executor for each task and
    several times that in its Python worker.  A session with other sizes keeps
    them.  Only tables of fewer partitions than cores are dealt out.
    """
    conf = df.sparkSession.conf
    for key, (default, value) in _BATCHES.items():
        if conf.get(key, default) == default:
            conf.set(key, value)
    return spread(df)


def utf8(text: Column) -> Column:
    """The bytes of a text, no bytes for null."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a whole text (null: empty)."""
    t = F.coalesce(text, F.lit(""))
    return [F.xxhash64(t).alias("t1"), F.xxhash64(F.lit(1), t).alias("t2")]


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, f"millrace_{base}"
    while name in taken:
        name += "_"
    return name


#: Numbering cuts a group into cells of about so many rows, or of more where there would be over CELLS in all.
CELL_ROWS, CELLS = 256, 65536


def numbered(rows: DataFrame, key: str, sizes: list[tuple[int, int]], row_id: str, name: str) -> DataFrame:
    """``rows`` with the column ``name``, which counts each key's rows from 0 without gaps.

    ``sizes`` has every key (a bigint column) and its number of rows; there must
    be a bounded number of keys.  No task gets a whole key: rows are numbered
    within cells, and a cell starts where those before it end.  ``row_id``
    must be unique and stable, as in a materialized table.
    """
    most = max(CELL_ROWS, -(-sum(n for _, n in sizes) // CELLS))
    cut = rows.sparkSession.createDataFrame([(k, -(-n // most)) for k, n in sizes], f"{key} bigint, cells bigint")
    dealt = rows.join(F.broadcast(cut), key).withColumn("cell", F.pmod(F.xxhash64(row_id), F.col("cells"))).drop("cells")
    before = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(key, "cell").agg(F.count("*").alias("n"))
    starts = counts.select(key, "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    spot = F.row_number().over(Window.partitionBy(key, "cell").orderBy(row_id)) - 1
    # At most CELLS rows and one for each key.
    placed = dealt.withColumn("spot", spot).join(F.broadcast(starts), [key, "cell"])
    return placed.withColumn(name, F.col("begin") + F.col("spot")).drop("cell", "begin", "spot")
