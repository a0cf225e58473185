"""Small relational operators: defaults, masks, stacking, distinct values, checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_default(df: DataFrame, column: str, default: str = "") -> DataFrame:
    """``df`` with ``default`` for a column that is null, or that it lacks."""
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(default)) if column in df.columns else F.lit(default))


def component(df: DataFrame, condition: Column, vector_col: str, position: int, name: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """One component, counted from 0, of the vectors of the rows where ``condition`` holds, beside the columns ``keep``."""
    return df.where(condition).select(*keep, F.element_at(vector_col, position + 1).alias(name))


def stack(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames, columns by name."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df)
    return first


def paired(df: DataFrame, columns: Sequence[str], name: str = "v") -> DataFrame:
    """``df`` with a vector of some of its columns."""
    return df.withColumn(name, F.array(*(F.col(c).cast("double") for c in columns)))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The values of a column, each once, with their number of rows."""
    return df.groupBy(column).agg(F.count("*").alias("n"))


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column``, ``low`` and ``high`` of each column, by one aggregation."""
    sides = df.agg(*(f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(columns) for f in (F.min, F.max)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"min_{i}").cast("double").alias("low"), F.col(f"max_{i}").cast("double").alias("high")) for i, c in enumerate(columns)))
    return sides.select(F.inline(rows))


def all_close(df: DataFrame, a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> bool:
    """Whether ``a`` and ``b`` agree in every row, to the usual tolerances; rows with a null don't."""
    close = F.abs(a - b) <= absolute + relative * F.abs(b)
    return df.where(~F.coalesce(close, F.lit(False))).limit(1).count() == 0


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    Only tables of fewer partitions than that are dealt out, such as a file of
    one row group; larger ones are left where they are, and so are results of
    shuffles, whose partitions are Spark's choice.
    """
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan":
        return df  # it has shuffles, which counting partitions would run
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df.rdd.getNumPartitions() < cores else df


#: Bits of a filter that ``likely`` sends to all tasks, in rows of 4 KB.
FILTER_BITS = 1 << 24


def likely(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be one of those of ``keys``, a table of one column: all that are, and few others.

    One bit of ``FILTER_BITS`` stands for a key's hash, so what is sent to the
    tasks is 2 MB at most, and rows that nobody asked for need not be moved to
    find that out.  With more keys than bits most rows pass.
    """

    def slot(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(FILTER_BITS)) + 1

    asked = keys.select(slot(keys.columns[0]).alias("_slot"))
    bits = asked.groupBy(F.bitmap_bucket_number("_slot").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_slot")).alias("_bits"))
    met = rows.withColumn("_slot", slot(key)).join(F.broadcast(bits), F.bitmap_bucket_number("_slot") == F.col("_bucket"))
    at = F.bitmap_bit_position("_slot")
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    return met.where(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)
