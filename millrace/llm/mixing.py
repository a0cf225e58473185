"""Mixing sources to target weights by Poisson replication.

Every document gets a count drawn from a Poisson distribution whose mean is its
source's target repetition rate.  The draw inverts the distribution at a uniform
number that is hashed from the seed and the document's id, so that it is the
same on every machine and in every attempt.  Documents are exploded by their
counts and put into one global random order.  All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._shared import fresh, materialize

#: A mean above this is drawn as a sum of equal parts that are not.
PART_MEAN = 16.0
#: Terms of a part's distribution; the rest of its mass is below 2^-53.
TERMS = 80
#: Statistics of up to so many sources are broadcast, those of more are joined by a shuffle.
BROADCAST_SOURCES = 100_000
_KEY_BITS = 60


def _digits(text: Column, n: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, n), 16, 10).cast("bigint")


def _id(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def poisson_cdf(mean: Column, terms: int = TERMS) -> Column:
    """P(X <= k) for k from 0 to ``terms``, as an array."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.array_append(acc["c"], F.element_at(acc["c"], -1) + p).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["c"])


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5, budget: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``source``, ``rate``, ``parts`` and ``cdf`` (of one part) for every source, null included.

    A document's size is its UTF-8 bytes plus one.  With ``weights`` a source's
    share of the result is its weight over the sum of the given weights, and
    sources without one get none; else its share goes with its size to the
    power ``exponent``.  ``budget`` is the result's expected size as a multiple
    of the input's.
    """
    size = F.coalesce(F.octet_length(text_col), F.lit(0)) + 1
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(size).cast("double").alias("size"))
    if weights is None:
        weight = F.sqrt("size") if exponent == 0.5 else F.pow("size", F.lit(exponent))
    else:
        weight = F.lit(0.0)
        for name, w in weights.items():
            if w < 0:
                raise ValueError("weights must not be negative")
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    sizes = materialize(sizes.withColumn("weight", weight))
    total = sizes.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight"))
    share = F.when(F.col("all.weight") > 0, F.col("one.weight") / F.col("all.weight")).otherwise(0.0)
    rates = sizes.alias("one").join(F.broadcast(total).alias("all"), F.lit(True)).select("source", (share * F.col("all.size") * F.lit(float(budget)) / F.col("one.size")).alias("rate"))
    parts = F.greatest(F.ceil(F.col("rate") / PART_MEAN), F.lit(1)).cast("int")
    return rates.withColumn("parts", parts).withColumn("cdf", poisson_cdf(F.col("rate") / F.col("parts")))


def replicate(docs: DataFrame, weights: Mapping[str, float] | None = None, exponent: float = 0.5, budget: float = 1.0, seed: int = 0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", copy_col: str = "mix_copy", key_col: str = "mix_key") -> DataFrame:
    """The columns of ``docs`` plus ``copy_col`` (from 0) and ``key_col``, in one global random order.

    The order is that of ``key_col`` over the partitions and within them; ties
    go by id and copy.  A document of rate r appears r times on average and may
    not appear at all.  Rows that repeat an id draw the same count; a null id
    draws as an empty one.  Columns that have the names of results are
    replaced.  Null sources are a source of their own, null and
    empty texts have size one.  An empty table gives an empty result.
    """
    rates = source_rates(docs, weights, exponent, budget, source_col, text_col)
    names = {c: fresh(docs, c) for c in ("source", "parts", "cdf", "count")}
    rates = rates.select(*(F.col(c).alias(names[c]) for c in ("source", "parts", "cdf")))
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)

    def drawn(part: Column) -> Column:
        u = (_digits(F.concat(F.lit(f"{seed}|"), _id(id_col), F.lit("|"), part.cast("string")), 13).cast("double") + 0.5) / float(1 << 52)
        return F.size(F.filter(names["cdf"], lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(0), F.col(names["parts"]) - 1), F.lit(0), lambda acc, part: acc + drawn(part))
    joined = docs.drop(copy_col, key_col).join(rates, F.col(source_col).eqNullSafe(F.col(names["source"])))
    counted = joined.withColumn(names["count"], count).where(F.col(names["count"]) > 0).drop(*(names[c] for c in ("source", "parts", "cdf")))
    copies = counted.withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col(names["count"]) - 1))).drop(names["count"])
    keyed = copies.withColumn(key_col, _digits(F.concat(F.lit(f"{seed}|key|"), _id(id_col), F.lit("|"), F.col(copy_col).cast("string")), _KEY_BITS // 4))
    # Keys are uniform, so equal ranges of them are the partitions: no sampling pass.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col(key_col) / F.lit(float(1 << _KEY_BITS)) * n), F.lit(n - 1)).cast("int")
    return keyed.repartitionById(n, part).sortWithinPartitions(key_col, id_col, copy_col)
