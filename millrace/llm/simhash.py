"""SimHash near-duplicate classes by multi-index hashing.

Fingerprints are made in one pass over the texts.  Links are looked for between
*distinct* fingerprints only, so any number of copies costs one row.  A
fingerprint is cut into two 32-bit segments; two fingerprints that differ in at
most three bits differ in at most one bit in one of the segments.  Each
fingerprint is entered in a table under its two segment values, the ball of
radius one around each of its segments is enumerated (33 values), table matches
are fetched by an equi-join and the complete distance is verified inside that
join.  Connected components come from alternating star contractions, which
aggregate minima and never gather a component in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm._shared import bounded_batches, fresh, materialize, text_key, utf8
from millrace.llm.graphs import components
from millrace.llm.similar import similar_links

_PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included.

    A-Z are lower-cased and words end at ASCII white space.  A text with fewer
    words than ``shingle`` has one shingle, its whole sequence of words; a text
    without words has the fingerprint zero.  A bit is set if it is set in more
    than half of the shingles' XXH64 values.
    """
    words = text.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(b" ".join(words), seed)]
    else:
        hashes = [digest(b" ".join(w), seed) for w in zip(*(words[i:] for i in range(shingle)), strict=False)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PIECE):
        part = np.array(hashes[at : at + _PIECE], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns ``keep`` and the fingerprint ``fp`` of each row's text (bigint, two's complement); null texts count as empty."""
    rows = bounded_batches(docs).select(*keep, utf8(F.col(text_col)).alias(fresh(docs, "body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(x.as_py(), shingle, seed) for x in batch.column(len(keep))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made.view(np.int64))], [*keep, "fp"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields[:-1], StructField("fp", LongType())]))


def hamming_links(fps: DataFrame, distance: int = 3) -> DataFrame:
    """All pairs ``a < b`` of the distinct ``fp`` values that differ in 1 to ``distance`` bits.

    A pair may be listed once for each segment that finds it.  ``distance`` is
    at most 3: two segments, balls of radius 1.
    """
    if not 0 <= distance <= 3:
        raise ValueError("distance must be from 0 to 3")
    segments = [F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))]
    tagged = [s.bitwiseOR(F.lit(i << 32)) for i, s in enumerate(segments)]
    table = fps.select(F.explode(F.array(*tagged)).alias("key"), F.col("fp").alias("b"))
    flips = [0, *(1 << i for i in range(32))]
    ball = F.array(*(t.bitwiseXOR(F.lit(f).cast("bigint")) for t in tagged for f in flips))
    probes = fps.select(F.explode(ball).alias("key"), F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return probes.join(table, "key").where((F.col("a") < F.col("b")) & near).select("a", "b")


def _roots(made: DataFrame, distance: int, more: DataFrame | None = None) -> DataFrame:
    """``fp`` and the least fingerprint ``root`` of its component, for the distinct fingerprints of ``made``; ``more`` has further links."""
    distinct = made.select("fp").distinct()
    links = hamming_links(distinct, distance)
    linked = components(links if more is None else links.union(more)).withColumnRenamed("node", "fp")
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``fp`` and ``component_id``.

    ``component_id`` is the least id that is reachable over fingerprints at
    most ``distance`` bits apart, the row's own id included.  Null and empty
    texts share the fingerprint zero and are linked like any other.  Repeated
    rows stay repeated.  Null ids are passed over for ``component_id``, which
    is null only where every id of the class is.  An empty table gives an
    empty result; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    made = materialize(fingerprints(rows, ["id"], "body", shingle, seed))
    linked = made.groupBy("fp").agg(F.min("id").alias("least")).join(_roots(made, distance), "fp")
    lows = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = linked.join(lows, "root").select("fp", "component_id")
    return made.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42, similarity: float | None = None, words: int = 5) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class that of the least id stays.

    Classes are those of ``near_duplicates``.  With ``similarity`` texts are
    also linked if the Jaccard similarity of their shingles of ``words`` words
    is at least that, however many bits they differ in.  Null ids count as largest; rows
    that share the id are told apart by a hash of the text, and of rows that
    share both one stays.  The columns are those of ``docs``.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), *text_key(F.col(text_col)))
    m1, m2 = F.xxhash64(key), F.xxhash64(F.lit(1), key)
    mark = F.struct(m1.alias("m1"), m2.alias("m2"))
    names = [fresh(docs, "m1"), fresh(docs, "m2")]
    rows = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), mark.alias("mark"), F.col(text_col).alias("body"))
    made = materialize(fingerprints(rows, ["id", "t1", "t2", "mark"], "body", shingle, seed))
    more = None
    if similarity is not None:
        prints = made.select("t1", "fp").distinct()
        more = similar_links(docs, text_col, words, similarity)
        for end in ("a", "b"):
            more = more.join(prints.withColumnsRenamed({"t1": end, "fp": f"fp_{end}"}), end)
        more = more.select(F.col("fp_a").alias("a"), F.col("fp_b").alias("b"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2", "mark")).alias("least")
    # The least of each fingerprint first, so that copies are gone before the classes meet.
    first = made.groupBy("fp").agg(least).join(_roots(made, distance, more), "fp")
    kept = first.groupBy("root").agg(F.min("least").alias("least")).select(*(F.col(f"least.mark.m{i + 1}").alias(n) for i, n in enumerate(names)))
    # Marks of classes differ, so this finds a row once.  By the hint and plain columns the texts are dealt out once, for the
    # join and for what repeats: a broadcast that Spark finds when they are dealt out already would do it again.
    return docs.withColumns(dict(zip(names, (m1, m2), strict=True))).join(kept.hint("merge"), names).dropDuplicates(names).drop(*names)
