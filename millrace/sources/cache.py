"""A Parquet cache of embeddings that holds what a text's hash says it holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.embedding import embed
from millrace.operators.tables import likely
from millrace.sources.files import _path
from millrace.sources.providers import PASSAGE, Embedding, HashEmbedding, ProviderError, embedded
from millrace.sources.shared import materialize


#: New hashes that are sent to all tasks at most, 64 bytes each.
BROADCAST_HASHES = 100_000
SCHEMA = "content_hash string, dim int, embedding array<double>"


def _hash(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _stored(spark: SparkSession, folder: str) -> DataFrame:
    where, store = _path(spark, folder)
    return spark.read.schema(SCHEMA).parquet(folder) if store.exists(where) else spark.createDataFrame([], SCHEMA)


def missing(docs: DataFrame, path: str, mode: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids of the documents whose text the cache does not have under this mode, once for each row."""
    held = _stored(docs.sparkSession, f"{path.rstrip('/')}/mode={mode}").select("content_hash")
    return docs.select(id_col, _hash(text_col).alias("content_hash")).join(held, "content_hash", "left_anti").select(id_col)


def _made(new: DataFrame, provider: Embedding) -> DataFrame:
    """``content_hash`` and ``embedding`` of ``new(content_hash, body)``; offline vectors are made in the JVM."""
    if type(provider) is HashEmbedding:
        return embed(new, "body", provider.dim).select("content_hash", "embedding")
    return embedded(new, provider, "content_hash", "body", PASSAGE)


def embeddings(docs: DataFrame, path: str, provider: Embedding, id_col: str = "doc_id", text_col: str = "text", on_error: str = "fail") -> DataFrame:
    """``id_col`` and ``embedding`` of every row of ``docs``, from the cache at ``path`` where it has the text.

    Entries are keyed by the hash of the text and the provider's mode, so an
    edited text is embedded again, equal texts are embedded once whatever their
    ids, and modes don't mix; ids may repeat or be null.  What is shuffled to
    find out is hashes.  Texts stay where they are for the offline provider; for
    others those that the cache lacks move, so that each is asked for once.
    New rows are written first; rows of another width than the mode's are an
    error and nothing is kept.  With ``on_error`` ``fallback`` a failing provider
    is replaced by the offline one for the whole call, under its own mode.
    """
    if on_error not in ("fail", "fallback"):
        raise ValueError("on_error must be fail or fallback")
    spark = docs.sparkSession
    folder = f"{path.rstrip('/')}/mode={provider.mode}"
    keyed = docs.select(F.col(id_col).alias("id"), _hash(text_col).alias("content_hash"))
    wanted = materialize(keyed.select("content_hash").distinct().join(_stored(spark, folder).select("content_hash"), "content_hash", "left_anti"))
    bodies = docs.select(_hash(text_col).alias("content_hash"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    few = wanted.limit(BROADCAST_HASHES + 1).count() <= BROADCAST_HASHES
    if type(provider) is HashEmbedding:
        # Vectors are made where the texts are, and only vectors move: of the new texts, and where these are many of the few others that the filter lets through.
        made = _made(bodies.join(F.broadcast(wanted), "content_hash", "left_semi"), provider) if few else _made(likely(bodies, "content_hash", wanted), provider).join(wanted, "content_hash", "left_semi")
        made = made.dropDuplicates(["content_hash"])
    else:
        made = _made(bodies.join(F.broadcast(wanted) if few else wanted, "content_hash", "left_semi").dropDuplicates(["content_hash"]), provider)
    side = f"{path.rstrip('/')}/_new"
    try:
        made.select("content_hash", F.size("embedding").alias("dim"), "embedding").write.mode("overwrite").parquet(side)
    except Exception as e:
        if on_error == "fallback" and ProviderError.__name__ in str(e):
            return embeddings(docs, path, HashEmbedding(), id_col, text_col)
        raise
    fresh = spark.read.schema(SCHEMA).parquet(side)
    widths = fresh.select("dim").union(_stored(spark, folder).select("dim")).distinct().limit(2).count()
    if widths > 1:
        raise ValueError(f"embeddings of mode {provider.mode} differ in width")
    fresh.write.mode("append").parquet(folder)
    # Two writers at a time may both have added a text.
    held = _stored(spark, folder).dropDuplicates(["content_hash"])
    return keyed.join(held, "content_hash").select(F.col("id").alias(id_col), "embedding")
