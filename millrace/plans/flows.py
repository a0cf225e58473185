"""Whole flows from the single operators: a chat turn, and search over documents in a file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import stripped
from millrace.operators import conversation, pca
from millrace.operators.nearest import nearest
from millrace.sources import cache, files
from millrace.sources.config import Settings
from millrace.sources.providers import QUERY, Chat, Embedding, HashEmbedding, embedded, embedding_provider, replies
from millrace.sources.shared import checkpointed


def chat_turn(log: DataFrame, said: DataFrame, provider: Chat, prompt: str = conversation.SYSTEM_PROMPT) -> tuple[DataFrame, DataFrame]:
    """The log after one more turn, and ``conv_id`` and ``error`` of the turns that failed.

    ``said`` has ``conv_id`` and ``text``, one row a conversation.  A new
    conversation begins with the system message.  Blank texts and ``quit`` are
    not sent.  A turn is added with its reply, or not at all.  Every reply is
    asked for once, and the results are checkpointed.
    """
    text = stripped(F.coalesce(F.col("text"), F.lit("")))
    sent = said.where((text != "") & (F.lower(text) != conversation.QUIT)).select("conv_id", F.lit("user").alias("role"), "text")
    begun = conversation.with_defaults(checkpointed(log), sent.select("conv_id"), prompt)
    asked = checkpointed(conversation.append(begun, sent))
    latest = conversation.resume_points(asked).select("conv_id", (F.col("next_turn") - 1).alias("turn"))
    wanted = conversation.contexts(asked).join(latest, ["conv_id", "turn"], "left_semi").join(sent.select("conv_id"), "conv_id", "left_semi")
    answers = checkpointed(replies(wanted, provider))
    kept = conversation.roll_back(asked, answers)
    done = answers.where(F.col("error").isNull()).select("conv_id", F.lit("assistant").alias("role"), F.col("reply").alias("text"))
    return checkpointed(conversation.append(kept, done)), answers.where(F.col("error").isNotNull()).select("conv_id", "error")


def semantic_search(spark: SparkSession, path: str, queries: Sequence[str], k: int = 3, cache_path: str | None = None, provider: Embedding | None = None, settings: Settings | None = None) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``topic``, ``text`` and ``score`` for the documents of a JSON file.

    Documents are embedded as passages, from the cache where one is given, and
    queries as queries.  ``provider``, or else the settings' mode, says by what;
    if their widths differ, as where a failing provider was replaced for one of
    the two only, that is an error.
    """
    settings = settings or Settings()
    provider = provider or embedding_provider(settings)
    docs = files.load_documents(spark, path)
    vectors = cache.embeddings(docs, cache_path, provider, "id", on_error=settings.on_error) if cache_path else embedded(docs, provider, "id")
    asked = embedded(spark.createDataFrame(list(enumerate(queries)), "id bigint, text string"), provider, "id", input_type=QUERY)
    found = nearest(asked.withColumnRenamed("embedding", "v"), vectors.withColumnRenamed("embedding", "v"), k, "cosine")
    return found.join(docs, "id").select("query_id", "rank", "id", "topic", "text", F.col("value").alias("score"))


def topic_map(spark: SparkSession, path: str, provider: Embedding | None = None) -> DataFrame:
    """``id``, ``topic``, ``pc1`` and ``pc2``: the documents' vectors along their first two components."""
    docs = files.load_documents(spark, path)
    vectors = embedded(docs, provider or HashEmbedding(), "id").withColumnRenamed("embedding", "v")
    scores = pca.project(vectors, pca.fit(vectors, 2), "id")
    return scores.join(docs, "id").select("id", "topic", F.col("scores")[0].alias("pc1"), F.col("scores")[1].alias("pc2"))
