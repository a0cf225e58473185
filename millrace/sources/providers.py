"""Chat and embedding providers, called for each partition.

A provider is an object that can be pickled.  ``HashEmbedding`` and ``EchoChat``
need no network; the HTTP ones speak the common JSON forms.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.error
import urllib.request
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.config import Settings

# Time limit of a chat request in seconds, and characters shown of an error's body.
CHAT_TIMEOUT, SHOWN = 30.0, 200

PASSAGE, QUERY = "passage", "query"


class ProviderError(RuntimeError):
    """What went wrong, in words for the caller."""


class Chat(Protocol):
    def reply(self, messages: Sequence[dict]) -> str: ...


class Embedding(Protocol):
    mode: str

    def embed(self, texts: Sequence[str], input_type: str) -> list[list[float]]: ...


def _post(url: str, key: str, body: dict, timeout: float | None) -> dict:
    late = f"{url} gave no answer within {timeout} seconds"
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.load(answer)
    except urllib.error.HTTPError as e:
        raise ProviderError(f"HTTP error {e.code}: {e.read().decode(errors='replace')[:SHOWN]}") from e
    except TimeoutError as e:
        raise ProviderError(late) from e
    except urllib.error.URLError as e:
        raise ProviderError(late if isinstance(e.reason, TimeoutError) else f"Could not connect to {url}: {e.reason}") from e


@dataclass(frozen=True)
class EchoChat:
    """Answers with the number of messages and the last one's text."""

    def reply(self, messages: Sequence[dict]) -> str:
        return f"[{len(messages)}] {messages[-1]['content']}"


@dataclass(frozen=True)
class HttpChat:
    url: str
    model: str
    key: str
    timeout: float = CHAT_TIMEOUT

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("an API key is needed")

    def reply(self, messages: Sequence[dict]) -> str:
        found = _post(self.url, self.key, {"model": self.model, "messages": list(messages)}, self.timeout)
        return found["choices"][0]["message"]["content"]


@dataclass(frozen=True)
class HashEmbedding:
    """The hashed bag of words, as ``millrace.functions.text`` has it for columns."""

    dim: int = 64
    mode: str = "offline"

    def embed(self, texts: Sequence[str], input_type: str = PASSAGE) -> list[list[float]]:  # noqa: ARG002
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[float]:
        counts = [0] * self.dim
        for found in re.finditer("[a-z']+", text.lower()):
            counts[int.from_bytes(hashlib.md5(found[0].encode()).digest(), "big") % self.dim] += 1
        root = math.sqrt(sum(c * c for c in counts))
        return [c / root for c in counts] if root else [0.0] * self.dim


@dataclass(frozen=True)
class HttpEmbedding:
    url: str
    model: str
    key: str
    timeout: float = 60.0
    mode: str = "api"

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("an API key is needed")

    def embed(self, texts: Sequence[str], input_type: str = PASSAGE) -> list[list[float]]:
        found = _post(self.url, self.key, {"model": self.model, "input": list(texts), "input_type": input_type}, self.timeout)
        return [row["embedding"] for row in found["data"]]


def embedding_provider(settings: Settings) -> Embedding:
    """The provider that the settings' mode names."""
    if settings.mode == "api":
        return HttpEmbedding(settings.embedding_url, settings.embedding_model, settings.key())
    return HashEmbedding()


def chat_provider(settings: Settings) -> Chat:
    """The chat that the settings name; without a key there is none."""
    return HttpChat(settings.chat_url, settings.chat_model, settings.key())


def embed_texts(texts: Sequence[str], settings: Settings, input_type: str = PASSAGE) -> list[list[float]]:
    """Vectors of a few texts by the settings' mode; with ``on_error`` ``fallback`` all are made offline if the provider fails."""
    try:
        return embedding_provider(settings).embed(texts, input_type)
    except ProviderError:
        if settings.on_error != "fallback":
            raise
        return HashEmbedding().embed(texts, input_type)


def replies(contexts: DataFrame, provider: Chat) -> DataFrame:
    """``conv_id``, ``turn``, ``reply`` and ``error`` for the rows of ``conversation.contexts``; one of the last two is null."""
    rows = contexts.select("conv_id", "turn", "context")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for context in batch.column(2).to_pylist():
                try:
                    made.append((provider.reply([{"role": m["role"], "content": m["text"]} for m in context]), None))
                except ProviderError as e:
                    made.append((None, str(e)))
            columns = [pa.array([m[i] for m in made], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["conv_id", "turn", "reply", "error"])

    return rows.mapInArrow(run, "conv_id bigint, turn bigint, reply string, error string")


def embedded(docs: DataFrame, provider: Embedding, id_col: str = "doc_id", text_col: str = "text", input_type: str = PASSAGE, batch_size: int = 32) -> DataFrame:
    """``id_col`` and ``embedding`` by a provider, in requests of ``batch_size`` texts; null texts count as empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, made = batch.column(1).to_pylist(), []
            for at in range(0, len(texts), batch_size):
                made += provider.embed(texts[at : at + batch_size], input_type)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["id", "embedding"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, embedding array<double>").withColumnRenamed("id", id_col)
