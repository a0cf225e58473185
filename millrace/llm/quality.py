"""Quality classifier from supervised subword embeddings.

A document's features are hashed words, word pairs and character n-grams; it is
represented by the mean of their learned vectors, which a softmax layer turns
into class probabilities.  Vectors and layer are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled documents.  With two
classes a document's log odds are the mean of one number per bucket, so that
scoring needs one small table and one pass over the texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm._shared import bounded_batches, fresh, materialize, text_key, utf8

#: At most so many labelled documents are learnt from, those with the least hash of their id, then by label and text,
SAMPLE_ROWS = 3000
#: and of these, in the same order, as many as have features of so many bytes in all; one that is too large is passed over.
SAMPLE_BYTES = 64 << 20
BUCKET_BITS = 17
DIMENSIONS = 8
EPOCHS = 6
RATE = 1.0
NGRAMS = (2, 3, 4)

_CHUNK = 1 << 18
_MUL = 0x9E3779B97F4A7C15
_held: dict[str, np.ndarray] = {}


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, made once in each process."""
    if not _held:
        for name, base in (("power", _MUL), ("back", pow(_MUL, -1, 1 << 64))):
            _held[name] = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * _CHUNK, base, np.uint64)]))
    return _held["power"], _held["back"]


def _chunks(text: bytes) -> Iterator[bytes]:
    """Parts of bounded length that end after white space where there is any."""
    at = 0
    while at < len(text):
        end = at + _CHUNK
        if end < len(text):
            space = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = space + 1 if space > at else end
        yield text[at:end]
        at = end


def _buckets(hashes: np.ndarray, kind: int) -> np.ndarray:
    mixed = (hashes + np.uint64(kind * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def features(text: bytes) -> Iterator[np.ndarray]:
    """Buckets of all features of a text, part by part: words, word pairs, pairs of equal words, character n-grams.

    Pairs of equal words share one bucket, whatever the word: a word that a
    sample never had twice in a row is known as such a pair all the same.
    """
    power, back = _powers()
    for part in _chunks(text):
        a = np.frombuffer(part, np.uint8)
        n = len(a)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[:n], out=sums[1:])
        space = (a == 32) | ((a >= 9) & (a <= 13))
        edge = np.diff(np.concatenate(([True], space, [True])).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        words = (sums[end] - sums[start]) * back[start]
        yield _buckets(words, 1)
        if len(words) > 1:
            yield _buckets(words[1:] * np.uint64(31) + words[:-1], 2)
            same = np.count_nonzero(words[1:] == words[:-1])
            if same:
                yield np.repeat(_buckets(np.zeros(1, np.uint64), 3), same)
        for k in NGRAMS:
            if n >= k:
                yield _buckets((sums[k:] - sums[:-k]) * back[: n - k + 1], 3 + k)


def feature_counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of its features."""
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for part in features(text):
        counts += np.bincount(part, minlength=1 << BUCKET_BITS)
    held = np.flatnonzero(counts)
    return held.astype(np.int32), (counts[held] / max(1, counts.sum())).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    """Log odds per bucket, and those of a text without features."""

    odds: np.ndarray
    bias: float

    def score(self, text: bytes) -> float:
        """The probability of label 1."""
        total, n = 0.0, 0
        for part in features(text):
            total += float(self.odds[part].sum(dtype=np.float64))
            n += len(part)
        return 1 / (1 + np.exp(-np.clip(total / max(1, n) + self.bias, -500, 500)))


def train(examples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> QualityModel:
    """Fit vectors and softmax layer to (label, buckets, shares) by stochastic gradient descent.

    Without examples every score is one half.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5, 0.5, (1 << BUCKET_BITS, DIMENSIONS))
    layer = np.zeros((2, DIMENSIONS))
    # The classes' shares set the bias: what a text without features gets.
    bias = np.log(np.bincount([e[0] for e in examples], minlength=2) + 1.0)
    steps, done = max(1, epochs * len(examples)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, buckets, shares = examples[i]
            lr = rate * (1 - done / steps)
            done += 1
            mean = shares @ vectors[buckets]
            logits = layer @ mean + bias
            p = np.exp(logits - logits.max())
            wrong = p / p.sum()
            wrong[label] -= 1
            pull = layer.T @ wrong
            layer -= lr * np.outer(wrong, mean)
            # A step over the sum of squared shares moves the mean as far for long texts as for short ones.
            vectors[buckets] -= (lr / 4 * shares / max(1e-12, float(shares @ shares)))[:, None] * pull
    return QualityModel((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> QualityModel:
    """Learn from at most ``sample_rows`` labelled documents, whose features take at most ``sample_bytes``.

    Only id and label of ``labels`` and id and text of ``docs`` are read; the id
    only joins the two.  Null ids and labels other than 0 and 1 are left out,
    null texts count as empty, and a document that is labelled or listed more
    than once counts each time.  The features are made on the executors, a very
    long text's have at most one entry a bucket; the driver gets the sizes, then
    the features that fit.  The same rows give the same model, however they are
    partitioned.  Empty tables give a model that scores one half.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    keys = docs.select(F.col(id_col).alias("id"), *text_key(F.col(text_col))).join(known, "id")
    drawn = keys.orderBy(F.xxhash64("id"), "id", "label", "t1", "t2").limit(sample_rows)
    # Rows that are equal in all of it have equal features: they are made once and counted.
    sample = F.broadcast(drawn.groupBy("id", "label", "t1", "t2").agg(F.count("*").alias("times")))
    rows = bounded_batches(docs).select(F.col(id_col).alias("id"), *text_key(F.col(text_col)), utf8(F.col(text_col)).alias("body")).join(sample, ["id", "t1", "t2"])
    rows = rows.select("id", "label", "t1", "t2", "times", "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [feature_counts(x.as_py()) for x in batch.column(5)]
            packed = [zlib.compress(np.diff(b, prepend=np.int32(0)).tobytes() + s.tobytes(), 1) for b, s in made]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([8 * len(b) for b, _ in made], pa.int64()), pa.array(packed, pa.binary())], ["id", "label", "t1", "t2", "times", "bytes", "packed"])

    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id {kind}, label int, t1 bigint, t2 bigint, times bigint, bytes bigint, packed binary")
    made = materialize(made.dropDuplicates(["id", "label", "t1", "t2"]).withColumn("place", F.xxhash64("id")))
    order, used, chosen = ["place", "id", "label", "t1", "t2"], 0, []
    for r in made.select(*order, "bytes").orderBy(*order).collect():  # at most ``sample_rows``
        if used + r.bytes <= sample_bytes:
            used += r.bytes
            chosen.append((r.id, r.label, r.t1, r.t2))
    if not chosen:
        return train([])
    wanted = made.sparkSession.createDataFrame(chosen, f"id {kind}, label int, t1 bigint, t2 bigint")
    got = made.join(F.broadcast(wanted), ["id", "label", "t1", "t2"]).orderBy(*order).select("label", "times", "bytes", "packed").toArrow()
    # One array of each kind for all examples: large blocks go back to the system when learning is over, many small ones don't.
    ends = np.concatenate(([0], np.cumsum(got.column("bytes").to_numpy() // 8)))
    buckets, shares = np.empty(ends[-1], np.int32), np.empty(ends[-1], np.float32)
    examples = []
    for i, (label, times, packed) in enumerate(zip(got.column("label").to_pylist(), got.column("times").to_pylist(), got.column("packed"), strict=True)):
        part, held = slice(ends[i], ends[i + 1]), np.frombuffer(zlib.decompress(packed.as_buffer()), np.int32)
        np.cumsum(held[: len(held) // 2], out=buckets[part])
        shares[part] = held[len(held) // 2 :].view(np.float32)
        examples += [(label, buckets[part], shares[part])] * times
    return train(examples)


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of label 1; it takes the place of a column of that name.

    Null texts count as empty, an empty one gets the share of label 1 among the
    examples.  Rows are scored one by one: equal texts get equal scores, repeated
    rows and null ids stay, very long texts are read whole, part by part.  An
    empty table gives an empty result.
    """
    docs = docs.drop(name)
    body = fresh(docs, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([model.score(x.as_py()) for x in batch.column(batch.num_columns - 1)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], name])

    out = bounded_batches(docs).withColumn(body, utf8(F.col(text_col)))
    return out.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, DoubleType())]))
