"""The corpus pipeline: documents in, packed sequences out.

Every stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and
read again as the next stage's ``docs``, and the tables that it needed on the way
are deleted.  All stages but the last return the columns of ``documents``, extra
ones included, whatever their names.

In every stage null texts count as empty, repeated rows and null ids are rows
like others, very long texts are treated whole, and an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._shared import drop_since, fresh, mark, materialize
from millrace.llm.mixing import replicate
from millrace.llm.packing import pack
from millrace.llm.quality import fit, score
from millrace.llm.queries import held_out
from millrace.llm.simhash import keep_one
from millrace.llm.suffix_dedup import deduplicate


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more; the classifier is learnt from the labels outside the held-out fold.

    Without any labels all score one half and stay.  Equal texts share a fate.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out("doc_id"))
    name = fresh(docs, "score")
    return score(docs, fit(docs, labels), name=name).where(F.col(name) >= 0.5).drop(name)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """One document of each class of near-duplicates: fingerprints at most three bits apart, or a similarity of 0.8 or more by shingles of five words.

    The one of the least id stays; null ids count as largest, and of rows that share the id that of the least hash of its text.
    Texts without words share a fingerprint, so one of them stays.
    """
    return keep_one(docs, similarity=0.8, words=5)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """All documents, without the text that lies in strings of 200 bytes found more than once; n_chars follows the text.

    Every copy of a passage goes, as the operator has it: a text that is nothing else stays as an empty one.
    Texts shorter than 200 bytes are left as they are.
    """
    prefix = "kept_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    made = deduplicate(docs, width=200, keep_text=True, prefix=prefix)
    text = F.col(f"{prefix}kept")
    changed = {"text": text.alias("text"), "n_chars": F.length(text).cast("bigint").alias("n_chars")}
    return made.select(*(changed.get(c, F.col(c)) for c in docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Documents repeated, or left out, so that sources have shares that go with the square root of their sizes, in random order.

    A null source is a source of its own; rows that share an id draw the same count.
    """
    return replicate(docs, seed=17, copy_col=fresh(docs, "copy"), key_col=fresh(docs, "order")).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """The documents' pieces, with their ids, in sequences of at most 2048 tokens.

    ``row`` numbers the input's rows: copies that mixing has made differ in it.
    """
    return pack(docs, capacity=2048, keep_ids=True, row_col="row")


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_near_dedup),
    ("suffix-array dedup", suffix_array_dedup),
    ("mixing sources to target weights", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Learning, sorting and packing are beyond SQL; the tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the table ``documents``."""
    docs, start = spark.read.parquet(f"{sf_dir}/documents.parquet"), mark()
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        drop_since(start, docs)
    return STAGES[-1][1](spark, docs, sf_dir)
