"""Documents and conversations in files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "id bigint, topic string, text string"
MESSAGE = "role string, content string"
OK, MISSING, CORRUPT = "ok", "missing", "corrupt"


def _path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def load_documents(spark: SparkSession, path: str, schema: str = DOCUMENT, lines: bool = False) -> DataFrame:
    """Documents of a JSON array, or with ``lines`` of one object a line, which Spark splits; a missing text is empty, broken files are errors."""
    docs = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    return docs.withColumn("text", F.coalesce("text", F.lit(""))) if "text" in docs.columns else docs


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load_history(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """Status and messages (``turn``, ``role``, ``content``) of one conversation's JSON array.

    The status is ``ok``, ``missing`` or ``corrupt``; without ``ok`` there are
    no rows.  An empty array is ``ok``, an empty file is ``corrupt``.
    """
    empty = spark.createDataFrame([], f"turn bigint, {MESSAGE}")
    where, store = _path(spark, path)
    if not store.exists(where):
        return MISSING, empty
    whole = spark.read.text(path, wholetext=True)
    parsed = whole.select(F.try_parse_json("value").alias("json"), F.from_json("value", f"array<struct<{MESSAGE.replace(' string', ':string')}>>").alias("messages"))
    if not parsed.where(F.col("json").isNotNull() & F.col("messages").isNotNull()).count():
        return CORRUPT, empty
    return OK, parsed.select(F.posexplode("messages").alias("turn", "m")).select(F.col("turn").cast("bigint").alias("turn"), "m.role", "m.content")


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Replace the table at ``path`` by ``df``, which may read it.

    The new table is written beside the old one, the old one moved aside, the
    new one moved in, and the old one deleted last: whenever this is cut off,
    one of the two is there whole, as ``path`` or beside it.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    side, aside = (f"{path.rstrip('/')}.{word}-{mark}" for word in ("new", "old"))
    df.write.format(kind).save(side)
    where, store = _path(spark, path)
    old = _path(spark, aside)[0]
    replaces = store.exists(where)
    if replaces and not store.rename(where, old):
        raise OSError(f"{path} could not be moved to {aside}")
    if not store.rename(_path(spark, side)[0], where):
        if replaces:
            store.rename(old, where)
        raise OSError(f"{side} could not be moved to {path}")
    if replaces:
        store.delete(old, True)


def save_histories(log: DataFrame, path: str) -> None:
    """Replace the conversations at ``path``, one JSON object of ``conv_id`` and ``messages`` a line."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    message = F.transform(rows, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["text"], F.lit("")).alias("content")))
    save(log.groupBy("conv_id").agg(message.alias("messages")), path, "json")


def load_histories(spark: SparkSession, path: str) -> DataFrame:
    """``conv_id``, ``turn`` (from 0), ``role`` and ``text`` of what ``save_histories`` wrote; broken lines are errors."""
    rows = spark.read.schema(f"conv_id bigint, messages array<struct<{MESSAGE.replace(' string', ':string')}>>").option("mode", "FAILFAST").json(path)
    return rows.select("conv_id", F.posexplode("messages").alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("m.role").alias("role"), F.col("m.content").alias("text"))


def history_json(log: DataFrame) -> DataFrame:
    """``conv_id`` and ``json``, each conversation as one array of messages in order."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    message = F.transform(rows, lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content")))
    return log.groupBy("conv_id").agg(F.to_json(message, {"pretty": "true"}).alias("json"))
