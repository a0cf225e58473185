"""Tables in versions: readers always see a whole one.

A version's rows are a folder that Spark commits; it counts from the moment its
manifest is put in place, by one rename to a name that only its writer has
claimed.  Whatever is cut off before that leaves a folder that nothing names.
"""

from __future__ import annotations

import json
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from millrace.sources.files import _path

_MANIFESTS, _CLAIMS, _DATA = "_manifests", "_claims", "data"


def _names(spark: SparkSession, folder: str) -> list[str]:
    where, store = _path(spark, folder)
    return [s.getPath().getName() for s in store.listStatus(where)] if store.exists(where) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's versions, in order."""
    return sorted(int(x) for x in _names(spark, f"{path.rstrip('/')}/{_MANIFESTS}") if x.isdigit())


def _manifest(spark: SparkSession, path: str, version: int) -> dict:
    where, store = _path(spark, f"{path.rstrip('/')}/{_MANIFESTS}/{version}")
    return json.loads(spark.read.text(store.makeQualified(where).toString(), wholetext=True).first().value)


def stage(df: DataFrame, path: str) -> str:
    """Write the rows of a version that doesn't count yet; the name of its folder."""
    name = uuid.uuid4().hex
    df.write.parquet(f"{path.rstrip('/')}/{_DATA}/{name}")
    return name


def _created(spark: SparkSession, folder: str, name: str) -> bool:
    """Whether the file is new; of several callers at a time only one makes it."""
    where, store = _path(spark, f"{folder}/{name}")
    store.mkdirs(where.getParent())
    if store.getScheme() == "file":  # there the store's own call looks first and creates then
        return spark.sparkContext._jvm.java.io.File(where.toUri().getPath()).createNewFile()
    try:
        return store.createNewFile(where)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise


def claim(spark: SparkSession, path: str) -> int:
    """A version's number that no other writer has: the least above all that were claimed."""
    top = path.rstrip("/")
    while True:
        number = max([0, *(int(x) for x in _names(spark, f"{top}/{_CLAIMS}") if x.isdigit()), *versions(spark, path)]) + 1
        if _created(spark, f"{top}/{_CLAIMS}", str(number)):
            return number


def publish(spark: SparkSession, path: str, name: str, schema: StructType, number: int) -> int:
    """Make a staged folder the version of a claimed number."""
    top = path.rstrip("/")
    side, store = _path(spark, f"{top}/_side-{uuid.uuid4().hex}")
    out = store.create(side)
    out.write(bytearray(json.dumps({"folder": name, "schema": schema.jsonValue(), "at": time.time()}).encode()))
    out.close()
    store.mkdirs(_path(spark, f"{top}/{_MANIFESTS}")[0])
    if not store.rename(side, _path(spark, f"{top}/{_MANIFESTS}/{number}")[0]):
        raise OSError(f"version {number} of {path} can't be put in place")
    return number


def save_version(df: DataFrame, path: str) -> int:
    """Write ``df``, which may read the table itself, as the next version; its number.

    Of two writers at a time each makes a version, and the higher number is the
    table.  The number is claimed when the rows are there, so a version never
    waits for a slow one below it.
    """
    spark = df.sparkSession
    name = stage(df, path)
    return publish(spark, path, name, df.schema, claim(spark, path))


def load_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the table, the last one otherwise; what is written later doesn't change it."""
    there = versions(spark, path)
    if not there or version is not None and version not in there:
        raise ValueError(f"{path} has no version" + (f" {version}" if version is not None else ""))
    told = _manifest(spark, path, there[-1] if version is None else version)
    return spark.read.schema(StructType.fromJson(told["schema"])).parquet(f"{path.rstrip('/')}/{_DATA}/{told['folder']}")


def drop_versions(spark: SparkSession, path: str, keep: int = 2, older_s: float = 86_400.0) -> None:
    """Delete all versions but the last ``keep``, and folders older than ``older_s`` seconds that no version names.

    Readers of a version that is deleted fail, so ``keep`` must span what the
    longest of them takes.  Manifests go before their rows.
    """
    if keep < 1:
        raise ValueError("keep must be positive")
    top, there = path.rstrip("/"), versions(spark, path)
    for number in there[:-keep]:
        where, store = _path(spark, f"{top}/{_MANIFESTS}/{number}")
        store.delete(where, False)
    named = {_manifest(spark, path, n)["folder"] for n in there[-keep:]}
    gone = {n for n in _names(spark, f"{top}/{_DATA}") if n not in named}
    for name in gone:
        where, store = _path(spark, f"{top}/{_DATA}/{name}")
        if time.time() - store.getFileStatus(where).getModificationTime() / 1000 >= older_s:
            store.delete(where, True)
