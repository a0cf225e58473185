"""Tables in the folder that the cluster shares: results kept for later jobs, and blocks that Python workers read."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT = "spark.checkpoint.dir"
_folders: list[tuple[SparkSession, str]] = []


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would use for it, so that Python workers use the same."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return re.sub("^file:/(?!/)", "file:///", store.makeQualified(found).toString())


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Where the setting is absent a temporary folder is used, but only under a
    ``local`` master: there the driver and the tasks are one process.
    """
    base = spark.conf.get(_CHECKPOINT, None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError(f"set {_CHECKPOINT} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set(_CHECKPOINT, base)
    folder = qualified(spark, f"{base.rstrip('/')}/millrace-{uuid.uuid4().hex}")
    _folders.append((spark, folder))
    return folder


def written(df: DataFrame) -> str:
    """The path of ``df`` as a Parquet table in the shared folder."""
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of the table, never
    the work before it, and values such as generated ids stay what they were.
    """
    path = written(df)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def mark() -> int:
    """A point in time for ``drop_since``."""
    return len(_folders)


def drop_since(point: int, *keep: DataFrame) -> None:
    """Delete the shared tables written since ``point``, apart from those that ``materialize`` returned as ``keep``; nothing may still read them."""
    kept = {df.stored_at for df in keep}
    for entry in _folders[point:]:
        if entry[1] not in kept:
            _drop(entry)


def drop_shared(spark: SparkSession | None = None) -> None:
    """Delete the shared tables written so far; results that read them end too."""
    for entry in list(_folders):
        if spark is None or entry[0] is spark:
            _drop(entry)


def _drop(entry: tuple[SparkSession, str]) -> None:
    owner, folder = entry
    path = owner.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    _folders.remove(entry)


def _at_exit() -> None:
    # The gateway may already be gone; the cluster's own cleaning then applies.
    try:
        drop_shared()
    except Exception:
        _folders.clear()


atexit.register(_at_exit)


def file_system(uri: str):
    """The ``pyarrow`` file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def blocks(path: str, rows: int) -> Iterator:
    """The record batches of a table that ``written`` made, of at most ``rows`` rows each; for Python workers."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, where = file_system(path)
    for found in sorted(f.path for f in store.get_file_info(fs.FileSelector(where)) if f.path.endswith(".parquet")):
        with store.open_input_file(found) as file:
            yield from pq.ParquetFile(file).iter_batches(batch_size=rows)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed now and kept in the shared folder; a lost executor doesn't compute it again."""
    return materialize(df)
