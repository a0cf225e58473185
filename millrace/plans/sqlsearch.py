"""Search from SQL text: a table function over any table of ids and texts.

After ``register(spark)``::

    SELECT * FROM text_search(TABLE(SELECT doc_id, text FROM documents), 'some words', 10)

gives each task's best rows, of which ``search_sql`` takes the best of all.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import DIMENSIONS

NAME = "text_search"


def _bag(text: str) -> Counter:
    """How many of a text's words fall into each bucket, as ``millrace.functions.text`` has it."""
    words = Counter(m[0] for m in re.finditer("[a-z']+", text.lower()))
    out: Counter = Counter()
    for word, n in words.items():
        out[int.from_bytes(hashlib.md5(word.encode()).digest(), "big") % DIMENSIONS] += n
    return out


class _Search:
    """Keeps the best k rows of a task; ties go to the larger id."""

    def __init__(self) -> None:
        self.best, self.name, self.kind, self.k = [], None, None, 0

    def eval(self, table: pa.RecordBatch, query: pa.Array, k: pa.Array) -> Iterator[pa.Table]:
        if self.name is None:
            self.name, self.kind, self.k = "id", table.schema.types[0], k[0].as_py()
            if table.num_columns != 2 or self.k is None or self.k < 1:
                raise ValueError("text_search takes a table of an id and a text, a query, and a positive k")
            self.asked = _bag(query[0].as_py() or "")
            self.size = sum(n * n for n in self.asked.values())
        found = []
        for key, text in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
            bag = _bag(text or "")
            size = sum(n * n for n in bag.values())
            product = sum(n * self.asked[b] for b, n in bag.items() if b in self.asked)
            found.append((product / (math.sqrt(size) * math.sqrt(self.size)) if size and self.size else 0.0, key))
        self.best = sorted([*self.best, *found], key=lambda x: (x[0], x[1] is not None, x[1]), reverse=True)[: self.k]
        return iter(())

    def terminate(self) -> Iterator[pa.Table]:
        if self.best:
            yield pa.table({self.name: pa.array([x for _, x in self.best], self.kind), "score": pa.array([s for s, _ in self.best], pa.float64())})


def register(spark: SparkSession, id_type: str = "bigint") -> None:
    """Make ``text_search(TABLE(...), query, k)`` known to SQL text in this session, for ids of one type; it gives ``id`` and ``score``."""
    spark.udtf.register(NAME, F.arrow_udtf(_Search, returnType=f"id {id_type}, score double"))


def search_sql(table: str, query: str, k: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """SQL text for the best k rows of a table, with their rank; no task gets more than its part of the table, and k rows of the others."""
    said = query.replace("\\", "\\\\").replace("'", "\\'")
    return f"""SELECT CAST(row_number() OVER (ORDER BY score DESC, id DESC) AS INT) AS rank, id AS {id_col}, score FROM
  (SELECT * FROM {NAME}(TABLE(SELECT {id_col}, {text_col} FROM {table}), '{said}', {k}) ORDER BY score DESC, id DESC LIMIT {k})"""


def search(spark: SparkSession, table: str, query: str, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``rank``, ``id_col`` and ``score`` by SQL text; null texts are empty, ties go to the larger id, null ids come last."""
    register(spark, spark.table(table).schema[id_col].dataType.simpleString())
    return spark.sql(search_sql(table, query, k, id_col, text_col))
