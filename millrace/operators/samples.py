"""Made-up rows for examples; Spark's generator, so the numbers are this library's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.tables import stack


def blobs(spark: SparkSession, centres: Sequence[Sequence[float]] = ((2.0, 2.0), (-2.0, -2.0)), n: int = 30, seed: int = 0) -> DataFrame:
    """``id``, ``v`` and ``label``: n normal points around each centre, whose number is the label."""
    parts = []
    for label, centre in enumerate(centres):
        v = F.array(*(F.randn(seed + 1000 * label + j) + F.lit(float(c)) for j, c in enumerate(centre)))
        parts.append(spark.range(label * n, (label + 1) * n).select("id", v.alias("v"), F.lit(label).alias("label")))
    return stack(parts)


def noisy_line(spark: SparkSession, n: int = 200, slope: float = 2.0, noise: float = 1.5, seed: int = 0) -> DataFrame:
    """``id``, ``x`` (standard normal) and ``y``, the slope times x with normal noise."""
    rows = spark.range(n).select("id", F.randn(seed).alias("x"), F.randn(seed + 1).alias("e"))
    return rows.select("id", "x", (F.col("x") * slope + F.col("e") * noise).alias("y"))
