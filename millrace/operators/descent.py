"""Gradient descent: as expressions, where a run is a row and its path an array; and on the loss over a table's rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.vectors import bowl, bowl_slope, parabola, parabola_slope


def _path(start: Column, steps: Column, step) -> Column:
    counted = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(counted, F.array(start), lambda path, _: F.array_append(path, step(F.element_at(path, -1))))


def descend(runs: DataFrame) -> DataFrame:
    """``run_id``, ``step``, ``x`` and ``loss`` on (x - 3)^2 for runs of run_id, start, rate and steps; step 0 is the start."""
    path = _path(F.col("start").cast("double"), F.col("steps"), lambda x: x - F.col("rate") * parabola_slope(x))
    rows = runs.select("run_id", F.posexplode(path).alias("step", "x"))
    return rows.withColumn("loss", parabola(F.col("x")))


def descend_2d(runs: DataFrame) -> DataFrame:
    """``run_id``, ``step``, ``x``, ``y`` and ``loss`` on x^2 + 5 y^2 for runs of run_id, x, y, rate and steps."""

    def step(p: Column) -> Column:
        dx, dy = bowl_slope(p["x"], p["y"])
        return F.struct((p["x"] - F.col("rate") * dx).alias("x"), (p["y"] - F.col("rate") * dy).alias("y"))

    start = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    rows = runs.select("run_id", F.posexplode(_path(start, F.col("steps"), step)).alias("step", "p"))
    return rows.select("run_id", "step", "p.x", "p.y", bowl(F.col("p.x"), F.col("p.y")).alias("loss"))


def last_step(paths: DataFrame) -> DataFrame:
    """The end of each run."""
    others = [c for c in paths.columns if c != "run_id"]
    return paths.groupBy("run_id").agg(F.max_by(F.struct(*others), "step").alias("last")).select("run_id", "last.*")


def surface(points: DataFrame) -> DataFrame:
    """A grid's points with ``z``, x^2 + 5 y^2."""
    return points.withColumn("z", bowl(F.col("gx"), F.col("gy")))


def least_squares(rows: DataFrame, features: Sequence[str], target: str, rate: float = 0.5, rounds: int = 200, tolerance: float = 1e-12) -> tuple[dict[str, float], DataFrame]:
    """Coefficients by name, ``intercept`` among them, that descent finds on a table's mean squared error; and its path.

    Each round is one pass over the rows: tasks sum their part of the gradient,
    Spark adds the parts, and the driver moves a parameter for each feature.
    Features and target are scaled by their means and deviations first, so a
    rate below 2 over the number of features always descends.  It stops when no
    parameter moves by more than ``tolerance``, or after ``rounds``.  The path
    has ``step``, ``loss`` and ``moved`` (the largest move, scaled).  Rows with a
    null are left out; a constant feature has coefficient 0.
    """
    names = [*features, target]
    whole = rows.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names))).dropna()
    moments = whole.agg(F.count("*").alias("n"), *(f(f"c{i}").alias(f"{f.__name__}_{i}") for i in range(len(names)) for f in (F.avg, F.stddev_pop))).first()
    if not moments.n:
        raise ValueError("there are no rows")
    mean = [moments[f"avg_{i}"] for i in range(len(names))]
    size = [moments[f"stddev_pop_{i}"] or 1.0 for i in range(len(names))]
    scaled = [(F.col(f"c{i}") - F.lit(mean[i])) / F.lit(size[i]) for i in range(len(names))]
    weights, path = [0.0] * len(features), []
    for step in range(rounds):
        error = sum((F.lit(w) * x for w, x in zip(weights, scaled, strict=False)), F.lit(0.0)) - scaled[-1]
        told = whole.select(error.alias("e"), *(x.alias(f"x{i}") for i, x in enumerate(scaled[:-1])))
        sums = told.agg(F.avg(F.col("e") * F.col("e")).alias("loss"), *(F.avg(F.col("e") * F.col(f"x{i}")).alias(f"g{i}") for i in range(len(features)))).first()
        moves = [rate * sums[f"g{i}"] for i in range(len(features))]
        weights = [w - m for w, m in zip(weights, moves, strict=True)]
        path.append((step, float(sums.loss), float(max(map(abs, moves), default=0.0))))
        if path[-1][2] <= tolerance:
            break
    slopes = {c: w * size[-1] / size[i] for i, (c, w) in enumerate(zip(features, weights, strict=True))}
    intercept = mean[-1] - sum(slopes[c] * mean[i] for i, c in enumerate(features))
    return slopes | {"intercept": intercept}, rows.sparkSession.createDataFrame(path, "step int, loss double, moved double")
