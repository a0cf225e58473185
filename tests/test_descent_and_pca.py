import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import descent, knn, pca, tables


def test_paths_have_the_closed_form(spark):
    runs = spark.createDataFrame([(0, 0.0, 0.05, 30), (1, 0.0, 0.5, 30), (2, 0.0, 1.05, 30), (3, 5.0, 0.1, 0), (4, 5.0, 0.0, 4)], "run_id int, start double, rate double, steps int")
    rows = descent.descend(runs).collect()
    for r in rows:
        start, rate = {0: (0, 0.05), 1: (0, 0.5), 2: (0, 1.05), 3: (5, 0.1), 4: (5, 0.0)}[r.run_id]
        assert math.isclose(r.x, 3 + (start - 3) * (1 - 2 * rate) ** r.step, rel_tol=1e-12)
        assert math.isclose(r.loss, (r.x - 3) ** 2, abs_tol=1e-15)
    assert sum(r.run_id == 3 for r in rows) == 1 and sum(r.run_id == 4 for r in rows) == 5
    last = {r.run_id: r for r in descent.last_step(descent.descend(runs)).collect()}
    assert last[0].x == pytest.approx(2.8728265251743514, abs=1e-13) and last[1].x == 3.0
    assert last[2].loss == pytest.approx(2740.3347558728, abs=1e-6)


def test_2d_path(spark):
    runs = spark.createDataFrame([(0, 4.0, 3.0, 0.15, 40)], "run_id int, x double, y double, rate double, steps int")
    r = descent.last_step(descent.descend_2d(runs)).first()
    assert r.step == 40 and r.x == pytest.approx(2.5467223e-6) and r.y == pytest.approx(2.7284841e-12) and r.loss == pytest.approx(6.4857945e-12)


def test_surface(spark):
    rows = descent.surface(knn.grid(spark, (-5, 5, 3), (-4, 4, 3))).collect()
    assert {(r.gx, r.gy): r.z for r in rows}[-5.0, 4.0] == 25 + 80


def vectors(spark, n=200, d=5, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d)) * np.arange(1, d + 1)
    return x, spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id bigint, v array<double>").repartition(3)


def test_components_like_svd(spark):
    x, rows = vectors(spark)
    model = pca.fit(rows, 2)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(np.abs(np.array(model.components)), np.abs(vt[:2]))
    assert np.allclose(np.array(model.components) @ np.array(model.components).T, np.eye(2))
    assert np.allclose(model.shares, (s**2 / (s**2).sum())[:2])
    for c in model.components:
        assert c[int(np.argmax(np.abs(c)))] > 0
    scores = np.array([r.scores for r in pca.project(rows, model, "id").orderBy("id").collect()])
    assert np.allclose(scores.mean(0), 0, atol=1e-12)
    assert np.allclose(np.abs(scores), np.abs((x - x.mean(0)) @ vt[:2].T))


def test_restoring_gets_better_with_k(spark):
    x, rows = vectors(spark)
    errors = []
    for k in (1, 3, 99):
        model = pca.fit(rows, k)
        assert len(model.components) == min(k, 5)
        back = np.array([r.b for r in rows.select("id", model.restored(model.scores(F.col("v"))).alias("b")).orderBy("id").collect()])
        errors.append(float(((back - x) ** 2).sum()))
    assert errors[0] > errors[1] > errors[2] and errors[2] < 1e-18 * len(x) * 1e6


def test_guards(spark):
    _, rows = vectors(spark)
    with pytest.raises(ValueError):
        pca.fit(rows, 0)
    with pytest.raises(ValueError):
        pca.fit(rows.limit(1), 1)
    with pytest.raises(ValueError):
        pca.fit(spark.createDataFrame([([1.0, 2.0],)] * 3, "v array<double>"), 1)
    with pytest.raises(Exception, match="unequal width"):
        pca.covariance(spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "v array<double>")).collect()


def test_two_columns_like_the_general_way(spark):
    rng = random.Random(2)
    data = [(x, 2 * x + rng.gauss(0, 1.5)) for x in (rng.uniform(-3, 3) for _ in range(200))]
    rows = spark.createDataFrame(data, "x double, y double")
    r, model = pca.two_columns(rows, "x", "y").first(), pca.fit(tables.paired(rows, ["x", "y"]), 1)
    assert np.allclose([r.dx, r.dy], model.components[0]) and np.allclose([r.mx, r.my], model.mean)
    line = pca.principal_line(tables.paired(rows, ["x", "y"]), model, 11).orderBy("i").collect()
    assert len(line) == 11 and math.isclose(line[0].points[0], r.mx + (min(d[0] for d in data) - r.mx) * r.dx)


def test_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(spark.range(0, 9, 1, 1)).rdd.getNumPartitions() == 2 * cores
    wide = spark.range(0, 9, 1, cores)
    assert tables.spread(wide) is wide
    shuffled = wide.groupBy("id").count()
    assert tables.spread(shuffled) is shuffled


def test_tables(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, "b", 3.0)], "a int, t string, x double")
    assert [r.t for r in tables.with_default(df, "t").orderBy("a").collect()] == ["", "b"]
    assert tables.with_default(df, "other", "z").first().other == "z"
    assert tables.stack([df, df.select("x", "t", "a")]).count() == 4
    assert {tuple(r) for r in tables.ranges(df, ["a", "x"]).collect()} == {("a", 1.0, 2.0), ("x", 2.0, 3.0)}
    assert tables.all_close(df, F.col("x"), F.col("x") + 1e-9) and not tables.all_close(df, F.col("x"), F.col("a"))
    assert tables.component(tables.paired(df, ["a", "x"]), F.col("a") == 2, "v", 1).first()["value"] == 3.0
    assert tables.distinct_values(df, "t").count() == 2
    r = descent.last_step(descent.descend(spark.createDataFrame([(0, 1.0, 0.1, 3)], "run_id int, start double, rate double, steps int"))).first()
    assert r.step == 3


def test_least_squares(spark):
    rng = random.Random(0)
    rows = [(float(i % 17), rng.random(), 5.0, None if i == 3 else 3.0 * (i % 17) - 2.0 + rng.random()) for i in range(400)]
    table = spark.createDataFrame(rows, "a double, b double, flat double, y double").repartition(3)
    found, path = descent.least_squares(table, ["a", "b", "flat"], "y")
    kept = np.array([r for r in rows if r[3] is not None])
    exact = np.linalg.lstsq(np.column_stack([kept[:, :2], np.ones(len(kept))]), kept[:, 3], rcond=None)[0]
    assert np.allclose([found["a"], found["b"], found["intercept"]], exact, atol=1e-8) and found["flat"] == 0
    steps = path.orderBy("step").collect()
    assert all(x.loss >= y.loss - 1e-12 for x, y in zip(steps, steps[1:])) and steps[-1].moved <= 1e-12 and len(steps) < 200
    with pytest.raises(ValueError):
        descent.least_squares(table.limit(0), ["a"], "y")
