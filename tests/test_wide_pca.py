import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import pca
from millrace.operators.wide_pca import fit_wide


def table(spark, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, v array<double>").repartition(5)


def exact(m, k):
    u, s, v = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    return [c * np.sign(c[np.argmax(np.round(np.abs(c), 12))]) for c in v[:k]], s[:k] / np.sqrt(len(m) - 1), (s**2 / (s**2).sum())[:k]


def test_wider_than_a_covariance_can_be(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(60, 8)) * 3.0 ** -np.arange(8) @ rng.normal(size=(8, 5000)) + rng.normal(size=5000)
    model = fit_wide(table(spark, m), 3, more=6, rounds=6)
    components, deviations, shares = exact(m, 3)
    assert np.allclose(model.components, components, atol=1e-7) and np.allclose(model.deviations, deviations) and np.allclose(model.shares, shares)
    scores = {r.id: r.scores for r in model.project(table(spark, m), "id").collect()}
    assert np.allclose([scores[i] for i in range(60)], (m - m.mean(axis=0)) @ np.array(components).T, atol=1e-5)


def test_like_the_covariance_on_the_given_vectors(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("v"))
    wide, plain = fit_wide(rows, 2, more=62, rounds=2), pca.fit(rows, 2)
    assert np.allclose(wide.components, plain.components, atol=1e-6) and np.allclose(wide.mean, plain.mean) and np.allclose(wide.shares, plain.shares)


def test_edges(spark):
    m = np.outer([1.0, 2.0, 4.0], [1.0, -2.0])  # one direction only
    model = fit_wide(table(spark, m), 5)
    assert model.components.shape[0] == 1 and np.allclose(model.components[0], [-1 / 5**0.5, 2 / 5**0.5]) and np.allclose(model.shares, [1])
    for bad in (m[:1], np.ones((3, 2))):
        with pytest.raises(ValueError):
            fit_wide(table(spark, bad), 1)
    with pytest.raises(ValueError):
        fit_wide(table(spark, m).limit(0), 1)
    with pytest.raises(Exception, match="unequal"):
        fit_wide(table(spark, m).union(spark.createDataFrame([(9, [1.0])], "id bigint, v array<double>")), 1)
