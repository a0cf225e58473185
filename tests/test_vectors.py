import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import vectors as v


def vec(*x):
    return F.array(*(F.lit(float(i)) for i in x))


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_distance_and_similarity(spark):
    assert value(spark, v.euclidean(vec(0, 3), vec(4, 0))) == 5.0
    assert value(spark, v.cosine(vec(1, 0), vec(-2, 0))) == -1.0
    assert value(spark, v.cosine(vec(0, 0), vec(1, 2))) == 0.0
    assert value(spark, v.normalized(vec(3, 4))) == [0.6, 0.8]
    assert value(spark, v.normalized(vec(0, 0))) == [0.0, 0.0]


def test_unequal_width_is_an_error(spark):
    for f in (v.dot, v.euclidean):
        with pytest.raises(Exception, match="unequal width"):
            value(spark, f(vec(1, 2), vec(1)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.floats(-1e3, 1e3), st.floats(-1e3, 1e3)), min_size=1, max_size=6))
def test_cosine_is_symmetric_and_bounded(spark, pairs):
    a, b = vec(*(p[0] for p in pairs)), vec(*(p[1] for p in pairs))
    r = spark.range(1).select(v.cosine(a, b).alias("ab"), v.cosine(b, a).alias("ba"), v.cosine(a, a).alias("aa"), v.norm(a).alias("n")).first()
    assert r.ab == r.ba and -1 - 1e-9 <= r.ab <= 1 + 1e-9
    assert math.isclose(r.aa, 1.0) if r.n > 0 else r.aa == 0.0


def test_linspace_has_exact_ends(spark):
    got = [r.x for r in spark.range(7).select(v.linspace(F.col("id"), -5, 5, 7).alias("x")).collect()]
    assert got[0] == -5.0 and got[-1] == 5.0 and all(math.isclose(b - a, 10 / 6) for a, b in zip(got, got[1:], strict=False))
    assert value(spark, v.linspace(F.lit(0), 2, 9, 1)) == 2.0
    with pytest.raises(ValueError):
        v.linspace(F.lit(0), 0, 1, 0)


def test_single_precision_is_widened(spark):
    rng = random.Random(0)
    x = [rng.random() for _ in range(5)]
    single = spark.createDataFrame([(x,)], "v array<float>")
    wide = single.first().v
    assert math.isclose(single.select(v.norm(F.col("v")).alias("n")).first().n, math.sqrt(sum(i * i for i in wide)), rel_tol=1e-15)
