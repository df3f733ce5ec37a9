"""The joint fits against single fits by Spark's own estimator."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyframe.operators import probe, scoring


def data(spark, n=400, width=5, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, width)) * 1.2
    y = rng.choice(3, n, p=[0.6, 0.3, 0.1])
    x = (centres[y] + rng.normal(size=(n, width))) * np.array([1, 10, 0.1, 3, 1])
    rows = [([float(v) for v in x[i]] + [7.0], int(y[i]), float([0.5, 1.0, 2.5][y[i]]), i % 3) for i in range(n)]
    return spark.createDataFrame(rows, "features array<double>, y int, weight double, fold int")


def single(rows, fold, reg):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    own = rows.where(F.col("fold") != fold).select(array_to_vector("features").alias("features"), F.col("y").cast("double").alias("y"), "weight")
    model = LogisticRegression(labelCol="y", weightCol="weight", regParam=reg, maxIter=200, tol=1e-9, family="multinomial").fit(own)
    return np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()])


def test_fits_equal_single_fits(spark):
    rows = data(spark).repartition(5).cache()
    fits = [(fold, reg) for reg in (0.01, 0.3) for fold in (-1, 0)]
    found, passes = probe.fit_all(rows, fits, 3, 6, 3)
    for k, (fold, reg) in enumerate(fits):
        want = single(rows, fold, reg)
        centred = found[k].copy()
        centred[:, -1] -= centred[:, -1].mean()
        assert np.allclose(centred[:, :-1], want[:, :-1], atol=2e-3 * np.abs(want[:, :-1]).max(0).clip(1e-3))
        assert np.allclose(centred[:, -1] - centred[0, -1], want[:, -1] - want[0, -1], atol=2e-2)
    # A single fit takes as many passes as all of them, give or take its own path.
    alone = max(probe.fit_all(rows, [f], 3, 6, 3)[1] for f in fits[:2])
    assert passes <= alone + 15
    rows.unpersist()


def test_choice_and_scores(spark):
    rng = np.random.default_rng(8)
    y = rng.choice(["a", "b", "c"], 300)
    rows = [(str(i), [float(v) for v in rng.normal(size=4) + np.array([3.0 * (y[i] == "a"), 3.0 * (y[i] == "b"), 0, 0])], str(y[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, x array<double>, c string")
    train, held = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    out = probe.linear_probe(train, held, "x", "c", ["a", "b", "c"], "id", grid=(50.0, 0.01)).collect()
    assert len(out) == 1 and out[0]["reg"] == 0.01 and out[0]["n"] == held.count() and out[0]["accuracy"] > 0.8
    # A tie of all scores goes to the least value.
    same = probe.linear_probe(train, held, "x", "c", ["a", "b", "c"], "id", grid=(0.011, 0.01, 0.0105)).first()
    assert same["reg"] in (0.01, 0.0105, 0.011)
    constant = df.withColumn("x", F.array(F.lit(1.0), F.lit(2.0)))
    assert probe.linear_probe(constant, held.withColumn("x", F.array(F.lit(1.0), F.lit(2.0))), "x", "c", ["a", "b", "c"], "id", grid=(0.1, 1.0)).first()["reg"] == 0.1
    assert scoring.benchmark_metrics is probe.benchmark_metrics
