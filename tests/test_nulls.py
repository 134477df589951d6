"""Nulls, lengths, labels and keys follow one rule on either side of every size at which the path changes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablemodels.operators import features, groups, softmax


@pytest.mark.parametrize("width", [2, 12])
def test_normal_sums_without_null_rows(spark, width):
    rows = spark.range(40).select(
        F.array(*[F.when((F.col("id") % 7 == 3) & (F.lit(k) == 1), F.lit(None)).otherwise(F.pow(F.col("id") / 10, F.lit(k % 3)) + k)
                  for k in range(width)]).alias("x"),
        F.when(F.col("id") % 4 != 0, F.col("id").cast("double")).alias("y"),
    )
    got_xx, got_xy = groups.normal_sums(rows, "x", "y", width)
    kept = [r for r in rows.collect() if r["y"] is not None and None not in r["x"]]
    x, y = np.array([r["x"] for r in kept]), np.array([r["y"] for r in kept])
    assert np.allclose(got_xx, x.T @ x) and np.allclose(got_xy, x.T @ y)
    with pytest.raises(Exception, match="expected a basis"):
        groups.normal_sums(rows.withColumn("x", F.array_append("x", F.lit(1.0))), "x", "y", width)


@pytest.mark.parametrize("width", [8, 9])
def test_covariances_without_null_rows(spark, width):
    rows = spark.range(60).select(
        F.when(F.col("id") % 3 != 0, F.col("id") % 3).alias("k"),
        F.when(
            F.col("id") % 11 != 5,
            F.array(*[F.when((F.col("id") % 7 != 2) | F.lit(j != 1), F.sin(F.col("id") * (j + 1))) for j in range(width)]),
        ).alias("x"),
    )
    kept = [r for r in rows.collect() if r["x"] is not None and None not in r["x"]]
    got = {r["k"]: r for r in groups.group_covariances(rows, "k", "x").collect()}
    assert set(got) == {None, 1, 2}
    for k, r in got.items():
        x = np.array([q["x"] for q in kept if q["k"] == k])
        assert r["n"] == len(x) and np.allclose(r["mean"], x.mean(axis=0)) and np.allclose(r["cov"], np.cov(x.T))
    longer = rows.withColumn("x", F.array_append("x", F.lit(1.0)))
    with pytest.raises(Exception, match="expected a vector"):
        groups.group_covariances(longer, "k", "x", width).collect()


@pytest.mark.parametrize("sums", [0, 10_000])
@pytest.mark.parametrize("hessian", [False, True])
def test_softmax_sums_with_nulls_and_bad_labels(spark, monkeypatch, sums, hessian):
    monkeypatch.setattr(softmax, "MAX_EXPRESSION_SUMS", sums)
    x = F.array(F.sin("id"), F.when(F.col("id") % 7 != 2, F.cos("id")))
    rows = spark.range(50).select(x.alias("x"), F.when(F.col("id") % 5 != 4, F.col("id") % 3).alias("y"))
    kept = rows.filter("y IS NOT NULL AND x[1] IS NOT NULL")
    w = np.arange(9.0).reshape(3, 3) / 10
    for a, b in zip(softmax.loss_and_gradient(rows, "x", "y", w, 0.1, hessian), softmax.loss_and_gradient(kept, "x", "y", w, 0.1, hessian)):
        assert np.allclose(a, b)
    for bad in (-1, 3):
        with pytest.raises(Exception, match="expected a label"):
            softmax.loss_and_gradient(kept.withColumn("y", F.when(F.col("y") == 2, bad).otherwise(F.col("y"))), "x", "y", w, 0.1, hessian)


def test_wide_softmax_reaches_the_newton_minimum(spark, monkeypatch):
    x = F.array(F.sin("id"), F.cos(F.col("id") * 3))
    rows = spark.range(80).select(x.alias("x"), (F.floor(F.col("id") * 7 / 5) % 3).cast("int").alias("y"))
    newton = softmax.softmax_fit(rows, "x", "y", lam=0.5)
    monkeypatch.setattr(softmax, "MAX_NEWTON_WEIGHTS", 8)
    limited = softmax.softmax_fit(rows, "x", "y", lam=0.5)
    assert np.allclose(newton.weights, limited.weights, atol=1e-5)
    assert limited.history[-1][2] < 1e-5


@pytest.mark.parametrize("width", [16, 17])
def test_scaling_keeps_null_vectors(spark, width):
    x = F.when(F.col("id") % 4 != 0, F.array(*[F.col("id") * (j + 1.0) for j in range(width)]))
    rows = spark.range(0, 20, 1, 2).select("id", x.alias("x"))
    scaler = features.Scaler(np.arange(width, dtype=float), np.full(width, 2.0))
    for r in rows.withColumn("z", scaler.apply(F.col("x"))).collect():
        assert r["z"] is None if r["id"] % 4 == 0 else np.allclose(r["z"], (np.array(r["x"]) - np.arange(width)) / 2)


def score_functions(width):
    """Every operator that maps a vector row by row, on either side of its size switch."""
    from tablemodels.functions import vectors as V
    from tablemodels.operators import blocks, generative, mlp

    rng = np.random.default_rng(width)
    w = rng.normal(size=(3, width))
    cov = np.repeat(np.eye(width)[None] * 2, 3, axis=0)
    gauss = generative.GaussianModel(w, cov, np.log(np.full(3, 1 / 3)), np.array([1, 1, 1]))
    net = mlp.new_network([width, 4, 2], "cross_entropy", 1)
    return [
        lambda x: V.mat_vec(w.tolist(), x), lambda x: blocks.linear_map(x, w), lambda x: softmax.class_scores(x, np.hstack([w, w[:, :1]])),
        lambda x: generative.gaussian_scores(x, gauss), lambda x: mlp.forward(x, net), features.Scaler(w[0], np.abs(w[1]) + 1).apply,
    ]


@pytest.mark.parametrize("which", range(6))
@pytest.mark.parametrize("width", [3, 40])
def test_rows_with_nulls_have_no_score_and_others_keep_theirs(spark, which, width):
    score = score_functions(width)[which]
    cells = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.sin(F.col("id") * j))
    holes = F.when(F.col("id") % 5 == 0, None).when(F.col("id") % 7 == 3, F.transform(cells, lambda v, i: F.when(i != width - 1, v))).otherwise(cells)
    df = spark.range(0, 60, 1, 3).select("id", cells.alias("x"), holes.alias("h"))
    for r in df.select("id", score(F.col("x")).alias("x"), score(F.col("h")).alias("h")).collect():
        assert r["x"] is not None and None not in r["x"]
        assert r["h"] is None if r["id"] % 5 == 0 or r["id"] % 7 == 3 else np.allclose(r["h"], r["x"])
    assert df.filter("h IS NULL").select(score(F.col("h")).alias("h")).filter("h IS NOT NULL").count() == 0
    for longer in (F.array_append("x", F.lit(1.0)), F.slice("x", 1, width - 1)):
        with pytest.raises(Exception, match=f"of {width} cells, got"):
            df.select(score(longer).alias("s")).collect()
