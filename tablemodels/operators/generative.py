"""Gaussian generative classifier with one covariance per class or a shared one."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.functions import vectors as V
from tablemodels.operators.blocks import map_rows, vector_width, when_whole
from tablemodels.operators.groups import group_covariances
from tablemodels.session import MAX_LOOKUP_ROWS, MAX_MODEL_CELLS, check_model_size, collect_bounded, small_table

# Class × width² terms up to which the score is a plain column expression.
EXPRESSION_TERMS = 64


@dataclass
class GaussianModel:
    means: np.ndarray  # C × d
    covariances: np.ndarray  # C × d × d; all equal when shared
    log_prior: np.ndarray  # C
    counts: np.ndarray  # C

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [
            (c, int(self.counts[c]), float(self.log_prior[c]), self.means[c].tolist(), self.covariances[c].tolist())
            for c in range(len(self.means))
        ]
        return small_table(
            spark, rows, "label int, n bigint, log_prior double, mean array<double>, cov array<array<double>>"
        )


def gaussian_fit(df: DataFrame, vector: str, label: str, shared: bool = False) -> GaussianModel:
    """Means, covariances and log priors of classes 0..max in one grouped aggregate (two when wide)."""
    width = vector_width(df, vector)
    most = min(MAX_LOOKUP_ROWS, MAX_MODEL_CELLS // (width * width))  # the model travels to every task
    rows = collect_bounded(group_covariances(df, label, vector, width), most, "class table")
    by_class = {int(r[label]): r for r in rows}
    missing = set(range(max(by_class) + 1)) - set(by_class)
    if missing:
        raise ValueError(f"classes without rows: {sorted(missing)}")
    order = sorted(by_class)
    counts = np.array([by_class[c]["n"] for c in order])
    means = np.array([by_class[c]["mean"] for c in order])
    cov = np.array([by_class[c]["cov"] for c in order])
    if shared:
        pooled = np.einsum("c,cij->ij", counts.astype(float), cov) / counts.sum()
        cov = np.repeat(pooled[None], len(order), axis=0)
    return GaussianModel(means, cov, np.log(counts / counts.sum()), counts)


def gaussian_scores(vector: Column, model: GaussianModel) -> Column:
    """log N(x; μ_c, Σ_c) + log prior for every class, all in log space.

    Null for a vector that is null or holds a null; another length fails.
    """
    check_model_size(model.covariances.size, "Gaussian model")
    c, d = model.means.shape
    root = np.linalg.cholesky(model.covariances)
    whiten = np.linalg.inv(root)
    constant = -0.5 * d * np.log(2 * np.pi) - np.log(np.diagonal(root, axis1=1, axis2=2)).sum(axis=1) + model.log_prior

    if c * d * d <= EXPRESSION_TERMS:
        scores = []
        for k in range(c):
            diff = [vector[j] - float(model.means[k, j]) for j in range(d)]
            norm = F.lit(0.0)
            for i in range(d):
                row = sum((diff[j] * float(whiten[k, i, j]) for j in range(i + 1)), F.lit(0.0))
                norm = norm + row * row
            scores.append(F.lit(float(constant[k])) - norm * 0.5)
        return when_whole(vector, d, F.array(*scores))

    def score(x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), c))
        for k in range(c):
            z = (x - model.means[k]) @ whiten[k].T
            out[:, k] = constant[k] - 0.5 * np.einsum("ij,ij->i", z, z)
        return out

    return map_rows(vector, d, score)


def gaussian_predict(df: DataFrame, vector: str, model: GaussianModel, output: str = "prediction") -> DataFrame:
    """Adds the class of the highest score, the lowest class on ties."""
    scored = df.withColumn("_scores", gaussian_scores(F.col(vector), model))
    return scored.withColumn(output, V.first_argmax(F.col("_scores"))).drop("_scores")
