"""Least squares on a basis through the normal equations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemodels.functions import vectors as V
from tablemodels.operators.blocks import vector_width
from tablemodels.operators.groups import normal_sums


def basis_fit(df: DataFrame, basis: Column, target: str, width: int | None = None) -> np.ndarray:
    """Weights w with XᵀX·w = Xᵀy; a singular basis raises."""
    rows = df.select(basis.alias("_basis"), F.col(target).alias("_y"))
    width = width or vector_width(rows, "_basis")
    xtx, xty = normal_sums(rows, "_basis", "_y", width)
    if np.linalg.matrix_rank(xtx) < width:
        raise np.linalg.LinAlgError("the basis is singular on these rows")
    return np.linalg.solve(xtx, xty)


def basis_predict(df: DataFrame, basis: Column, weights: np.ndarray, output: str = "prediction") -> DataFrame:
    """Adds the fitted curve's value."""
    return df.withColumn(output, V.dot(basis, V.literal_vector(weights)))
