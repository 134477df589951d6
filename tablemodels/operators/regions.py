"""Decision-region tables: a classifier's answer on a grid over the padded data range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemodels.sources.readers import grid


def decision_regions(
    df: DataFrame, vector: str, predict: Callable[[DataFrame, str], DataFrame], pad: float, step: float = 0.05
) -> DataFrame:
    """``predict(points, 'x')`` on every grid point of a two-dimensional vector column."""
    flat = df.select(F.col(vector)[0].alias("x0"), F.col(vector)[1].alias("x1"))
    points = grid(flat, "x0", "x1", pad, step)
    return predict(points.withColumn("x", F.array("gx", "gy")), "x")
