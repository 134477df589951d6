"""Losses between image feature tables: content, style, total variation, weighted sum."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemodels.functions import vectors as V
from tablemodels.operators.align import neighbour_steps
from tablemodels.operators.blocks import matrix_of, vector_array

# Weights of the loss terms.
CONTENT_WEIGHT = 0.025
STYLE_WEIGHT = 1.0
VARIATION_WEIGHT = 1e-4


def channel_gram(pixels: Column, channels: int) -> Column:
    """Channel × channel products of one image, flat; rows are never brought together."""

    @F.arrow_udf("array<double>")
    def products(px: pa.Array) -> pa.Array:
        x = matrix_of(px).reshape(len(px), -1, channels)
        return vector_array(np.einsum("npa,npb->nab", x, x).reshape(len(px), -1))

    return products(pixels)


def content_loss(base: Column, other: Column) -> Column:
    """Σ squared difference of two feature vectors."""
    return V.squared_distance(base, other)


def style_loss(style: Column, other: Column, channels: int, size: int, divisor_channels: int = 3) -> Column:
    """Σ squared Gram difference / (4 · channels² · size²).

    The divisor counts three channels whatever the feature depth; ``size`` is
    the number of pixels of the generated image.
    """
    gap = V.squared_distance(channel_gram(style, channels), channel_gram(other, channels))
    return gap / F.lit(4.0 * divisor_channels**2 * float(size) ** 2)


def total_variation(pixels: Column, height: int, width: int, channels: int = 1) -> Column:
    """Σ (squared step down + squared step right)^1.25."""

    @F.arrow_udf("double")
    def variation(px: pa.Array) -> pa.Array:
        down, right = neighbour_steps(matrix_of(px).reshape(len(px), height, width, channels))
        return pa.array(((down + right) ** 1.25).sum(axis=(1, 2, 3)))

    return variation(pixels)


def weighted_loss(terms: DataFrame, *keys: str) -> DataFrame:
    """Weighted sum of (term, value) rows; style terms share the style weight equally."""
    kind = F.col("term")
    style = F.avg(F.when(kind == "style", F.col("value"))) * STYLE_WEIGHT
    content = F.sum(F.when(kind == "content", F.col("value"))) * CONTENT_WEIGHT
    variation = F.sum(F.when(kind == "variation", F.col("value"))) * VARIATION_WEIGHT
    parts = [F.coalesce(p, F.lit(0.0)) for p in (style, content, variation)]
    return terms.groupBy(*keys).agg(sum(parts[1:], parts[0]).alias("loss"))


def stack(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows of several frames in one, each marked with its role; duplicates stay."""
    marked: Sequence[DataFrame] = [f.withColumn("role", F.lit(r)) for r, f in frames.items()]
    return reduce(DataFrame.unionByName, marked)
