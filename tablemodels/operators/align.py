"""Row alignment by key, and neighbour differences on pixel grids."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemodels.operators.blocks import matrix_of, vector_array


def check_aligned(frames: Sequence[DataFrame], id_col: str) -> None:
    """Every id must occur exactly once in every frame; one grouped pass over the ids alone."""
    sides = [f.select(id_col, F.lit(i).alias("_side")) for i, f in enumerate(frames)]
    ids = reduce(DataFrame.unionByName, sides)
    per_side = [F.count(F.when(F.col("_side") == i, 1)).alias(f"n{i}") for i in range(len(frames))]
    wrong = reduce(lambda a, b: a | b, [F.col(f"n{i}") != 1 for i in range(len(frames))])
    bad = ids.groupBy(id_col).agg(*per_side).filter(wrong).first()
    if bad is not None:
        raise ValueError(f"{id_col} {bad[0]!r} occurs {tuple(bad[1:])} times in the frames to be aligned")


def align(frames: Sequence[DataFrame], id_col: str, validate: bool = True) -> DataFrame:
    """Columns of several frames side by side, matched by a unique id; duplicate or missing ids raise."""
    if validate:
        check_aligned(frames, id_col)
    return reduce(lambda a, b: a.join(b, id_col), frames)


def pair_modalities(left: DataFrame, right: DataFrame, id_col: str) -> DataFrame:
    """Rows that both modalities have, matched by key; the target comes with the left side."""
    return left.join(right, id_col)


def neighbour_steps(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared steps down and right of n × h × w × c images; the last row and column drop out."""
    here = images[:, :-1, :-1]
    return (here - images[:, 1:, :-1]) ** 2, (here - images[:, :-1, 1:]) ** 2


def neighbour_squares(pixels: Column, height: int, width: int, channels: int = 1) -> Column:
    """struct(down, right): squared differences to the pixel below and the pixel to the right.

    Flat channel-last vectors of (height-1)·(width-1)·channels elements.
    Everything stays inside the row, so no pixels are joined or shuffled.
    """

    @F.arrow_udf("struct<down:array<double>,right:array<double>>")
    def squares(px: pa.Array) -> pa.Array:
        steps = neighbour_steps(matrix_of(px).reshape(len(px), height, width, channels))
        return pa.StructArray.from_arrays(
            [vector_array(s.reshape(len(px), -1)) for s in steps], names=["down", "right"]
        )

    return squares(pixels)
