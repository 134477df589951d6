"""Image tables: flat channel-last pixel vectors with height, width and channels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemodels.functions import vectors as V
from tablemodels.operators.blocks import matrix_of, vector_array
from tablemodels.session import hash_uniform

# Channel means of the backbone, blue, green, red.
CHANNEL_MEANS = (103.939, 116.779, 123.68)


def rescale_pixels(pixels: Column, factor: float = 1 / 255) -> Column:
    return V.scale(pixels, factor)


def width_for_height(width: Column, height: Column, target: int = 400) -> Column:
    """Width that keeps the aspect at the target height, fraction dropped."""
    return F.floor(width * F.lit(target) / height).cast("int")


def resize(pixels: Column, height: Column, width: Column, to_height: int, to_width: int, channels: int = 3) -> Column:
    """Nearest-neighbour resize to a fixed size."""

    @F.arrow_udf("array<double>")
    def nearest(px: pa.Array, h: pa.Array, w: pa.Array) -> pa.Array:
        out = np.empty((len(px), to_height * to_width * channels))
        for n, (p, hh, ww) in enumerate(zip(px, h.to_pylist(), w.to_pylist())):
            image = p.values.to_numpy(zero_copy_only=False).reshape(hh, ww, channels)
            rows = ((np.arange(to_height) + 0.5) * hh / to_height).astype(int)
            cols = ((np.arange(to_width) + 0.5) * ww / to_width).astype(int)
            out[n] = image[rows][:, cols].reshape(-1)
        return vector_array(out)

    return nearest(pixels, height, width)


def _on_pixels(pixels: Column, change, element: str = "double") -> Column:
    """``change`` on the flat values of a batch of images, whatever their sizes."""

    @F.arrow_udf(f"array<{element}>")
    def run(px: pa.Array) -> pa.Array:
        lengths = px.value_lengths().to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        values = change(px.flatten().to_numpy(zero_copy_only=False))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))

    return run(pixels)


def centre_channels(pixels: Column) -> Column:
    """RGB pixels to mean-centred BGR."""
    return _on_pixels(pixels, lambda flat: flat.reshape(-1, 3)[:, ::-1] - np.array(CHANNEL_MEANS))


def restore_channels(pixels: Column) -> Column:
    """Mean-centred BGR back to RGB bytes, clipped and truncated."""

    def restore(flat):
        bgr = flat.reshape(-1, 3) + np.array(CHANNEL_MEANS)
        return np.clip(bgr[:, ::-1], 0, 255).astype(np.int32)

    return _on_pixels(pixels, restore, "int")


def flip_horizontal(pixels: Column, width: int, channels: int = 1) -> Column:
    """Each image row mirrored."""
    return _on_pixels(pixels, lambda flat: flat.reshape(-1, width, channels)[:, ::-1])


def augment_parameters(
    id_col: Column, copy: Column, seed: int, rotation: float = 40.0, shift: float = 0.2,
    shear: float = 0.2, zoom: float = 0.2,
) -> Column:
    """Random warp of one copy: angle and shear in degrees, shifts as shares, zooms, flip; fixed by (seed, id, copy)."""

    def spread(what: str, reach: float, middle: float = 0.0) -> Column:
        return (hash_uniform(f"{seed}|{what}", id_col, copy) * 2 - 1) * reach + middle

    return F.struct(
        spread("rotation", rotation).alias("angle"),
        spread("down", shift).alias("down"),
        spread("right", shift).alias("right"),
        spread("shear", shear).alias("shear"),
        spread("zoom_y", zoom, 1.0).alias("zoom_y"),
        spread("zoom_x", zoom, 1.0).alias("zoom_x"),
        (hash_uniform(f"{seed}|flip", id_col, copy) < 0.5).alias("flip"),
    )


def augment(pixels: Column, parameters: Column, height: int, width: int, channels: int = 3) -> Column:
    """Affine warp about the image centre, bilinear inside, nearest edge pixel outside."""

    @F.arrow_udf("array<double>")
    def warp(px: pa.Array, p: pa.Array) -> pa.Array:
        x = matrix_of(px)
        if not len(x):
            return vector_array(np.zeros((0, height * width * channels)))
        images = x.reshape(len(x), height, width, channels)
        field = {f.name: np.asarray(p.field(f.name).to_pylist(), float) for f in p.type}
        middle = np.array([(height - 1) / 2, (width - 1) / 2])
        rows, cols = np.mgrid[:height, :width]
        grid = np.stack([rows.ravel(), cols.ravel()]) - middle[:, None]
        out = np.empty_like(images)
        for n, image in enumerate(images):
            a, s = np.deg2rad(field["angle"][n]), np.deg2rad(field["shear"][n])
            turn = np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
            slant = np.array([[1.0, -np.sin(s)], [0.0, np.cos(s)]])
            zoom = np.diag([field["zoom_y"][n], field["zoom_x"][n]])
            move = turn @ np.array([field["down"][n] * height, field["right"][n] * width])
            at = turn @ slant @ zoom @ grid + (move + middle)[:, None]
            out[n] = _bilinear(image, *at).reshape(height, width, channels)
            if field["flip"][n]:
                out[n] = out[n][:, ::-1]
        return vector_array(out.reshape(len(x), -1))

    return warp(pixels, parameters)


def _bilinear(image: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    h, w = image.shape[:2]
    y, x = np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[:, None]
    top = image[y0, x0] * (1 - fx) + image[y0, x1] * fx
    low = image[y1, x0] * (1 - fx) + image[y1, x1] * fx
    return top * (1 - fy) + low * fy
