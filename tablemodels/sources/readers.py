"""Sources: parquet, delimited text, numeric matrices, tensor shards, image folders, grids."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.session import MAX_LOOKUP_ROWS, collect_bounded
from tablemodels.sources.files import open_file

# Pixels that a task decodes at once (32 MB as doubles).
DECODED_CELLS = 4_000_000
# Small files that one task reads.
FILES_PER_TASK = 5_000
# Bytes of a tensor file that one task reads, and tasks at most.
RANGE_BYTES = 32_000_000
MAX_RANGES = 100_000


def read_parquet(spark: SparkSession, path: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*cols) if cols else df


def read_delimited(
    spark: SparkSession, path: str, schema: str, sep: str = "\t", encoding: str = "ISO-8859-1"
) -> DataFrame:
    """Delimited text with a header line; columns are matched by position to ``schema``."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, encoding=encoding, enforceSchema=True)


def read_curve(spark: SparkSession, path: str) -> DataFrame:
    """First two CSV columns as doubles, header skipped; a bad value fails the job."""
    return spark.read.csv(path, schema="x double, y double", header=True, mode="FAILFAST")


def read_matrix(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Headerless numeric CSV as one vector column ``row``; a bad value fails the job."""
    names = [f"_c{i}" for i in range(width)]
    schema = ", ".join(f"{n} double" for n in names)
    df = spark.read.csv(path, schema=schema, header=False, mode="FAILFAST")
    return df.select(F.array(*names).alias("row"))


def read_labelled_points(spark: SparkSession, path: str, schema: str, label: str, features: Sequence[str]) -> DataFrame:
    """CSV by header name to (x, label) with 1-based classes shifted to 0-based."""
    df = spark.read.csv(path, schema=schema, header=True, mode="FAILFAST")
    return df.select(
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        (F.col(label) - 1).cast("int").alias("label"),
    )


NPY_ROWS = "origin string, idx bigint, height int, width int, pixels array<double>"


def _image_batches(origin: str, first: int, tensor: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Images of an n × h × w tensor, a bounded number of cells at a time."""
    n, h, w = tensor.shape
    step = max(1, DECODED_CELLS // max(h * w, 1))
    for at in range(0, n, step):
        part = np.ascontiguousarray(tensor[at : at + step], dtype=np.float64)
        m = len(part)
        offsets = pa.array(np.arange(m + 1, dtype=np.int32) * (h * w))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([origin] * m, pa.string()),
                pa.array(np.arange(first + at, first + at + m, dtype=np.int64)),
                pa.array(np.full(m, h, np.int32)),
                pa.array(np.full(m, w, np.int32)),
                pa.ListArray.from_arrays(offsets, pa.array(part.reshape(-1))),
            ],
            names=["origin", "idx", "height", "width", "pixels"],
        )


def decode_npy(df: DataFrame, content: str = "content", origin: str = "path") -> DataFrame:
    """A column of ``.npy`` bytes (N × h × w each) to one row per image: origin, index, height, width, pixels."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _image_batches(name, 0, np.load(BytesIO(blob.as_buffer()), allow_pickle=False))

    return df.select(origin, content).mapInArrow(decode, NPY_ROWS)


def _npy_header(file) -> tuple[tuple, np.dtype, int]:
    """Shape, cell type and the byte at which the cells start."""
    version = np.lib.format.read_magic(file)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = read(file)
    if fortran or len(shape) != 3 or kind.hasobject:
        raise ValueError(f"expected an N × h × w array of numbers in row order, got {shape} of {kind}")
    return shape, kind, file.tell()


def read_npy(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A folder of ``.npy`` tensors: one row per image, a file of any size spread over tasks by ranges of its bytes.

    Only names and sizes are listed at first; tasks read the headers, then the
    ranges of whole images that start in their part of the file.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "length")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column(0).to_pylist():
                with open_file(name) as file:
                    (n, h, w), kind, _ = _npy_header(file)
                step = max(1, range_bytes // max(h * w * kind.itemsize, 1))
                rows += [(name, at, min(step, n - at)) for at in range(0, n, step)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                names=["path", "first", "n"],
            )

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first, n in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(name) as file:
                    (_, h, w), kind, start = _npy_header(file)
                    file.seek(start + first * h * w * kind.itemsize)
                    cells = np.frombuffer(file.read(n * h * w * kind.itemsize), kind)
                yield from _image_batches(name, first, cells.reshape(n, h, w))

    size = files.agg(F.sum("length")).first()[0] or 0
    parts = min(MAX_RANGES, max(spark.sparkContext.defaultParallelism, -(-size // range_bytes)))
    listed = files.select("path").mapInArrow(ranges, "path string, first bigint, n bigint")
    return listed.repartition(parts).mapInArrow(images, NPY_ROWS)


def image_rows(df: DataFrame) -> DataFrame:
    """Spark's image struct (bytes, BGR) to flat channel-last RGB pixel vectors with origin and size."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, w, c = (batch.column(i).to_numpy() for i in (1, 2, 3))
            cells = int((h.astype(np.int64) * w * c).max(initial=1))
            step = max(1, DECODED_CELLS // cells)  # a pixel grows from one byte to eight
            for first in range(0, batch.num_rows, step):
                part = batch.slice(first, step)
                pixels = []
                for blob, hh, ww, cc in zip(part.column(4), h[first:], w[first:], c[first:]):
                    bgr = np.frombuffer(blob.as_buffer(), np.uint8).reshape(hh, ww, cc)
                    rgb = bgr if cc == 1 else bgr[:, :, [2, 1, 0, *range(3, cc)]]
                    pixels.append(rgb.reshape(-1).astype(np.float64))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(4)), pa.array(pixels, pa.list_(pa.float64()))],
                    names=["origin", "height", "width", "channels", "pixels"],
                )

    parts = [F.col(f"image.{f}") for f in ("origin", "height", "width", "nChannels", "data")]
    return df.select(*parts).mapInArrow(
        decode, "origin string, height int, width int, channels int, pixels array<double>"
    )


def class_of(path: Column) -> Column:
    """The folder a file lies in, ``<name>`` or ``class=<name>``."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^class=", "")


def _file_tasks(spark: SparkSession, n: int) -> int:
    """Tasks for so many small files: Spark deals a few dozen to each, which every later job would pay for again."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-n // FILES_PER_TASK))


def read_image_folder(spark: SparkSession, root: str) -> DataFrame:
    """Images in one folder per class (``1/…`` or ``class=1/…``) with their class and its index in sorted name order.

    Files that are no images are left out; a folder without images is a class all the same.
    """
    images = spark.read.format("image").option("recursiveFileLookup", "true").option("dropInvalid", "true").load(root)
    folders = collect_bounded(class_file_counts(spark, root), MAX_LOOKUP_ROWS, "class folders")
    images = images.coalesce(_file_tasks(spark, sum(r["n"] for r in folders)))
    plain = F.url_decode(F.replace("origin", F.lit("+"), F.lit("%2B")))  # an image's origin is written as a URI
    named = image_rows(images).withColumn("class", class_of(plain))
    names = sorted(r["class"] for r in folders)
    index = F.create_map(*[F.lit(v) for i, n in enumerate(names) for v in (n, i)])
    return named.withColumn("label", index[F.col("class")].cast("int"))


def class_file_counts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files per class folder, ``<name>`` or ``class=<name>``; file contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    named = files.select(class_of(F.col("path")).alias("class")).coalesce(_file_tasks(spark, 0))  # names only
    return named.groupBy("class").agg(F.count("*").alias("n"))


def linspace(spark: SparkSession, lo: float, hi: float, n: int, name: str = "x") -> DataFrame:
    """n evenly spaced points, both ends included."""
    step = (hi - lo) / (n - 1)
    return spark.range(n).select("id", (F.lit(float(lo)) + F.col("id") * F.lit(step)).alias(name))


def grid(df: DataFrame, x: str, y: str, pad: float, step: float = 0.05) -> DataFrame:
    """Points (gx, gy) every ``step`` over the padded data range, the upper ends excluded.

    One numbered range split into row and column, so no two tables are crossed.
    """
    x0, x1, y0, y1 = map(float, df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first())
    x0, x1, y0, y1 = x0 - pad, x1 + pad, y0 - pad, y1 + pad
    nx, ny = int(np.ceil((x1 - x0) / step)), int(np.ceil((y1 - y0) / step))
    i, j = F.col("id") % nx, F.floor(F.col("id") / nx)
    return df.sparkSession.range(nx * ny).select(
        F.col("id").alias("grid_id"),
        (F.lit(x0) + i * F.lit(step)).alias("gx"),
        (F.lit(y0) + j * F.lit(step)).alias("gy"),
    )
