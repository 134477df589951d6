"""Image tables and the losses between them; embeddings stand in as 8 × 8 images."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from checks.base import SQL_POINTS, long_vector, points, query, read, rnd, sql_long, sql_rnd, sql_uniform
from checks.networks import SqlTraining, rounded, sql_histories, sql_one_hot, sql_split
from tablemodels.functions import vectors as V
from tablemodels.operators import align, features, groups, images, mlp, order, style
from tablemodels.operators.blocks import gram
from tablemodels.session import scratch_dir
from tablemodels.sources import files, readers

SQL_P = f"({SQL_POINTS})"
CELL = "range(1, 65) t(pos)"


def png_bytes(image: np.ndarray) -> bytes:
    """8-bit grey or RGB PNG."""
    h, w = image.shape[:2]
    kind = 2 if image.ndim == 3 else 0

    def chunk(tag: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))

    lines = b"".join(b"\0" + row.tobytes() for row in image)
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def write_image_folder(df, root: str, height: int, width: int, channels: int, prefix: str = "class=") -> None:
    """(vec_id, label, pixels in 0..255) as ``<prefix><label>/<vec_id>.png``, written by the tasks.

    A file's name and content depend on its row alone, so a repeated task writes the same file.
    """

    def write(batches):
        for batch in batches:
            for key, label, px in zip(*(batch.column(i) for i in range(3))):
                image = np.array(px.values, dtype=np.uint8).reshape((height, width) if channels == 1 else (height, width, channels))
                files.write_file(f"{root}/{prefix}{label.as_py()}", f"{key.as_py()}.png", png_bytes(image))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows = df.select("vec_id", "label", "pixels").repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "vec_id")
    rows.mapInArrow(write, "n bigint").agg(F.sum("n")).first()


# x in -1..1 as a byte, the same rule in both engines.
def byte_pixels():
    return F.transform("x", lambda v: F.floor(v * 127.0 + 128.0).cast("double"))


SQL_BYTE = "floor(x[{i}] * 127.0::DOUBLE + 128.0::DOUBLE)"


def grey_folder(spark, sf, prefix="class="):
    root = scratch_dir(spark, "images")
    write_image_folder(points(spark, sf).withColumn("pixels", byte_pixels()), root, 8, 8, 1, prefix)
    return root


SQL_FOLDER = (
    f"SELECT vec_id, label::VARCHAR AS class, label::INTEGER AS label, 8::INTEGER AS height, (pos - 1)::INTEGER AS pos, {SQL_BYTE.format(i='pos')} AS value "
    f"FROM {SQL_P}, {CELL}"
)


def folder_cells(spark, root):
    rows = readers.read_image_folder(spark, root)
    key = F.regexp_extract("origin", r"/(\d+)\.png", 1).cast("bigint").alias("vec_id")
    return rows.select(key, "class", "label", "height", F.posexplode_outer("pixels").alias("pos", "value"))


@query("s7_labelled_image_folder", SQL_FOLDER)
def _(spark, sf):
    return folder_cells(spark, grey_folder(spark, sf))


@query("s7_plain_class_folders", SQL_FOLDER)
def _(spark, sf):
    return folder_cells(spark, grey_folder(spark, sf, ""))


SQL_FILES = "SELECT label::VARCHAR AS class, count(*)::BIGINT AS n FROM embeddings GROUP BY 1"


@query("s8_files_per_class", SQL_FILES)
def _(spark, sf):
    return readers.class_file_counts(spark, grey_folder(spark, sf))


@query("s8_files_per_plain_folder", SQL_FILES)
def _(spark, sf):
    return readers.class_file_counts(spark, grey_folder(spark, sf, ""), "*.png")


@query("i1_rescale_pixels", f"SELECT vec_id, (pos - 1)::INTEGER AS pos, {sql_rnd(SQL_BYTE.format(i='pos') + ' / 255')} AS value FROM {SQL_P}, {CELL}")
def _(spark, sf):
    bytes_ = points(spark, sf).select("vec_id", byte_pixels().alias("px"))
    return long_vector(bytes_.withColumn("px", images.rescale_pixels(F.col("px"))), "px", "vec_id")


@query(
    "i2_resize_nearest",
    "SELECT vec_id, pos::INTEGER AS pos, x[floor((pos // 5 + 0.5::DOUBLE) * 8 / 12)::INTEGER * 8 + floor((pos % 5 + 0.5::DOUBLE) * 8 / 5)::INTEGER + 1] AS value "
    f"FROM {SQL_P}, range(60) t(pos)",
)
def _(spark, sf):
    sized = images.resize(F.col("x"), F.lit(8), F.lit(8), 12, 5, channels=1)
    return points(spark, sf).select("vec_id", F.posexplode_outer(sized).alias("pos", "value"))


@query("i3_width_for_height", "SELECT p_partkey, floor(p_retailprice * 400 / p_size)::INTEGER AS width FROM part")
def _(spark, sf):
    part = read(spark, sf, "part")
    return part.select("p_partkey", images.width_for_height(F.col("p_retailprice"), F.col("p_size")).alias("width"))


# Every cell as a colour pixel: as it is, turned round, and halved.
SQL_COLOUR = (
    "(SELECT vec_id, flatten(list_transform(x, lambda v: [floor(v * 127.0::DOUBLE + 128.0::DOUBLE), floor(v * -127.0::DOUBLE + 128.0::DOUBLE), "
    f"floor(v * 63.5::DOUBLE + 128.0::DOUBLE)])) AS px FROM {SQL_P})"
)


def colour(spark, sf):
    pixel = F.transform("x", lambda v: F.array(*[F.floor(v * k + 128.0).cast("double") for k in (127.0, -127.0, 63.5)]))
    return points(spark, sf).select("vec_id", F.flatten(pixel).alias("px"))


@query(
    "i4_centre_channels",
    f"SELECT vec_id, pos::INTEGER AS pos, {sql_rnd('px[pos + 3 - (pos % 3) * 2] - [103.939, 116.779, 123.68][pos % 3 + 1]')} AS value "
    f"FROM {SQL_COLOUR}, range(192) t(pos)",
)
def _(spark, sf):
    return long_vector(colour(spark, sf).withColumn("px", images.centre_channels(F.col("px"))), "px", "vec_id")


@query(
    "i4_restore_channels",
    "SELECT vec_id, pos::INTEGER AS pos, trunc(greatest(0.0::DOUBLE, least(255.0::DOUBLE, px[pos + 3 - (pos % 3) * 2] * 2 - 200 + "
    f"([103.939, 116.779, 123.68]::DOUBLE[])[3 - pos % 3])))::INTEGER AS value FROM {SQL_COLOUR}, range(192) t(pos)",
)
def _(spark, sf):
    stretched = colour(spark, sf).withColumn("px", F.transform("px", lambda v: v * 2 - 200))
    return stretched.select("vec_id", F.posexplode_outer(images.restore_channels(F.col("px"))).alias("pos", "value"))


@query("i5_horizontal_flip", f"SELECT vec_id, pos::INTEGER AS pos, x[pos // 8 * 8 + 8 - pos % 8] AS value FROM {SQL_P}, range(64) t(pos)")
def _(spark, sf):
    flipped = images.flip_horizontal(F.col("x"), 8)
    return points(spark, sf).select("vec_id", F.posexplode_outer(flipped).alias("pos", "value"))


def sql_spread(what: str, reach: float, middle: float = 0.0) -> str:
    return f"(({sql_uniform(f"'4|{what}|' || vec_id || '|' || copy")} * 2 - 1) * {reach!r}::DOUBLE + {middle!r}::DOUBLE)"


# turn · slant · zoom · (cell - middle) + turn · shift + middle, then four neighbours and the nearest edge.
SQL_WARP = (
    f"w AS (SELECT vec_id, x, copy, radians({sql_spread('rotation', 40.0)}) AS a, {sql_spread('down', 0.2)} * 8 AS down, "
    f"{sql_spread('right', 0.2)} * 8 AS across, radians({sql_spread('shear', 0.2)}) AS s, {sql_spread('zoom_y', 0.2, 1.0)} AS zy, "
    f"{sql_spread('zoom_x', 0.2, 1.0)} AS zx, {sql_uniform("'4|flip|' || vec_id || '|' || copy")} < 0.5 AS flip FROM {SQL_P}, range(2) t(copy)), "
    "g AS (SELECT *, i - 3.5::DOUBLE AS u, (CASE WHEN flip THEN 7 - j ELSE j END) - 3.5::DOUBLE AS v FROM w, range(8) r(i), range(8) c(j)), "
    "t AS (SELECT *, zy * u - sin(s) * zx * v AS p, cos(s) * zx * v AS q FROM g), "
    "spot AS (SELECT *, greatest(0.0::DOUBLE, least(7.0::DOUBLE, cos(a) * p - sin(a) * q + cos(a) * down - sin(a) * across + 3.5)) AS y, "
    "greatest(0.0::DOUBLE, least(7.0::DOUBLE, sin(a) * p + cos(a) * q + sin(a) * down + cos(a) * across + 3.5)) AS z FROM t), "
    "n AS (SELECT *, floor(y)::INTEGER AS y0, floor(z)::INTEGER AS z0 FROM spot), "
    "m AS (SELECT *, least(y0 + 1, 7) AS y1, least(z0 + 1, 7) AS z1, y - y0 AS fy, z - z0 AS fz FROM n) "
)
SQL_WARPED = (
    "(x[y0 * 8 + z0 + 1] * (1 - fz) + x[y0 * 8 + z1 + 1] * fz) * (1 - fy) + (x[y1 * 8 + z0 + 1] * (1 - fz) + x[y1 * 8 + z1 + 1] * fz) * fy"
)


@query(
    "i5_augmented_copies",
    f"WITH {SQL_WARP} SELECT vec_id, copy::INTEGER AS copy, (i * 8 + j)::INTEGER AS pos, {sql_rnd(SQL_WARPED)} AS value FROM m",
)
def _(spark, sf):
    copies = points(spark, sf).withColumn("copy", F.explode(F.lit([0, 1])))
    warp = images.augment_parameters(F.col("vec_id"), F.col("copy"), seed=4)
    out = copies.withColumn("warp", warp).withColumn("px", images.augment(F.col("x"), F.col("warp"), 8, 8, channels=1))
    return long_vector(out, "px", "vec_id", "copy")


IMAGE_NET = mlp.new_network([36, 16, 10], "cross_entropy", seed=1)
IMAGE_SPEC = mlp.TrainSpec(epochs=3, steps=4, rate=1e-3)
SQL_SMALL = (
    "SELECT vec_id AS id, list_transform(range(36), lambda p: "
    + SQL_BYTE.format(i="floor((p // 6 + 0.5::DOUBLE) * 8 / 6)::INTEGER * 8 + floor((p % 6 + 0.5::DOUBLE) * 8 / 6)::INTEGER + 1")
    + f" / 255) AS x0, {sql_one_hot('label', 10)} AS y FROM {SQL_P}"
)


@query(
    "i6_folder_classifier",
    sql_histories({"model": SqlTraining("t", sql_split(SQL_SMALL, True), IMAGE_NET, IMAGE_SPEC, sql_split(SQL_SMALL, False))}),
)
def _(spark, sf):
    rows = readers.read_image_folder(spark, grey_folder(spark, sf))
    key = F.regexp_extract("origin", r"/(\d+)\.png", 1).cast("bigint").alias("id")
    sized = images.resize(F.col("pixels"), F.col("height"), F.col("width"), 6, 6, channels=1)
    ready = rows.select(key, "label", images.rescale_pixels(sized).alias("x"))
    ready = features.one_hot_class(ready, "label", "y", 10).persist()
    train, test = order.prefix_split(ready, "id")
    try:
        return rounded(mlp.train(train, "id", "x", "y", IMAGE_NET, IMAGE_SPEC, validation=test)[1].table(spark))
    finally:
        ready.unpersist()


# ---- losses


@query(
    "j6_neighbour_differences",
    f"SELECT vec_id, (r * 7 + c)::INTEGER AS pos, {sql_rnd('pow(x[r * 8 + c + 1] - x[r * 8 + c + 9], 2)')} AS down, "
    f"{sql_rnd('pow(x[r * 8 + c + 1] - x[r * 8 + c + 2], 2)')} AS \"right\" FROM {SQL_P}, range(7) t(r), range(7) u(c)",
)
def _(spark, sf):
    cells = points(spark, sf).select("vec_id", align.neighbour_squares(F.col("x"), 8, 8).alias("s"))
    flat = cells.select("vec_id", F.posexplode_outer(F.arrays_zip("s.down", "s.right")).alias("pos", "v"))
    return flat.select("vec_id", "pos", rnd("v.down").alias("down"), rnd("v.right").alias("right"))


@query(
    "a16_gram_by_class",
    f"SELECT label, n, (a - 1)::INTEGER AS i, (b - 1)::INTEGER AS j, {sql_rnd('v')} AS value FROM (SELECT label, a, b, count(*)::BIGINT AS n, "
    f"sum(x[a] * x[b]) AS v FROM {SQL_P}, range(1, 65) t(a), range(1, 65) u(b) GROUP BY label, a, b)",
)
def _(spark, sf):
    products = gram(points(spark, sf), "x", "label")
    cells = products.select("label", "n", F.posexplode_outer("gram").alias("p", "value"))
    at = [F.floor(F.col("p") / 64).cast("int").alias("i"), (F.col("p") % 64).alias("j")]
    return cells.select("label", "n", *at, rnd("value").alias("value"))


@query(
    "a16_gram_per_image",
    f"SELECT vec_id, (a * 4 + b)::INTEGER AS pos, {sql_rnd('list_sum(list_transform(range(16), lambda p: x[p * 4 + a + 1] * x[p * 4 + b + 1]))')} AS value "
    f"FROM {SQL_P}, range(4) t(a), range(4) u(b)",
)
def _(spark, sf):
    return long_vector(points(spark, sf).select("vec_id", style.channel_gram(F.col("x"), 4).alias("g")), "g", "vec_id")


SQL_ROLES = (
    f"WITH p AS {SQL_P}, s AS (SELECT vec_id, x, list_reverse(x) AS y FROM p), "
    "k AS (SELECT vec_id, sum(pow(list_sum(list_transform(range(16), lambda q: x[q * 4 + a + 1] * x[q * 4 + b + 1])) - "
    "list_sum(list_transform(range(16), lambda q: y[q * 4 + a + 1] * y[q * 4 + b + 1])), 2)) AS v FROM s, range(4) t(a), range(4) u(b) GROUP BY vec_id), "
    "c AS (SELECT vec_id, sum(pow(x[i] - y[i], 2)) AS v FROM s, range(1, 65) t(i) GROUP BY vec_id), "
    "w AS (SELECT vec_id, sum(pow(pow(x[r * 8 + q + 1] - x[r * 8 + q + 9], 2) + pow(x[r * 8 + q + 1] - x[r * 8 + q + 2], 2), 1.25)) AS v "
    "FROM s, range(7) t(r), range(7) u(q) GROUP BY vec_id) "
)


def both_sides(spark, sf):
    """(vec_id, x, y): every image beside a second one, joined by key."""
    rows = points(spark, sf).select("vec_id", "x")
    return align.pair_modalities(rows, rows.select("vec_id", F.reverse("x").alias("y")), "vec_id")


@query("a20_content_loss", SQL_ROLES + f"SELECT vec_id, {sql_rnd('v')} AS loss FROM c")
def _(spark, sf):
    return both_sides(spark, sf).select("vec_id", rnd(style.content_loss(F.col("x"), F.col("y"))).alias("loss"))


@query("a21_style_loss", SQL_ROLES + f"SELECT vec_id, {sql_rnd('v / (4.0::DOUBLE * 9 * 64 * 64)', 12)} AS loss FROM k")
def _(spark, sf):
    loss = style.style_loss(F.col("x"), F.col("y"), channels=4, size=64)
    return both_sides(spark, sf).select("vec_id", rnd(loss, 12).alias("loss"))


@query("a22_total_variation", SQL_ROLES + f"SELECT vec_id, {sql_rnd('v')} AS loss FROM w")
def _(spark, sf):
    return points(spark, sf).select("vec_id", rnd(style.total_variation(F.col("x"), 8, 8)).alias("loss"))


@query(
    "a23_weighted_loss",
    SQL_ROLES + f"SELECT vec_id, {sql_rnd('0.025::DOUBLE * c.v + k.v / (4.0::DOUBLE * 9 * 64 * 64) + 0.0001::DOUBLE * w.v', 9)} AS loss FROM c JOIN k USING (vec_id) JOIN w USING (vec_id)",
)
def _(spark, sf):
    x, y = F.col("x"), F.col("y")
    terms = {
        "content": style.content_loss(x, y),
        "style": style.style_loss(x, y, channels=4, size=64),
        "variation": style.total_variation(x, 8, 8),
    }
    pairs = F.array(*[F.struct(F.lit(k).alias("term"), v.alias("value")) for k, v in terms.items()])
    rows = both_sides(spark, sf).select("vec_id", F.inline(pairs))
    return style.weighted_loss(rows, "vec_id").select("vec_id", rnd("loss", 9).alias("loss"))
