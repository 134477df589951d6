"""Reproducible splits, draws, mini-batches and cached inputs.

Random choices are hashes of (seed, id), so they do not depend on how the rows
are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemodels.operators.order import number_rows
from tablemodels.session import MAX_LOOKUP_ROWS, hash_uniform, scratch_dir


def hash_split(
    df: DataFrame, id_col: str, shares: Sequence[int] = (80, 20), seed: int | str = 1234
) -> list[DataFrame]:
    """Disjoint, complete parts of about ``shares`` percent each, decided by the id alone."""
    if sum(shares) != 100:
        raise ValueError("shares must add up to 100")
    text = F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string"))
    slot = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100
    ends = np.cumsum(shares).tolist()
    return [df.filter((slot >= hi - s) & (slot < hi)) for s, hi in zip(shares, ends)]


def random_split(df: DataFrame, shares: Sequence[float] = (0.8, 0.2), seed: int = 1234) -> list[DataFrame]:
    """Spark's own split; its parts depend on the partitioning of the input."""
    return df.randomSplit(list(shares), seed=seed)


def spread(df: DataFrame, workers: int, *keys: str) -> DataFrame:
    """Rows over ``workers`` partitions, by key when given."""
    return df.repartition(workers, *keys)


@contextmanager
def cached(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> Iterator[tuple[DataFrame, int]]:
    """The persisted frame and its row count; released on the way out."""
    held = df.persist(level)
    try:
        yield held, held.count()
    finally:
        held.unpersist()


def normal_vector(seed: int | str, id_col: Column, width: int) -> Column:
    """Standard normal draws as a vector: place j is a function of (seed, id, j) alone."""

    def draw(j: Column) -> Column:
        radius = F.sqrt(-2.0 * F.ln(hash_uniform(f"{seed}|r", id_col, j)))
        return radius * F.cos(2.0 * np.pi * hash_uniform(f"{seed}|a", id_col, j))

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), draw)


def normal_start(k: int, width: int, seed: int | str) -> np.ndarray:
    """The vectors of :func:`normal_vector` for ids 0..k-1, taken on the driver."""
    radius, angle = (
        np.array([_driver_uniforms(f"{seed}|{part}|{c}", width) for c in range(k)]) for part in ("r", "a")
    )
    return np.sqrt(-2.0 * np.log(radius)) * np.cos(2.0 * np.pi * angle)


def _earliest(df: DataFrame, id_col: str, clock: Column, payload: Sequence[str]) -> DataFrame:
    """The row with the smallest finite clock, lowest id on ties.

    Only (clock, id) goes through the aggregate; the row itself is then a
    filter on its id.
    """
    row = df.agg(F.min(F.struct(F.coalesce(clock, F.lit(float("inf"))).alias("clock"), id_col)).alias("r")).first()["r"]
    if row is None or row["clock"] == float("inf"):
        return df.select(id_col, *payload).limit(0)
    return df.filter(F.col(id_col) == F.lit(row[id_col])).select(id_col, *payload)


def uniform_draw(df: DataFrame, id_col: str, seed: int | str, *payload: str) -> DataFrame:
    """One row, each equally likely: the smallest hash wins."""
    return _earliest(df, id_col, hash_uniform(seed, F.col(id_col)), payload)


def weighted_draw(df: DataFrame, id_col: str, weight: Column, seed: int | str, *payload: str) -> DataFrame:
    """One row with probability proportional to its weight: the earliest exponential clock wins.

    Rows of no weight are left to never tick rather than filtered: a filter
    would have a computed weight worked out twice.
    """
    clock = F.when(weight > 0, -F.ln(hash_uniform(seed, F.col(id_col))) / weight)
    return _earliest(df, id_col, clock, payload)


# Draws descend by so many bits of hash at first, then by so many a level, until a bucket holds about a handful of rows.
FIRST_BITS, LEVEL_BITS, HASH_BITS = 16, 12, 60
HANDFUL = 16


def _hash_bits(id_col: Column) -> Column:
    return F.conv(F.substring(F.md5(id_col.cast("string")), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _first_places(draws: DataFrame, sizes: np.ndarray) -> DataFrame:
    """(t, b, place): the bucket of each drawn row number, and the place inside it."""
    ends = np.cumsum(sizes)

    @F.arrow_udf("struct<b:bigint,place:bigint>")
    def find(p: pa.Array) -> pa.Array:
        p = p.to_numpy()
        b = np.searchsorted(ends, p, side="right")
        return pa.StructArray.from_arrays([pa.array(b), pa.array(p - (ends - sizes)[b])], names=["b", "place"])

    return draws.withColumn("at", find("p")).select("t", "at.b", "at.place")


def _descend(rows: DataFrame, draws: DataFrame, bits: int, deeper: int) -> DataFrame:
    """Draws with their bucket of ``deeper`` bits: only buckets that were drawn from are counted."""
    nodes = draws.select("b").distinct()
    child = F.shiftright("h", HASH_BITS - deeper)
    held = rows.select(F.shiftright("h", HASH_BITS - bits).alias("b"), child.alias("child")).join(nodes, "b", "left_semi")
    sizes = held.groupBy("b", "child").agg(F.count("*").alias("n"))
    before = Window.partitionBy("b").orderBy("child").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("place"), "child", F.lit(None).cast("long").alias("t"))
    both = starts.unionByName(draws.select("b", "place", F.lit(None).cast("bigint").alias("child"), "t"))
    # A draw belongs to the last child that starts at or before it.
    near = Window.partitionBy("b").orderBy("place", F.col("t").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.select(
        "t", "place", F.last("child", ignorenulls=True).over(near).alias("child"),
        F.last(F.when(F.col("t").isNull(), F.col("place")), ignorenulls=True).over(near).alias("start"),
    )
    return found.filter("t IS NOT NULL").select("t", F.col("child").alias("b"), (F.col("place") - F.col("start")).alias("place"))


def draw_with_replacement(
    df: DataFrame, id_col: str, n: int, seed: int | str, *payload: str, handful: int = HANDFUL, first_bits: int = FIRST_BITS
) -> DataFrame:
    """n uniform draws with replacement as (t, id, payload...), t = 0..n-1.

    Rows are numbered by (hash of the id, id).  Counts of hash buckets turn each
    drawn number into a place inside one bucket; buckets that are still large
    are counted by further bits, and only those that were drawn from.  At the
    end a bucket holds about a handful of rows, and only these are ranked: their
    number goes with the draws, not with the table.  Rows without an id are
    never drawn.
    """
    spark = df.sparkSession
    rows = df.filter(F.col(id_col).isNotNull()).select(id_col, *payload, _hash_bits(F.col(id_col)).alias("h"))
    bucket = F.shiftright("h", HASH_BITS - first_bits)
    counts = rows.groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).toArrow()  # one row per first bucket
    sizes = np.zeros(1 << first_bits, np.int64)
    sizes[counts["b"].to_numpy()] = counts["n"].to_numpy()
    total = int(sizes.sum())
    if not total:
        raise ValueError("no rows to draw from")
    number = F.floor(hash_uniform(seed, F.col("id")) * F.lit(float(total)))
    draws = _first_places(spark.range(n).select(F.col("id").alias("t"), number.alias("p")), sizes)
    bits = first_bits
    while total / 2**bits > handful and bits < HASH_BITS:
        deeper = min(bits + LEVEL_BITS, HASH_BITS)
        path = scratch_dir(spark, "draws")
        _descend(rows, draws, bits, deeper).write.parquet(path)
        draws, bits = spark.read.schema("t long, b long, place long").parquet(path), deeper
    leaf = rows.withColumn("b", F.shiftright("h", HASH_BITS - bits))
    leaves = draws.select("b").distinct()
    inside = leaf.join(F.broadcast(leaves) if n <= MAX_LOOKUP_ROWS else leaves, "b", "left_semi")
    ranked = inside.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy("h", id_col)).cast("long") - 1)
    found = ranked.join(F.broadcast(draws) if n <= MAX_LOOKUP_ROWS else draws, ["b", "place"])
    return found.select(F.col("t").cast("int" if n < 2**31 else "long").alias("t"), id_col, *payload)


def _driver_uniforms(seed: int | str, n: int) -> list[float]:
    """The values of :func:`hash_uniform` for keys 0..n-1, taken on the driver."""
    bits = (int(md5(f"{seed}|{t}".encode()).hexdigest()[:12], 16) for t in range(n))
    return [(b + 0.5) / 2.0**48 for b in bits]


def mini_batches(df: DataFrame, id_col: str, size: int, seed: int | str = 0, name: str = "batch") -> DataFrame:
    """Adds a batch number: rows in an order drawn from (seed, unique id), ``size`` a batch, only the last one shorter."""
    place = number_rows(df, name, hash_uniform(seed, F.col(id_col)), F.col(id_col))
    return place.withColumn(name, F.floor(F.col(name) / size))
