"""Per-group means and covariances, class priors, Gram sums."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemodels.functions import vectors as V
from tablemodels.operators.blocks import collect_vectors, gram, usable_rows, vector_width
from tablemodels.session import MAX_LOOKUP_ROWS, check_model_size, collect_bounded, scratch_dir, small_table

# Up to this width all pairs of columns are plain aggregates in one pass.
NARROW = 8
# Above so many groups rows are brought together by group before their products are taken.
FEW_GROUPS = 64
# Rows of a group that go to one task then.
PART_ROWS = 100_000


def group_means(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, mean vector) for any number of groups."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(V.as_vector(F.col(vector)))))
    return df.groupBy(key).agg(F.count("*").alias("n"), mean.alias("mean"))


def group_covariances(df: DataFrame, key: str, vector: str, width: int | None = None) -> DataFrame:
    """(key, n, mean, cov) with the n-1 covariance matrix; a one-row group fails.

    A row with a null vector or a null cell takes no part; any other length than ``width`` fails. A null key is a group.
    """
    width = width or vector_width(df, vector)
    df = usable_rows(df.select(key, vector), vector, width)
    if width <= NARROW:
        out = _narrow_covariances(df, key, vector, width)
    else:
        out = _wide_covariances(df, key, vector, width)
    message = F.concat(F.lit("covariance needs two rows, group "), F.col(key).cast("string"))
    return out.withColumn("cov", F.when(F.col("n") > 1, F.col("cov")).otherwise(F.raise_error(message)))


def _narrow_covariances(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    cols = [F.col(vector)[i].cast("double").alias(f"x{i}") for i in range(width)]
    aggs = [F.avg(f"x{i}").alias(f"m{i}") for i in range(width)]
    aggs += [F.covar_samp(f"x{i}", f"x{j}").alias(f"c{i}_{j}") for i in range(width) for j in range(i, width)]
    flat = df.select(key, *cols).groupBy(key).agg(F.count("*").alias("n"), *aggs)
    cov = F.array(
        *[F.array(*[F.col(f"c{min(i, j)}_{max(i, j)}") for j in range(width)]) for i in range(width)]
    )
    return flat.select(key, "n", F.array(*[f"m{i}" for i in range(width)]).alias("mean"), cov.alias("cov"))


def _wide_covariances(df: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Means first, then sums of centred products; neither the groups nor the rows of one are bounded.

    With few groups each task adds up products of its own rows.  With many a
    group has too few rows in a task for that, so rows are brought together by
    group, large groups in several parts.
    """
    path = scratch_dir(df.sparkSession, "group-means")
    group_means(df, key, vector).withColumnRenamed(key, "_key").write.parquet(path)
    means = df.sparkSession.read.parquet(path)
    same = F.col(key).eqNullSafe(F.col("_key"))
    centred = df.join(means, same).select(
        key, F.zip_with(vector, "mean", lambda v, m: v.cast("double") - m).alias(vector),
        F.pmod(F.xxhash64(vector), F.ceil(F.col("n") / PART_ROWS)).alias("_part"),
    )
    if means.count() > FEW_GROUPS:
        centred = centred.repartition(key, "_part").sortWithinPartitions(key)
    products = gram(centred.drop("_part"), vector, key).drop("n").join(means, same)
    scaled = V.scale(F.col("gram"), 1.0 / (F.col("n") - 1.0))
    return products.select(key, "n", "mean", V.reshape(scaled, width, width).alias("cov"))


def shared_covariance(covariances: DataFrame) -> DataFrame:
    """Σ n_c·Cov_c / N as rows (i, j, value)."""
    cells = covariances.select("n", F.posexplode("cov").alias("i", "row")).select(
        "n", "i", F.posexplode("row").alias("j", "value")
    )
    return cells.groupBy("i", "j").agg((F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value"))


def log_priors(df: DataFrame, label: str) -> DataFrame:
    """(label, log(n_c / N)); the per-class counts are all that the total is taken from."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    rows = collect_bounded(counts, MAX_LOOKUP_ROWS, "classes")
    n = sum(r["n"] for r in rows)
    table = [(r[label], r["n"], float(np.log(r["n"] / n))) for r in rows]
    kind = df.schema[label].dataType.simpleString()
    return small_table(df.sparkSession, table, f"`{label}` {kind}, n bigint, log_prior double")


def normal_sums(df: DataFrame, basis: str, target: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XᵀX and Xᵀy of a basis vector column: one aggregate row, or Arrow partials when wide.

    A row with a null target, basis or basis cell takes no part; any other length than ``width`` fails.
    """
    df = usable_rows(df.filter(F.col(target).isNotNull()).select(basis, target), basis, width, "basis")
    if width <= NARROW:
        cols = [F.col(basis)[i].alias(f"b{i}") for i in range(width)]
        names = [f"b{i}" for i in range(width)] + ["y"]
        pairs = [(i, j) for i in range(width) for j in range(i, width + 1)]
        aggs = [F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]
        row = df.select(*cols, F.col(target).cast("double").alias("y")).agg(*aggs).first()
        full = np.zeros((width + 1, width + 1))
        for (i, j), v in zip(pairs, row):
            full[i, j] = full[j, i] = v
    else:
        check_model_size((width + 1) ** 2, "Gram matrix")
        rows = df.select(F.concat(basis, F.array(F.col(target).cast("double"))).alias("row"))
        full = collect_vectors(gram(rows, "row"), "gram").reshape(width + 1, width + 1)
    return full[:width, :width], full[:width, width]
