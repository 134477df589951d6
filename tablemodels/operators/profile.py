"""Profiling: counts, distinct counts, moments, percentiles, histograms."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, IntegralType

from tablemodels.operators.order import percentiles, percentiles_of
from tablemodels.session import small_table


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-null values of every column in one row.

    Exact counts take each column by itself, so that values meet in a shuffle of
    that column alone; one aggregate would shuffle every row once per column.
    """
    cols = list(cols or df.columns)
    if approx:
        return df.agg(*[F.approx_count_distinct(F.col(c)).alias(c) for c in cols])
    each = [
        df.select(F.col(c).alias("v")).filter("v IS NOT NULL").distinct().agg(F.count("*").alias("n")).select(F.lit(i).alias("c"), "n")
        for i, c in enumerate(cols)
    ]
    return reduce(DataFrame.unionByName, each).agg(*[F.max(F.when(F.col("c") == i, F.col("n"))).alias(c) for i, c in enumerate(cols)])


def group_sizes(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key; null keys are no group."""
    return df.na.drop("any", subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, key: str | Column, name: str = "value") -> DataFrame:
    """Rows per value, most frequent first is left to the reader's ``orderBy``."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))


def class_counts(df: DataFrame, label: str, n_classes: int | None = None) -> DataFrame:
    """Rows per class 0..n_classes-1, empty classes included."""
    if n_classes is None:
        n_classes = df.agg(F.max(label)).first()[0] + 1
    counts = df.groupBy(F.col(label).cast("int").alias("label")).agg(F.count("*").alias("n"))
    classes = df.sparkSession.range(n_classes).select(F.col("id").cast("int").alias("label"))
    return classes.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_values(df: DataFrame, col: str | Column, name: str = "value") -> DataFrame:
    col = F.col(col) if isinstance(col, str) else col
    return df.select(col.alias(name)).distinct()


def moments(df: DataFrame, col: str) -> DataFrame:
    """Count, range, mean, sample variance, population skewness and excess kurtosis."""
    return df.agg(
        F.count(col).alias("n"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.avg(col).alias("mean"),
        F.var_samp(col).alias("variance"),
        F.skewness(col).alias("skewness"),
        F.kurtosis(col).alias("kurtosis"),
    )


def percentile_table(df: DataFrame, col: str, probs: Sequence[float] = (0.25, 0.5, 0.75), **kw) -> DataFrame:
    values = percentiles(df, col, probs, **kw)
    return small_table(df.sparkSession, list(zip(map(float, probs), values)), "prob double, value double")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (column, stat, value): count, mean, sample std, min, exact quartiles, max; NaN and null left out.

    One pass of aggregates for all columns, then as many counting passes as the deepest column needs.
    """
    aggs = []
    for c in cols:
        x = F.when(~F.isnan(c), F.col(c)) if isinstance(df.schema[c].dataType, (FloatType, DoubleType)) else F.col(c)
        aggs += [F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)]
    flat = df.agg(*aggs).first()
    of = {c: flat[5 * i : 5 * i + 5] for i, c in enumerate(cols)}
    plain = all(isinstance(df.schema[c].dataType, (IntegralType, FloatType, DoubleType)) for c in cols)
    quartiles = percentiles_of(df, cols, (0.25, 0.5, 0.75), bounds={c: (v[0], *v[3:]) for c, v in of.items()} if plain else None)
    rows = []
    for c, (n, mean, std, lo, hi) in of.items():
        q1, q2, q3 = quartiles[c]
        stats = {"count": n, "mean": mean, "std": std, "min": lo, "25%": q1, "50%": q2, "75%": q3, "max": hi}
        rows += [(c, k, None if v is None else float(v)) for k, v in stats.items()]
    return small_table(df.sparkSession, rows, "column string, stat string, value double")


def value_range(df: DataFrame, *cols: str) -> DataFrame:
    """One row per column: its minimum and maximum."""
    flat = df.agg(*[f(c) for c in cols for f in (F.min, F.max)]).first()
    rows = [(c, _float(flat[2 * i]), _float(flat[2 * i + 1])) for i, c in enumerate(cols)]
    return small_table(df.sparkSession, rows, "column string, min double, max double")


def mean_std(df: DataFrame, *cols: str) -> DataFrame:
    """One row per column: its mean and population standard deviation."""
    flat = df.agg(*[f(c) for c in cols for f in (F.avg, F.stddev_pop)]).first()
    rows = [(c, _float(flat[2 * i]), _float(flat[2 * i + 1])) for i, c in enumerate(cols)]
    return small_table(df.sparkSession, rows, "column string, mean double, std double")


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between minimum and maximum, the last one closed on both sides; NaN and null are in none."""
    df = df.filter(~F.isnan(F.col(col).cast("double")))
    lo, hi = df.agg(F.min(col).cast("double"), F.max(col).cast("double")).first()
    spark = df.sparkSession
    if lo is None:
        return small_table(spark, [], "bin int, lower double, upper double, n bigint")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    bucket = F.least(F.width_bucket(F.col(col).cast("double"), F.lit(lo), F.lit(hi), F.lit(bins)), F.lit(bins))
    counts = df.filter(F.col(col).isNotNull()).groupBy(bucket.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    axis = spark.range(1, bins + 1).select(
        F.col("id").cast("int").alias("bin"),
        (F.lit(lo) + (F.col("id") - 1) * width).alias("lower"),
        (F.lit(lo) + F.col("id") * width).alias("upper"),
    )
    return axis.join(counts, "bin", "left").select("bin", "lower", "upper", F.coalesce("n", F.lit(0)).alias("n"))


def _float(v):
    return None if v is None else float(v)
