"""Category indexes, one-hot vectors and column scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import OneHotEncoder, StringIndexerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemodels.functions import vectors as V
from tablemodels.operators.blocks import map_rows, when_whole
from tablemodels.operators.order import number_rows
from tablemodels.session import MAX_LOOKUP_ROWS, collect_bounded

# Vector width up to which scaling is a plain expression.
NARROW = 16


def frequency_labels(df: DataFrame, col: str) -> list[str]:
    """Values by descending count, ties alphabetical; nulls have no index."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    ranked = counts.orderBy(F.desc("n"), F.asc(col)).select(F.col(col).cast("string"))
    return [r[0] for r in collect_bounded(ranked, MAX_LOOKUP_ROWS, f"category list of {col}")]


def alphabetical_labels(df: DataFrame, col: str) -> list[str]:
    values = df.filter(F.col(col).isNotNull()).select(F.col(col).cast("string")).distinct().orderBy(col)
    return [r[0] for r in collect_bounded(values, MAX_LOOKUP_ROWS, f"category list of {col}")]


def index_column(df: DataFrame, col: str, labels: Sequence[str], output: str, unseen: str = "error") -> DataFrame:
    """Label position as a double; a value outside the labels fails, or is skipped or kept as the last index."""
    model = StringIndexerModel.from_labels(list(labels), inputCol=col, outputCol=output, handleInvalid=unseen)
    return model.transform(df)


def index_by_frequency(df: DataFrame, col: str, output: str) -> DataFrame:
    return index_column(df, col, frequency_labels(df, col), output)


def frequency_index_table(df: DataFrame, col: str) -> DataFrame:
    """(value, index) in the same order for columns with too many categories to hold on the driver.

    Join it on the value to index the column.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))
    return number_rows(counts, "index", F.desc("n"), F.asc("value")).select("value", "index")


def one_hot_sparse(df: DataFrame, index: str, output: str, drop_last: bool = True) -> DataFrame:
    """Sparse one-hot vector of an index column, the last category being all zeros."""
    return OneHotEncoder(inputCol=index, outputCol=output, dropLast=drop_last).fit(df).transform(df)


def one_hot_sorted(df: DataFrame, col: str, output: str, labels: Sequence[str] | None = None) -> DataFrame:
    """Dense one-hot vector in alphabetical category order."""
    labels = labels or alphabetical_labels(df, col)
    indexed = index_column(df, col, labels, f"_{output}_index")
    return indexed.withColumn(output, V.one_hot(F.col(f"_{output}_index"), len(labels))).drop(f"_{output}_index")


def one_hot_class(df: DataFrame, label: str, output: str, n_classes: int | None = None) -> DataFrame:
    """Dense one-hot vector of classes 0..max."""
    if n_classes is None:
        n_classes = df.agg(F.max(label)).first()[0] + 1
    return df.withColumn(output, V.one_hot(F.col(label), int(n_classes)))


@dataclass
class Scaler:
    mean: np.ndarray
    std: np.ndarray  # population; 1 where the column is constant

    def apply(self, x: Column) -> Column:
        """(x − mean) / std: an expression for a narrow vector, Arrow batches for a wide one; null for a vector that is or holds null."""
        if len(self.mean) > NARROW:
            mean, std = self.mean, self.std
            return map_rows(x, len(mean), lambda rows: (rows - mean) / std)
        spread = F.zip_with(x, V.literal_vector(self.mean), lambda v, m: v - m)
        return when_whole(x, len(self.mean), F.zip_with(spread, V.literal_vector(self.std), lambda v, s: v / s))


def fit_scaler(df: DataFrame, vector: str) -> Scaler:
    """Mean and population standard deviation of every element in one pass.

    Fit on all rows or on the training rows, as the caller passes them.
    """
    summary = Summarizer.metrics("mean", "variance", "count", "min", "max").summary(array_to_vector(F.col(vector)))
    row = df.select(summary.alias("s")).select(
        *[vector_to_array(F.col(f"s.{m}")) for m in ("mean", "variance", "min", "max")], "s.count"
    ).first()
    mean, var, lo, hi = (np.array(v) for v in row[:4])
    n = row[4]
    std = np.sqrt(var * (n - 1) / n) if n > 1 else np.zeros_like(mean)
    return Scaler(mean, np.where((lo == hi) | (std == 0), 1.0, std))


def standardise(df: DataFrame, vector: str, output: str, fit_on: DataFrame | None = None) -> DataFrame:
    scaler = fit_scaler(df if fit_on is None else fit_on, vector)
    return df.withColumn(output, scaler.apply(F.col(vector)))
