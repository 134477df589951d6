"""Raw table to model-ready rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemodels.functions import clean
from tablemodels.functions import vectors as V
from tablemodels.operators import features
from tablemodels.operators.order import percentiles
from tablemodels.operators.sampling import hash_split


def class_share_by_quartile(df: DataFrame, col: str) -> DataFrame:
    """Clean a text column, cut it at its own quartiles and count the classes."""
    present = clean.require_present(df.select(col), [col])
    number = clean.cast_columns(present, [col], "double").filter(F.col(col).isNotNull())
    number.persist(StorageLevel.MEMORY_AND_DISK)  # eight bytes a row, read once a pass instead of the text
    try:
        cuts = percentiles(number, col, (0.25, 0.5, 0.75))
    finally:
        number.unpersist()
    classed = number.select(clean.bucket_by_cuts(F.col(col), cuts).alias("class"))
    return classed.groupBy("class").agg(F.count("*").alias("n"))


def prepare_classification(
    df: DataFrame,
    id_col: str,
    numbers: Sequence[str],
    category: str,
    label: str,
    scale_max: float = 250.0,
    seed: int | str = 1234,
) -> tuple[DataFrame, DataFrame]:
    """Dirty text columns to (train, test) rows ready for a classifier.

    Incomplete rows go, numbers are cast, the category is indexed by frequency,
    numbers and index form ``features``, the label is indexed and one-hot coded,
    features are mapped from 0..scale_max to 0..1 and shaped as a one-row matrix.
    """
    rows = clean.require_present(df.select(id_col, *numbers, category, label), [*numbers, category, label])
    rows = clean.drop_incomplete(clean.cast_columns(rows, numbers, "double"), numbers)
    labels = features.frequency_labels(rows, label)
    indexed = features.index_by_frequency(rows, category, "category_index")
    indexed = features.index_column(indexed, label, labels, "label_index")
    width = len(numbers) + 1
    vector = indexed.withColumn("features", V.assemble(*numbers, "category_index"))
    ready = vector.withColumn("features_normalized", V.rescale(F.col("features"), 0.0, 1.0, 0.0, scale_max))
    ready = ready.select(
        id_col,
        label,
        "label_index",
        V.one_hot(F.col("label_index"), len(labels)).alias("label_encoded"),
        "features_normalized",
        V.reshape(F.col("features_normalized"), 1, width).alias("matrix"),
    )
    train, test = hash_split(ready, id_col, (80, 20), seed)
    return train, test


def feature_rows(
    df: DataFrame,
    id_col: str,
    numbers: Sequence[str],
    categories: Sequence[str],
    cycle_of: str | None = None,
    n_cycle: int = 12,
    scaled: bool = True,
    fit_on: DataFrame | None = None,
) -> DataFrame:
    """(id, features): numbers, then the one-hot block of every category, standardised.

    ``cycle_of`` replaces that number by the one-hot block of its place in the cycle.
    """
    rows, blocks = df, []
    plain = [c for c in numbers if c != cycle_of]
    if plain:
        blocks.append(V.assemble(*plain))
    coded = list(categories)
    if cycle_of:
        rows = rows.withColumn("_cycle", clean.cycle(F.col(cycle_of), n_cycle).cast("int").cast("string"))
        coded = ["_cycle", *coded]
    for c in coded:
        labels = features.alphabetical_labels(rows, c)
        if c == "_cycle":
            labels = sorted(labels, key=int)
        rows = features.one_hot_sorted(rows, c, f"_hot_{c}", labels)
        blocks.append(F.col(f"_hot_{c}"))
    wide = rows.select(id_col, V.concat_blocks(*blocks).alias("features"))
    if not scaled:
        return wide
    return features.standardise(wide, "features", "features", fit_on)
