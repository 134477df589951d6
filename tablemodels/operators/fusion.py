"""Two networks over the two sides of joined rows: trained together under a head, or kept as they are below it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemodels.operators.align import pair_modalities
from tablemodels.operators.mlp import Branches, History, Network, TrainSpec, forward, new_network, train


def branched(parts: Sequence[Network], n_classes: int, hidden: Sequence[int] = (64, 64, 64), seed: int = 0) -> Branches:
    """A softmax head over the outputs of the given networks; ``mlp.train`` trains all of it, one input column per network."""
    return Branches(list(parts), new_network([sum(p.n_out for p in parts), *hidden, n_classes], "cross_entropy", seed))


def join_blocks(left: DataFrame, right: DataFrame, id_col: str, vector: str, left_name: str, right_name: str) -> DataFrame:
    """Both sides' vectors in one row for the keys that both have; other columns come from the left side."""
    renamed = right.select(id_col, F.col(vector).alias(right_name))
    return pair_modalities(left.withColumnRenamed(vector, left_name), renamed, id_col)


def fuse(
    left: DataFrame, left_vector: str, left_net: Network,
    right: DataFrame, right_vector: str, right_net: Network,
    id_col: str, output: str = "fused",
) -> DataFrame:
    """Both networks' outputs side by side for the keys that both tables have."""
    a = left.withColumn("_left", forward(F.col(left_vector), left_net))
    b = right.select(id_col, forward(F.col(right_vector), right_net).alias("_right"))
    joined = pair_modalities(a, b, id_col)
    return joined.withColumn(output, F.concat("_left", "_right")).drop("_left", "_right")


def train_head(
    fused: DataFrame, id_col: str, target: str, n_classes: int, width: int, spec: TrainSpec,
    hidden: Sequence[int] = (64, 64, 64), validation: DataFrame | None = None,
) -> tuple[Network, History]:
    """Softmax head on the fused vector; the two base networks stay as they are."""
    net = new_network([width, *hidden, n_classes], "cross_entropy", spec.seed)
    return train(fused, id_col, "fused", target, net, spec, validation, "fused")
