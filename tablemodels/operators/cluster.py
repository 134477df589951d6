"""K-means with normal or ++ start, assignment, representatives and objective history.

A round is one job: tasks fold their rows into one partial row per cluster, the
K sums come back, and the next centres leave with the next job.  Plans stay the
same size whatever the number of rounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablemodels.operators.blocks import fold, matrix_of, squared_distances, sum_vectors, vector_width
from tablemodels.operators.sampling import normal_start, uniform_draw, weighted_draw
from tablemodels.session import check_model_size, scratch_dir, small_table

# Rounds of a ++ start after which the running distances are written, so that no lineage grows.
CUT_ROUNDS = 16
# Groups of tasks whose closest points are ranked first, per centre.
RANK_SALT = 32


@dataclass
class KMeansModel:
    centres: np.ndarray
    history: list[float] = field(default_factory=list)

    def centre_table(self, spark: SparkSession) -> DataFrame:
        rows = [(k, c.tolist()) for k, c in enumerate(self.centres)]
        return small_table(spark, rows, "cluster int, centre array<double>")

    def history_table(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, list(enumerate(self.history)), "step int, objective double")


def nearest(vector: Column, centres: np.ndarray) -> Column:
    """struct(cluster, dist): nearest centre, lowest number on ties, and its squared distance."""
    check_model_size(centres.size, "centre table")

    @F.arrow_udf("struct<cluster:int,dist:double>")
    def assign(x: pa.Array) -> pa.Array:
        d = squared_distances(matrix_of(x), centres)
        best = d.argmin(axis=1) if len(d) else np.zeros(0, int)
        return pa.StructArray.from_arrays(
            [pa.array(best.astype(np.int32)), pa.array(d[np.arange(len(d)), best])], names=["cluster", "dist"]
        )

    return assign(vector)


def distances(vector: Column, centres: np.ndarray) -> Column:
    """Squared distance to every centre, one vector per row and no rows multiplied."""
    check_model_size(centres.size, "centre table")

    @F.arrow_udf("array<double>")
    def all_distances(x: pa.Array) -> pa.Array:
        d = squared_distances(matrix_of(x), centres)
        offsets = pa.array(np.arange(len(d) + 1, dtype=np.int32) * len(centres))
        return pa.ListArray.from_arrays(offsets, pa.array(d.reshape(-1)))

    return all_distances(vector)


def assign(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Adds ``cluster`` and ``dist``."""
    found = df.withColumn("_near", nearest(F.col(vector), centres))
    return found.withColumns({"cluster": F.col("_near.cluster"), "dist": F.col("_near.dist")}).drop("_near")


def objective(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Σ squared distance to the nearest centre."""
    return df.select(nearest(F.col(vector), centres).alias("a")).agg(F.sum("a.dist").alias("objective"))


def cluster_sums(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """(cluster, total vector, n, sse) of the points nearest to each centre."""
    check_model_size(centres.size, "centre table")
    k = len(centres)

    def step(state, x):
        x = matrix_of(x)
        d = squared_distances(x, centres)
        best = d.argmin(axis=1)
        if state is None:
            state = np.zeros(k, np.int64), np.zeros(k), np.zeros_like(centres)
        n, sse, total = state
        n += np.bincount(best, minlength=k)
        sse += np.bincount(best, weights=d[np.arange(len(d)), best], minlength=k)
        for c in np.unique(best):
            total[c] += x[best == c].sum(axis=0)
        return state

    def finish(state):
        n, sse, total = state
        return ((c, total[c], int(n[c]), float(sse[c])) for c in range(k) if n[c])

    partials = fold(df.select(vector), step, finish, "cluster int, total array<double>, n bigint, sse double")
    return sum_vectors(partials, ["cluster"], "total", ["n", "sse"])


def plus_plus_start(
    df: DataFrame, id_col: str, vector: str, k: int, seed: int, weight: str = "d4"
) -> np.ndarray:
    """K-means++ centres.  The weight is the squared distance squared; ``'d2'`` takes it plain.

    Each row keeps its distance to the nearest centre so far, so a round looks
    at the newest centre only.  When every point coincides with a centre the
    first centre fills the rest.
    """
    if weight not in ("d4", "d2"):
        raise ValueError("weight is 'd4' or 'd2'")
    rows = df.select(id_col, vector)
    first = uniform_draw(rows, id_col, f"{seed}|0", vector).first()
    centres, near = [np.array(first[vector], dtype=np.float64)], rows.withColumn("_d", F.lit(float("inf")))
    held = []
    try:
        for i in range(1, k):
            newest = nearest(F.col(vector), centres[-1][None])["dist"]
            near = near.withColumn("_d", F.least("_d", newest))
            if i % CUT_ROUNDS == 0:
                path = scratch_dir(df.sparkSession, "start-distances")
                near.write.parquet(path)
                near = df.sparkSession.read.schema(near.schema).parquet(path)
            else:
                near = near.persist(StorageLevel.MEMORY_AND_DISK)
            w = F.col("_d") * F.col("_d") if weight == "d4" else F.col("_d")
            row = weighted_draw(near, id_col, w, f"{seed}|{i}", vector).first()
            while held:
                held.pop().unpersist()
            held = [near]
            drawn = centres[0] if row is None else np.array(row[vector], dtype=np.float64)
            centres.append(drawn)
    finally:
        for frame in held:
            frame.unpersist()
    return np.array(centres)


def kmeans_fit(
    df: DataFrame,
    id_col: str,
    vector: str,
    k: int,
    start: str | np.ndarray = "normal",
    rounds: int = 100,
    tol: float | None = None,
    seed: int = 0,
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
) -> KMeansModel:
    """Lloyd rounds from a normal, ``'++'`` or given start.

    Runs exactly ``rounds`` rounds unless ``tol`` stops it once a round improves
    the objective by less.  An empty cluster keeps its centre.  The history has
    two values a round: after assigning and after moving the centres.
    """
    data = df.select(id_col, vector)
    if storage:
        data = data.persist(storage)
    try:
        if isinstance(start, np.ndarray):
            centres = start.astype(np.float64).copy()
        elif start == "normal":
            centres = normal_start(k, vector_width(data, vector), seed)
        else:
            centres = plus_plus_start(data, id_col, vector, k, seed)
        history: list[float] = []
        for _ in range(rounds):
            assigned = moved = 0.0
            following = centres.copy()
            for r in cluster_sums(data, vector, centres).collect():  # k rows
                c, n = r["cluster"], r["n"]
                following[c] = np.array(r["total"]) / n
                shift = following[c] - centres[c]
                assigned += r["sse"]
                moved += r["sse"] - n * float(shift @ shift)
            history += [assigned, moved]
            centres = following
            if tol is not None and assigned - moved < tol:
                break
        return KMeansModel(centres, history)
    finally:
        if storage:
            data.unpersist()


def representatives(df: DataFrame, id_col: str, vector: str, centres: np.ndarray, top: int) -> DataFrame:
    """The ``top`` closest points of each centre, whether or not they belong to it.

    Each task keeps its own closest points, so that only tasks × K × top rows are ranked.
    """
    check_model_size(centres.size, "centre table")
    kind = df.schema[id_col].dataType.simpleString()

    def closest(ids: np.ndarray, d: np.ndarray) -> np.ndarray:
        keep = np.arange(len(d))
        if len(d) > top:
            keep = keep[d <= np.partition(d, top - 1)[top - 1]]
        return keep[np.lexsort((ids[keep], d[keep]))][:top]

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(None, None)] * len(centres)
        kind_of_id = None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind_of_id = batch.column(0).type
            ids, d = batch.column(0).to_numpy(zero_copy_only=False), squared_distances(matrix_of(batch.column(1)), centres)
            for c in range(len(centres)):
                old_ids, old_d = best[c]
                all_ids = ids if old_ids is None else np.concatenate([old_ids, ids])
                all_d = d[:, c] if old_d is None else np.concatenate([old_d, d[:, c]])
                keep = closest(all_ids, all_d)
                best[c] = all_ids[keep], all_d[keep]
        if kind_of_id is not None:
            sizes = [len(b[0]) for b in best]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(len(centres), dtype=np.int32), sizes)),
                    pa.array(np.concatenate([b[0] for b in best]), type=kind_of_id),
                    pa.array(np.concatenate([b[1] for b in best])),
                ],
                names=["cluster", id_col, "dist"],
            )

    few = df.select(id_col, vector).mapInArrow(per_task, f"cluster int, `{id_col}` {kind}, dist double")
    few = few.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(RANK_SALT)))
    for keys in (["cluster", "_salt"], ["cluster"]):  # so that no task sees more than salt × top rows of a centre
        order = Window.partitionBy(*keys).orderBy("dist", id_col)
        few = few.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return few.drop("_salt")
