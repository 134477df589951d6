"""Kernel perceptron and its budget form, trained in rounds or one draw after the other.

Draws are taken from the whole table with replacement.  A round scores its draws
in the tasks against the support set sent along, and only rows that are
mistakes come back; they join the support together.  A support above the budget
then loses, one after the other, the elements that are best classified without
themselves.  With one draw a round this is the plain order of one draw after
the other; more draws a round mean fewer jobs.

``in_order`` keeps the plain order with any number of draws a round: once scored,
a round's draws are gone through one by one in a task, which corrects their
scores by what earlier ones added or took away, and again only mistakes come back.

Rows with a null vector, cell, sign or id take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.operators.blocks import matrix_of, usable_rows, vector_width
from tablemodels.operators.sampling import draw_with_replacement
from tablemodels.session import check_model_size, small_table

# Kernel matrix of two row sets: (n × d, m × d) -> n × m.
KernelMatrix = Callable[[np.ndarray, np.ndarray], np.ndarray]

BLOCK_CELLS = 2_000_000


def linear(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b.T


@dataclass
class PerceptronModel:
    ids: list
    signs: np.ndarray
    vectors: np.ndarray
    kernel: KernelMatrix = linear
    updates: list[tuple[int, int]] = field(default_factory=list)  # (round, or changing draw in order; support size after it)

    def table(self, spark: SparkSession, id_type: str = "bigint") -> DataFrame:
        rows = [(i, int(a), x.tolist()) for i, a, x in zip(self.ids, self.signs, self.vectors)]
        return small_table(spark, rows, f"id {id_type}, a int, x array<double>")


def support_scores(ids: list, signs: np.ndarray, vectors: np.ndarray, kernel: KernelMatrix) -> np.ndarray:
    """a_i · (ŷ(x_i) − a_i·K(x_i, x_i)): how well a support does without itself.

    Its own term is left out rather than subtracted again, so that equal
    supports tie exactly.
    """
    k = np.array(kernel(vectors, vectors), dtype=np.float64)
    np.fill_diagonal(k, 0.0)
    return signs * (k @ signs)


def worst_supports(model: PerceptronModel, spark: SparkSession, id_type: str = "bigint") -> DataFrame:
    """Every support with its score and whether it would be removed next."""
    values = support_scores(model.ids, model.signs, model.vectors, model.kernel)
    gone = _worst(model.ids, values)
    rows = [(i, int(a), float(v), i == gone) for i, a, v in zip(model.ids, model.signs, values)]
    return small_table(spark, rows, f"id {id_type}, a int, score double, worst boolean")


def _worst(ids: list, values: np.ndarray):
    return min(zip(-values, ids))[1]


def decision(vector: Column, model: PerceptronModel, collapse: bool | None = None) -> Column:
    """Σ a_i·K(x_i, x).  With the linear kernel the support collapses to one weight vector."""
    check_model_size(model.vectors.size, "support set")
    collapse = model.kernel is linear if collapse is None else collapse
    if collapse and model.kernel is not linear:
        raise ValueError("only the linear kernel collapses to a weight vector")
    signs, vectors, kernel = model.signs.astype(float), model.vectors, model.kernel
    if not len(signs):
        return F.lit(0.0)
    weights = signs @ vectors if collapse else None
    chunk = max(1, BLOCK_CELLS // len(signs))

    @F.arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        x = matrix_of(x)
        if not len(x):
            return pa.array([], pa.float64())
        if weights is not None:
            return pa.array(x @ weights)
        return pa.array(np.concatenate([kernel(x[i : i + chunk], vectors) @ signs for i in range(0, len(x), chunk)]))

    return score(vector)


def perceptron_fit(
    df: DataFrame,
    id_col: str,
    vector: str,
    sign: str,
    draws: int = 20_000,
    seed: int | str = 0,
    budget: int | None = None,
    beta: float = 0.0,
    kernel: KernelMatrix = linear,
    block: int = 512,
    width: int | None = None,
    in_order: bool = False,
) -> PerceptronModel:
    """Mistake-driven training on ``draws`` rows drawn with replacement, ``block`` of them a round.

    Without a budget a draw with y·ŷ <= 0 joins the support.  With a budget the
    margin is ``beta`` and the support is cut back to the budget after each
    round, or after each draw if they go ``in_order``; ``block`` then sets the
    draws of a job and leaves the result as it is.  A row that is in the support
    already, or drawn twice in a round, is there once.
    """
    margin = beta if budget is not None else 0.0
    whole = df.filter(F.col(id_col).isNotNull() & F.col(sign).isNotNull()).select(id_col, vector, sign)
    whole = usable_rows(whole, vector, width or vector_width(df, vector))
    number = F.floor(F.col("t") / block).cast("int")
    drawn = draw_with_replacement(whole, id_col, draws, seed, vector, sign).withColumn("_round", number)
    # Sorted by round, so that a round reads little more than its own draws.
    drawn = drawn.sortWithinPartitions("_round").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        support: dict = {}  # id -> (sign, vector)
        updates: list[tuple[int, int]] = []
        for r in range(-(-draws // block)):
            model = _model(support, kernel, updates)
            scored = drawn.filter(F.col("_round") == r).withColumn("_score", decision(F.col(vector), model))
            if in_order:
                for row in _one_by_one(scored, id_col, vector, sign, model, margin, budget).collect():  # at most one block
                    support[row["id"]] = (row["a"], np.array(row["x"], dtype=np.float64))
                    if row["gone"] is not None:
                        del support[row["gone"]]
                    updates.append((row["t"], len(support)))
                check_model_size(sum(len(x) for _, x in support.values()), "support set")
                continue
            mistakes = scored.filter(F.col(sign) * F.col("_score") <= margin).select(id_col, vector, sign).dropDuplicates([id_col])
            for row in mistakes.collect():  # at most one block, and nothing but mistakes
                support.setdefault(row[id_col], (int(row[sign]), np.array(row[vector], dtype=np.float64)))
            if budget is not None:
                _evict(support, kernel, budget)
            check_model_size(sum(len(x) for _, x in support.values()), "support set")
            updates.append((r, len(support)))
        return _model(support, kernel, updates)
    finally:
        drawn.unpersist()


def _model(support: dict, kernel: KernelMatrix, updates: list) -> PerceptronModel:
    ids = sorted(support)
    signs = np.array([support[i][0] for i in ids], dtype=np.int64)
    vectors = np.array([support[i][1] for i in ids]) if ids else np.zeros((0, 0))
    return PerceptronModel(ids, signs, vectors, kernel, list(updates))


def _one_by_one(
    scored: DataFrame, id_col: str, vector: str, sign: str, model: PerceptronModel, margin: float, budget: int | None
) -> DataFrame:
    """(t, id, a, x, gone): what joins the support, and what it puts out, draw by draw of one scored round."""
    kernel = model.kernel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        support = {i: (int(a), x) for i, a, x in zip(model.ids, model.signs, model.vectors)}
        changes: list[tuple[int, np.ndarray]] = []  # since the round was scored
        for batch in batches:
            if not batch.num_rows:
                continue
            t, ids, y = (batch.column(i).to_pylist() for i in (0, 1, 3))
            x, score = matrix_of(batch.column(2)), batch.column(4).to_numpy().copy()
            for a, moved in changes:
                score += a * kernel(x, moved[None])[:, 0]
            out: list[tuple] = []
            for p, row_id in enumerate(ids):
                if y[p] * score[p] > margin or row_id in support:
                    continue
                support[row_id] = (int(y[p]), x[p])
                changed, gone = [support[row_id]], None
                if budget is not None and len(support) > budget:
                    gone = _best_without(support, kernel)
                    a, moved = support.pop(gone)
                    changed.append((-a, moved))
                for a, moved in changed:
                    score += a * kernel(x, moved[None])[:, 0]
                changes += changed
                out.append((t[p], row_id, int(y[p]), x[p].tolist(), gone))
            if out:
                kinds = [pa.int64(), batch.column(1).type, pa.int32(), pa.list_(pa.float64()), batch.column(1).type]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["t", "id", "a", "x", "gone"]
                )

    kind = scored.schema[id_col].dataType.simpleString()
    one = scored.select("t", id_col, vector, sign, "_score").repartition(1).sortWithinPartitions("t")  # one round
    return one.mapInArrow(run, f"t bigint, id {kind}, a int, x array<double>, gone {kind}").orderBy("t")


def _best_without(support: dict, kernel: KernelMatrix):
    ids = sorted(support)
    signs = np.array([support[i][0] for i in ids], dtype=np.int64)
    return _worst(ids, support_scores(ids, signs, np.array([support[i][1] for i in ids]), kernel))


def _evict(support: dict, kernel: KernelMatrix, budget: int):
    """Cut the support back to the budget; the kernel matrix is worked out once for all removals."""
    ids = sorted(support)
    gone = len(ids) - budget
    if gone <= 0:
        return
    signs = np.array([support[i][0] for i in ids], dtype=np.float64)
    vectors = np.array([support[i][1] for i in ids])
    k = np.array(kernel(vectors, vectors), dtype=np.float64)
    np.fill_diagonal(k, 0.0)
    left = np.arange(len(ids))
    for _ in range(gone):
        values = signs[left] * (k[np.ix_(left, left)] @ signs[left])
        worst = int(np.argmax(values))  # the lowest id on ties
        del support[ids[left[worst]]]
        left = np.delete(left, worst)


def perceptron_predict(
    df: DataFrame, vector: str, model: PerceptronModel, output: str = "prediction", signed: bool = False
) -> DataFrame:
    """1 where the decision is positive, else 0 (or -1 with ``signed``)."""
    score = decision(F.col(vector), model)
    return df.withColumn(output, F.when(score > 0, F.lit(1)).otherwise(F.lit(-1 if signed else 0)))
