"""L2-penalised softmax regression on full batches: one job per step, weights on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.functions import vectors as V
from tablemodels.operators.blocks import (
    collect_vectors, fold, linear_map, matrix_of, sum_vectors, usable_rows, vector_width, when_whole,
)
from tablemodels.session import check_model_size, small_table

# Weights up to which a step takes the Hessian (weights squared); beyond it steps come from gradients.
MAX_NEWTON_WEIGHTS = 1_000
# Pairs of moves and gradient changes that stand for the Hessian then.
REMEMBERED_MOVES = 10
# Sums that one aggregate row may hold.
MAX_EXPRESSION_SUMS = 96
# Weights up to which scores are plain column expressions.
EXPRESSION_TERMS = 64


@dataclass
class SoftmaxModel:
    weights: np.ndarray  # C × (d + 1), bias last
    history: list[tuple[int, float, float]] = field(default_factory=list)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, j, float(v)) for c, row in enumerate(self.weights) for j, v in enumerate(row)]
        return spark.createDataFrame(rows, "label int, feature int, weight double")

    def history_table(self, spark: SparkSession) -> DataFrame:
        return small_table(spark, self.history, "step int, loss double, gradient_norm double")


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def loss_and_gradient(
    df: DataFrame, vector: str, label: str, weights: np.ndarray, lam: float, hessian: bool = False
):
    """Σ cross-entropy + λ‖W‖² with its gradient (and Hessian) at ``weights``, bias penalised too.

    One job.  A small model is summed by plain aggregates, a larger one by
    NumPy partial sums per task.  Rows with a null label, vector or cell take
    no part; another length, or a label other than 0..C-1, fails the job.
    """
    c, d = weights.shape
    y = F.col(label).cast("double")
    message = F.concat(F.lit(f"expected a label from 0 to {c - 1}, got "), F.col(label).cast("string"))
    known = F.when((y >= 0) & (y < c) & (y == F.floor(y)), y.cast("int")).otherwise(F.raise_error(message))
    df = usable_rows(df.filter(F.col(label).isNotNull()).select(vector, label), vector, d - 1).withColumn(label, known)
    sums = 1 + c * d + (c * (c + 1) // 2 * d * (d + 1) // 2 if hessian else 0)
    part = _expression_sums if sums <= MAX_EXPRESSION_SUMS else _block_sums
    loss, grad, hess = part(df, vector, label, weights, hessian)
    loss = loss + lam * (weights**2).sum()
    grad = grad + 2 * lam * weights
    if not hessian:
        return loss, grad
    return loss, grad, hess.reshape(weights.size, weights.size) + 2 * lam * np.eye(weights.size)


def _expression_sums(df: DataFrame, vector: str, label: str, weights: np.ndarray, hessian: bool):
    """Every sum an aggregate column; scores, exponentials and probabilities are worked out once a row."""
    c, d = weights.shape
    classes, x = range(c), [*(f"x{j}" for j in range(d - 1)), "1D"]
    rows = df.select(F.col(label).alias("y"), *[F.col(vector)[j].cast("double").alias(f"x{j}") for j in range(d - 1)])
    rows = rows.selectExpr("*", *[" + ".join(f"{float(w)!r}D * {v}" for w, v in zip(weights[k], x)) + f" AS z{k}" for k in classes])
    rows = rows.selectExpr("*", (f"greatest({', '.join(f'z{k}' for k in classes)})" if c > 1 else "z0") + " AS top")
    rows = rows.selectExpr("*", *[f"exp(z{k} - top) AS e{k}" for k in classes])
    rows = rows.selectExpr("*", " + ".join(f"e{k}" for k in classes) + " AS s")
    rows = rows.selectExpr("*", *[f"e{k} / s AS p{k}" for k in classes])

    own = " ".join(f"WHEN {k} THEN z{k}" for k in classes)
    cells = []
    if hessian:
        cells = [(a, b, i, j) for a in classes for b in range(a, c) for i in range(d) for j in range(i, d)]
    total = rows.selectExpr(
        f"sum(top + ln(s) - CASE y {own} END)",
        *[f"sum((p{k} - if(y = {k}, 1D, 0D)) * {v})" for k in classes for v in x],
        *[f"sum(p{a} * ({'1D' if a == b else '0D'} - p{b}) * {x[i]} * {x[j]})" for a, b, i, j in cells],
    ).first()
    values = [v or 0.0 for v in total]
    grad = np.array(values[1 : 1 + c * d]).reshape(c, d)
    hess = np.zeros((c, d, c, d))
    for (a, b, i, j), v in zip(cells, values[1 + c * d :]):
        hess[a, i, b, j] = hess[a, j, b, i] = hess[b, i, a, j] = hess[b, j, a, i] = v
    return values[0], grad, hess


def _block_sums(df: DataFrame, vector: str, label: str, weights: np.ndarray, hessian: bool):
    """The same sums folded per task in Arrow batches."""
    check_model_size(weights.size ** (2 if hessian else 1), "softmax partial sums")
    n_classes, width = weights.shape
    size = weights.size

    def step(state, x, y):
        x = matrix_of(x)
        x = np.hstack([x, np.ones((len(x), 1))])
        y = y.to_numpy().astype(int)
        logp = _log_softmax(x @ weights.T)
        p = np.exp(logp)
        diff = p.copy()
        diff[np.arange(len(y)), y] -= 1.0
        parts = [[-logp[np.arange(len(y)), y].sum()], (diff.T @ x).reshape(-1)]
        if hessian:
            h = np.zeros((n_classes, width, n_classes, width))
            for a in range(n_classes):
                for b in range(a, n_classes):
                    w = p[:, a] * ((a == b) - p[:, b])
                    h[a, :, b, :] = h[b, :, a, :] = (x * w[:, None]).T @ x
            parts.append(h.reshape(-1))
        part = np.concatenate(parts)
        return part if state is None else state + part

    partials = fold(df.select(vector, label), step, lambda s: [(s,)], "part array<double>")
    total = collect_vectors(sum_vectors(partials, [], "part", salt=32 if hessian else 0), "part")[0]
    return total[0], total[1 : 1 + size].reshape(weights.shape), total[1 + size :]


def softmax_fit(
    df: DataFrame,
    vector: str,
    label: str,
    n_classes: int | None = None,
    lam: float = 0.1,
    eta: float = 1e-4,
    solver: str = "newton",
    max_steps: int = 100_000,
    tol: float = 1e-6,
    check_every: int = 10_000,
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
) -> SoftmaxModel:
    """Minimise the penalised loss from zero weights.

    ``'gd'`` takes steps of size ``eta`` and tests the gradient norm against
    ``tol`` every ``check_every`` steps.  ``'newton'`` reaches the same unique
    minimum in about ten jobs, halving a step that does not lower the loss.
    Models too wide for a Hessian reach it by limited-memory steps (L-BFGS) on
    the gradients alone, whose partial sums are as long as the weights.
    """
    if solver not in ("gd", "newton"):
        raise ValueError("solver is 'gd' or 'newton'")
    data = df.select(vector, label)
    if storage:
        data = data.persist(storage)
    try:
        if n_classes is None:
            n_classes = int(data.agg(F.max(label)).first()[0]) + 1
        weights = np.zeros((n_classes, vector_width(data, vector) + 1))
        if solver == "gd":
            return _gradient_descent(data, vector, label, weights, lam, eta, max_steps, tol, check_every)
        steps = _newton if weights.size <= MAX_NEWTON_WEIGHTS else _limited_memory
        return steps(data, vector, label, weights, lam, max_steps, tol)
    finally:
        if storage:
            data.unpersist()


def _gradient_descent(data, vector, label, weights, lam, eta, max_steps, tol, check_every) -> SoftmaxModel:
    history = []
    for step in range(1, max_steps + 1):
        loss, grad = loss_and_gradient(data, vector, label, weights, lam)
        norm = float(np.linalg.norm(grad))
        history.append((step, float(loss), norm))
        weights = weights - eta * grad
        if step % check_every == 0 and norm < tol:
            break
    return SoftmaxModel(weights, history)


def _newton(data, vector, label, weights, lam, max_steps, tol) -> SoftmaxModel:
    history = []
    accepted, move = None, None
    for step in range(1, max_steps + 1):
        trial = weights if move is None else weights + move
        loss, grad, hess = loss_and_gradient(data, vector, label, trial, lam, hessian=True)
        norm = float(np.linalg.norm(grad))
        history.append((step, float(loss), norm))
        if accepted is not None and loss > accepted + 1e-12 * abs(accepted) and norm >= tol:
            move = move / 2
            continue
        weights, accepted = trial, loss
        if norm < tol:
            break
        move = -np.linalg.solve(hess, grad.reshape(-1)).reshape(weights.shape)
    return SoftmaxModel(weights, history)


def _limited_memory(data, vector, label, weights, lam, max_steps, tol) -> SoftmaxModel:
    """One history row per job; ends early when no step along the move lowers the loss any more."""
    loss, grad = loss_and_gradient(data, vector, label, weights, lam)
    norm = float(np.linalg.norm(grad))
    history, moves = [(1, float(loss), norm)], []
    while norm >= tol:
        move = -_inverse_hessian_times(grad, moves)
        slope, rate = float((grad * move).sum()), 1.0 if moves else min(1.0, 1.0 / norm)
        while True:
            if len(history) >= max_steps or rate < 1e-12:
                return SoftmaxModel(weights, history)
            trial = weights + rate * move
            trial_loss, trial_grad = loss_and_gradient(data, vector, label, trial, lam)
            history.append((len(history) + 1, float(trial_loss), float(np.linalg.norm(trial_grad))))
            if trial_loss <= loss + 1e-4 * rate * slope:
                break
            rate /= 2
        step, change = trial - weights, trial_grad - grad
        if (step * change).sum() > 0:
            moves = [*moves, (step, change)][-REMEMBERED_MOVES:]
        weights, loss, grad, norm = trial, trial_loss, trial_grad, history[-1][2]
    return SoftmaxModel(weights, history)


def _inverse_hessian_times(grad: np.ndarray, moves: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The inverse Hessian that the remembered moves suggest, times the gradient (two passes over the moves)."""
    out, shares = grad.copy(), []
    for step, change in reversed(moves):
        share = (step * out).sum() / (step * change).sum()
        out -= share * change
        shares.append(share)
    if moves:
        step, change = moves[-1]
        out *= (step * change).sum() / (change**2).sum()
    for (step, change), share in zip(moves, reversed(shares)):
        out += (share - (change * out).sum() / (step * change).sum()) * step
    return out


def _score_terms(x: list[Column], weights: np.ndarray) -> list[Column]:
    rows = [[float(v) for v in row] for row in weights]
    return [sum((xj * w for xj, w in zip(x, row)), F.lit(0.0)) + F.lit(row[-1]) for row in rows]


def class_scores(vector: Column, weights: np.ndarray) -> Column:
    """W·(x, 1) for every class; null for a vector that is null or holds a null, another length fails."""
    check_model_size(weights.size, "softmax weights")
    if weights.size <= EXPRESSION_TERMS:
        width = weights.shape[1] - 1
        return when_whole(vector, width, F.array(*_score_terms([vector[j] for j in range(width)], weights)))
    return linear_map(vector, weights[:, :-1], weights[:, -1])


def softmax_predict(df: DataFrame, vector: str, model: SoftmaxModel, output: str = "prediction") -> DataFrame:
    """Adds the class of the highest score, the lowest class on ties."""
    scored = df.withColumn("_scores", class_scores(F.col(vector), model.weights))
    return scored.withColumn(output, V.first_argmax(F.col("_scores"))).drop("_scores")
