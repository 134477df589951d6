"""Small dense networks trained by synchronous steps on hash-drawn batches.

A step is one job: every task adds up the gradients of its rows of the step's
batch, the sums meet in a tree of partial sums, and one optimizer step on the
driver gives the weights that leave with the next job.  Rows are dealt to the
batches of an epoch by a hash of (seed, id), so the result does not depend on
partitions, tasks or lost executors; the order of the batches changes with the
epoch.  Only sums and weights travel.

Rows with a null vector, target or cell take no part; any other length than
the network's fails.
"""

from __future__ import annotations

import math
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.functions import vectors as V
from tablemodels.operators.blocks import matrix_of, spread_rows, sum_vectors, usable_rows, vector_array, vector_width, whole_rows
from tablemodels.session import check_model_size, hash_uniform, small_table

# The usual optimizer constants.
RMSPROP_DECAY = 0.9
ADAM_DECAYS = (0.9, 0.999)
EPSILON = 1e-7

# A job a step: more batches an epoch than this are refused.
MAX_STEPS = 10_000
# Above so many tasks the partial gradients are added up in two levels.
TREE_TASKS = 16
# Modulus of the hash that draws dropped units; its square fits 63 bits.
DROP_MODULUS = 2**31 - 1


@dataclass
class Network:
    """ReLU layers with a linear (``'mse'``) or softmax (``'cross_entropy'``) output."""

    widths: list[int]  # input, hidden..., output
    loss: str
    params: np.ndarray  # all layers flat: kernel row-major, then bias

    @property
    def n_in(self) -> list[int]:
        """Width of each input vector."""
        return self.widths[:1]

    @property
    def n_out(self) -> int:
        return self.widths[-1]

    @property
    def dropped(self) -> list[int]:
        """Widths of the layers that dropout works on."""
        return self.widths[1:-1]

    def with_params(self, params: np.ndarray) -> Network:
        return replace(self, params=params)

    def penalised(self) -> np.ndarray:
        """1 at kernel cells, 0 at biases."""
        sizes = [(a * b, b) for a, b in zip(self.widths, self.widths[1:])]
        return np.concatenate([part for k, b in sizes for part in (np.ones(k), np.zeros(b))])

    def output(self, inputs: Sequence[np.ndarray]) -> np.ndarray:
        return _forward(self.layers(), self.loss, inputs[0])[-1]

    def gradient_sums(self, inputs: Sequence[np.ndarray], y: np.ndarray, masks=None) -> tuple[float, int, np.ndarray]:
        """Summed row losses, right answers and summed gradient, without the penalty."""
        layers = self.layers()
        acts = _forward(layers, self.loss, inputs[0], masks)
        loss, right, delta = _outcome(self.loss, acts[-1], y)
        return loss, right, _backward(layers, acts, delta, masks)[0]

    def layers(self) -> list[tuple[np.ndarray, np.ndarray]]:
        flat, out, at = self.params, [], 0
        for n_in, n_out in zip(self.widths, self.widths[1:]):
            kernel = flat[at : at + n_in * n_out].reshape(n_in, n_out)
            at += n_in * n_out
            out.append((kernel, flat[at : at + n_out]))
            at += n_out
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """Weights as rows (layer, i, j, value); a bias is row i = -1."""
        rows = []
        for layer, (kernel, bias) in enumerate(self.layers()):
            rows += [(layer, i, j, float(v)) for i, row in enumerate(kernel) for j, v in enumerate(row)]
            rows += [(layer, -1, j, float(v)) for j, v in enumerate(bias)]
        return spark.createDataFrame(rows, "layer int, i int, j int, value double")


@dataclass
class History:
    rows: list[tuple] = field(default_factory=list)
    seconds: float = 0.0

    def table(self, spark: SparkSession) -> DataFrame:
        return small_table(
            spark, self.rows,
            "model string, epoch int, loss double, accuracy double, val_loss double, val_accuracy double",
        )


def new_network(widths: Sequence[int], loss: str, seed: int = 0) -> Network:
    """Uniform start scaled by fan-in and fan-out, zero biases."""
    if loss not in ("mse", "cross_entropy"):
        raise ValueError("loss is 'mse' or 'cross_entropy'")
    rng = np.random.default_rng(seed)
    parts = []
    for n_in, n_out in zip(widths, widths[1:]):
        limit = np.sqrt(6.0 / (n_in + n_out))
        parts += [rng.uniform(-limit, limit, n_in * n_out), np.zeros(n_out)]
    params = np.concatenate(parts)
    check_model_size(params.size, "network")
    return Network(list(widths), loss, params)


def network_from_table(table: DataFrame, loss: str) -> Network:
    """A network back from its weight table."""
    n = table.count()
    check_model_size(n, "network")
    rows = table.collect()
    depth = max(r["layer"] for r in rows) + 1
    widths = [max(r["i"] for r in rows if r["layer"] == k) + 1 for k in range(depth)]
    widths.append(max(r["j"] for r in rows if r["layer"] == depth - 1) + 1)
    net = Network(widths, loss, np.zeros(n))
    layers = net.layers()
    for r in rows:
        kernel, bias = layers[r["layer"]]
        if r["i"] < 0:
            bias[r["j"]] = r["value"]
        else:
            kernel[r["i"], r["j"]] = r["value"]
    return net


def _forward(layers, loss: str, x: np.ndarray, masks=None) -> list[np.ndarray]:
    """Activations of every layer, the input first."""
    acts = [x]
    for k, (kernel, bias) in enumerate(layers):
        z = acts[-1] @ kernel + bias
        if k < len(layers) - 1:
            z = np.maximum(z, 0.0)
            if masks is not None:
                z = z * masks[k]
        elif loss == "cross_entropy":
            z = np.exp(z - z.max(axis=1, keepdims=True))
            z = z / z.sum(axis=1, keepdims=True)
        acts.append(z)
    return acts


def _row_losses(loss: str, out: np.ndarray, y: np.ndarray) -> np.ndarray:
    if loss == "mse":
        return ((out - y) ** 2).mean(axis=1)
    return -(y * np.log(np.clip(out, EPSILON, 1 - EPSILON))).sum(axis=1)


def _outcome(loss: str, out: np.ndarray, y: np.ndarray) -> tuple[float, int, np.ndarray]:
    """Summed row losses, right answers, and the loss's derivative by the last layer's sums."""
    value = float(_row_losses(loss, out, y).sum())
    if loss == "mse":
        return value, 0, 2.0 * (out - y) / y.shape[1]
    return value, int((out.argmax(axis=1) == y.argmax(axis=1)).sum()), out - y


def _backward(layers, acts, delta: np.ndarray, masks=None) -> tuple[np.ndarray, np.ndarray]:
    """Summed gradient of all layers, flat, and the derivative by the input."""
    grads = []
    for k in range(len(layers) - 1, -1, -1):
        grads += [delta.sum(axis=0), (acts[k].T @ delta).reshape(-1)]
        delta = delta @ layers[k][0].T
        if k:
            delta = delta * (acts[k] > 0)
            if masks is not None:
                delta = delta * masks[k - 1]
    return np.concatenate(grads[::-1]), delta


@dataclass
class Branches:
    """Networks side by side, one input vector each, under a head that reads their outputs; all are trained."""

    parts: list[Network]
    head: Network

    def __post_init__(self):
        if self.head.widths[0] != sum(p.n_out for p in self.parts):
            raise ValueError("the head must be as wide as its branches' outputs together")

    @property
    def loss(self) -> str:
        return self.head.loss

    @property
    def params(self) -> np.ndarray:
        return np.concatenate([*(p.params for p in self.parts), self.head.params])

    @property
    def n_in(self) -> list[int]:
        return [p.widths[0] for p in self.parts]

    @property
    def n_out(self) -> int:
        return self.head.n_out

    @property
    def dropped(self) -> list[int]:
        return self.head.dropped

    def with_params(self, params: np.ndarray) -> Branches:
        ends = np.cumsum([n.params.size for n in [*self.parts, self.head]])
        *parts, head = (n.with_params(params[e - n.params.size : e]) for n, e in zip([*self.parts, self.head], ends))
        return Branches(parts, head)

    def penalised(self) -> np.ndarray:
        return np.concatenate([n.penalised() for n in [*self.parts, self.head]])

    def output(self, inputs: Sequence[np.ndarray]) -> np.ndarray:
        return self.head.output([np.hstack([p.output([x]) for p, x in zip(self.parts, inputs)])])

    def gradient_sums(self, inputs: Sequence[np.ndarray], y: np.ndarray, masks=None) -> tuple[float, int, np.ndarray]:
        layers = [p.layers() for p in self.parts]
        acts = [_forward(own, p.loss, x) for own, p, x in zip(layers, self.parts, inputs)]
        top, out = self.head.layers(), np.hstack([a[-1] for a in acts])
        top_acts = _forward(top, self.head.loss, out, masks)
        loss, right, delta = _outcome(self.head.loss, top_acts[-1], y)
        top_grad, delta = _backward(top, top_acts, delta, masks)
        grads, at = [], 0
        for p, own, a in zip(self.parts, layers, acts):
            d, at = delta[:, at : at + p.n_out], at + p.n_out
            if p.loss == "cross_entropy":  # through the branch's softmax
                d = a[-1] * (d - (d * a[-1]).sum(axis=1, keepdims=True))
            grads.append(_backward(own, a, d)[0])
        return loss, right, np.concatenate([*grads, top_grad])


def _update(optimizer: str, rate: float, params, grad, slots: np.ndarray, step: int) -> np.ndarray:
    """One optimizer step; ``slots`` holds the running averages and is changed in place."""
    if optimizer == "rmsprop":
        slots[0] = RMSPROP_DECAY * slots[0] + (1 - RMSPROP_DECAY) * grad**2
        return params - rate * grad / np.sqrt(slots[0] + EPSILON)
    b1, b2 = ADAM_DECAYS
    slots[0] = b1 * slots[0] + (1 - b1) * grad
    slots[1] = b2 * slots[1] + (1 - b2) * grad**2
    rate = rate * np.sqrt(1 - b2**step) / (1 - b1**step)
    return params - rate * slots[0] / (np.sqrt(slots[1]) + EPSILON)


@dataclass
class TrainSpec:
    """``steps`` batches an epoch, or as many as make ``batch`` rows each on average."""

    epochs: int = 1
    steps: int = 8
    batch: int | None = None
    optimizer: str = "rmsprop"  # or 'adam'
    rate: float = 0.001
    l2: float = 0.0
    dropout: float = 0.0
    seed: int = 0

    def __post_init__(self):
        if self.optimizer not in ("rmsprop", "adam"):
            raise ValueError("optimizer is 'rmsprop' or 'adam'")
        if not 0 <= self.dropout < 1:
            raise ValueError("dropout is a share below 1")

    def steps_for(self, rows: int) -> int:
        steps = self.steps if self.batch is None else max(1, math.ceil(rows / self.batch))
        if not 0 < steps <= MAX_STEPS:
            raise ValueError(f"{steps} steps an epoch, one job each: choose at most {MAX_STEPS}")
        return steps


def batch_of(id_col: Column, seed: int, steps: int) -> Column:
    """Batch 0..steps-1 of a row."""
    return F.floor(hash_uniform(f"{seed}|batch", id_col) * steps).cast("int")


def batch_order(seed: int, epoch: int, steps: int) -> list[int]:
    """Order of the batches in an epoch."""
    return sorted(range(steps), key=lambda s: md5(f"{seed}|{epoch}|{s}".encode()).hexdigest())


def drop_key(id_col: Column, seed: int, step: int) -> Column:
    """28 bits of hash of (seed, step, id), from which a row's dropped units follow."""
    text = F.concat_ws("|", F.lit(f"{seed}|drop|{step}"), id_col.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def drop_masks(keys: np.ndarray, widths: Sequence[int], dropout: float) -> list[np.ndarray]:
    """Per layer: 1 / keep for kept units, 0 for dropped ones."""
    keep, out = 1.0 - dropout, []
    for layer, width in enumerate(widths):
        unit = (layer + 1) * 40_503 + np.arange(1, width + 1, dtype=np.int64) * 1_327_217 % DROP_MODULUS
        h = (keys[:, None] + unit) * 48_271 % DROP_MODULUS
        h = (h * h + 12_345) % DROP_MODULUS * 16_807 % DROP_MODULUS
        out.append((h < keep * DROP_MODULUS) / keep)
    return out


def _gradient_job(rows: DataFrame, inputs: Sequence[str], target: str, net, dropout: float, key: Column) -> DataFrame:
    """One row: summed gradient, rows, summed loss and right answers of the given rows."""
    chosen = rows.select(*inputs, target, *([key.alias("_key")] if dropout else []))
    width = len(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, right, grad = 0, 0.0, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = [matrix_of(c) for c in batch.columns[:width]], matrix_of(batch.column(width))
            masks = None
            if dropout:
                masks = drop_masks(batch.column(width + 1).to_numpy(), net.dropped, dropout)
            value, hits, sums = net.gradient_sums(x, y, masks)
            n, loss, right, grad = n + len(y), loss + value, right + hits, grad + sums
        if n or not TaskContext.get().partitionId():  # a batch without rows still has a sum
            grad = grad if n else np.zeros(net.params.size)
            yield pa.RecordBatch.from_arrays(
                [vector_array(grad[None]), pa.array([n]), pa.array([loss]), pa.array([right])], names=["grad", "n", "loss", "right"]
            )

    return chosen.mapInArrow(run, "grad array<double>, n bigint, loss double, right bigint")


def _tree(partials: DataFrame) -> DataFrame:
    tasks = partials.sparkSession.sparkContext.defaultParallelism
    return sum_vectors(partials, [], "grad", ["n", "loss", "right"], math.isqrt(tasks) if tasks > TREE_TASKS else 0)


def train(
    df: DataFrame,
    id_col: str,
    vector: str | Sequence[str],
    target: str,
    net: Network | Branches,
    spec: TrainSpec,
    validation: DataFrame | None = None,
    name: str = "model",
    storage: StorageLevel = StorageLevel.MEMORY_AND_DISK,
) -> tuple[Network | Branches, History]:
    """Train on (vector, target) rows; the result depends on the rows, their ids and the seed only.

    ``vector`` names one column, or one per branch.  Rows are kept sorted by
    batch, so that a step reads little more than its own.  A batch without rows
    is no step.  History: loss and accuracy of an epoch are taken at the weights
    each batch met, validation at the epoch's end.
    """
    began = time.monotonic()
    inputs = [vector] if isinstance(vector, str) else list(vector)
    whole = df.filter(F.col(target).isNotNull()).select(id_col, *inputs, target)
    for column, width in [*zip(inputs, net.n_in), (target, net.n_out)]:
        whole = usable_rows(whole, column, width, column)
    steps = spec.steps_for(whole.count() if spec.batch is not None else 0)
    rows = whole.withColumn("_batch", batch_of(F.col(id_col), spec.seed, steps)).sortWithinPartitions("_batch").persist(storage)
    held_out = None if validation is None else validation.select(*inputs, target).persist(storage)
    slots, penalised = np.zeros((1 if spec.optimizer == "rmsprop" else 2, net.params.size)), net.penalised()
    history, done = History(), 0
    try:
        if rows.isEmpty():
            raise ValueError("no rows to train on")
        for epoch in range(1, spec.epochs + 1):
            n = loss = right = 0
            for batch in batch_order(spec.seed, epoch, steps):
                key = drop_key(F.col(id_col), spec.seed, done + 1)
                partials = _gradient_job(rows.filter(F.col("_batch") == batch), inputs, target, net, spec.dropout, key)
                got = _tree(partials).toArrow()  # one row
                size = got.column("n")[0].as_py()
                if not size:
                    continue
                done += 1
                params = net.params
                grad = matrix_of(got.column("grad").combine_chunks())[0] / size + 2 * spec.l2 * penalised * params
                n, right = n + size, right + got.column("right")[0].as_py()
                loss += got.column("loss")[0].as_py() + size * spec.l2 * float((penalised * params**2).sum())
                net = net.with_params(_update(spec.optimizer, spec.rate, params, grad, slots, done))
            val = (None, None)
            if held_out is not None:
                val = tuple(evaluate(held_out, inputs, target, net, spec.l2).first())
            history.rows.append((name, epoch, loss / n, right / n if net.loss == "cross_entropy" else None, *val))
    finally:
        rows.unpersist()
        if held_out is not None:
            held_out.unpersist()
    history.seconds = time.monotonic() - began
    return net, history


def forward(vector: Column | Sequence[Column], net: Network | Branches) -> Column:
    """Network output for every row as a vector; one input column per branch.

    Null where an input is null or holds a null; another length fails.
    """
    inputs = [vector] if isinstance(vector, Column) else list(vector)

    @F.arrow_udf("array<double>")
    def score(*columns: pa.Array) -> pa.Array:
        parts = [whole_rows(c, w) for c, w in zip(columns, net.n_in)]
        known = np.logical_and.reduce([k for _, k in parts])
        return spread_rows(vector_array(net.output([x[known[k]] for x, k in parts])), known)

    return score(*inputs)


def evaluate(
    df: DataFrame, vector: str | Sequence[str], target: str, net: Network | Branches, l2: float = 0.0
) -> DataFrame:
    """One row (loss, accuracy); accuracy is null for a regression."""
    inputs = [vector] if isinstance(vector, str) else list(vector)
    out, y = F.col("_out"), F.col(target)
    scored = df.select(forward([F.col(c) for c in inputs], net).alias("_out"), target)
    if net.loss == "mse":
        row_loss = V.squared_distance(out, y) / F.size(y)
        accuracy = F.lit(None).cast("double")
    else:
        inside = F.transform(out, lambda p: F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), p)))
        row_loss = -V.dot(y, F.transform(inside, F.ln))
        accuracy = F.avg(F.when(V.first_argmax(out) == V.first_argmax(y), 1.0).otherwise(0.0))
    penalty = l2 * float((net.penalised() * net.params**2).sum())
    return scored.agg((F.avg(row_loss) + F.lit(penalty)).alias("loss"), accuracy.alias("accuracy"))


def sweep(
    df: DataFrame, id_col: str, vector: str, target: str, loss: str, variants: dict[str, tuple[list[int], TrainSpec]],
    validation: DataFrame | None = None,
) -> DataFrame:
    """Train one network per variant (hidden widths, spec) on the same rows; one history table for all."""
    both = History()
    shared = [None if f is None else f.select(id_col, vector, target).persist() for f in (df, validation)]
    try:
        n_in, n_out = vector_width(shared[0], vector), vector_width(shared[0], target)
        for name, (hidden, spec) in variants.items():
            net = new_network([n_in, *hidden, n_out], loss, spec.seed)
            _, history = train(shared[0], id_col, vector, target, net, spec, shared[1], name)
            both.rows += history.rows
    finally:
        for frame in shared:
            if frame is not None:
                frame.unpersist()
    return both.table(df.sparkSession)


def compare_models(history: DataFrame, metric: str, models: Sequence[str]) -> DataFrame:
    """One row per epoch and one column per model."""
    return history.groupBy("epoch").pivot("model", list(models)).agg(F.first(metric))
