"""Wide vectors in Arrow batches, and the sums that bring them back together.

A task folds its own rows into a few partial rows with NumPy; Spark adds the
partial rows up.  What is shuffled is (tasks × model size), never the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cells of partial products that a task hands over at once (16 MB).
PARTIAL_CELLS = 2_000_000

ARROW_TYPES = {
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "array<double>": pa.list_(pa.float64()),
}


def matrix_of(column: pa.Array) -> np.ndarray:
    """Arrow list column to an n × d float64 matrix; rows must have one length."""
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("vector column holds nulls")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    width = len(flat) // n
    lengths = column.value_lengths().to_numpy()
    if (lengths != width).any():
        raise ValueError("vectors differ in length")
    return np.asarray(flat, dtype=np.float64).reshape(n, width)


def vector_array(matrix: np.ndarray) -> pa.Array:
    """n × d matrix to an Arrow list column."""
    n, d = matrix.shape
    offsets = pa.array(np.arange(n + 1, dtype=np.int32) * d)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, np.float64).reshape(-1)))


def vector_width(df: DataFrame, vector: str) -> int:
    row = df.filter(F.col(vector).isNotNull()).select(F.size(vector)).first()
    if row is None:
        raise ValueError("no rows")
    return row[0]


# Up to this width a test of all cells is a chain of plain conditions, which stays inside code generation.
NARROW_CELLS = 16


def usable_rows(df: DataFrame, vector: str, width: int, what: str = "vector") -> DataFrame:
    """Rows whose vector is not null and holds no null; one of another length than ``width`` fails the job."""
    v = F.col(vector)
    if width <= NARROW_CELLS:
        whole = _cells_known(v, width)
    else:
        whole = F.forall(v, lambda c: c.isNotNull())
    message = F.concat(F.lit(f"expected a {what} of {width} cells, got "), F.size(vector).cast("string"))
    sized = F.when(F.array_size(v) != width, F.raise_error(message).cast("boolean")).otherwise(whole)
    return df.filter(v.isNotNull() & sized)


def collect_vectors(df: DataFrame, vector: str) -> np.ndarray:
    """A small table's vector column as a matrix on the driver, through Arrow."""
    column = df.select(vector).toArrow().column(0)
    return matrix_of(column.combine_chunks() if column.num_chunks != 1 else column.chunk(0))


def _cells_known(v: Column, width: int) -> Column:
    return reduce(and_, [F.get(v, F.lit(i)).isNotNull() for i in range(width)], F.lit(True))


def when_whole(vector: Column, width: int, value: Column, what: str = "vector") -> Column:
    """``value`` where the vector and its cells are not null, else null; another length than ``width`` fails the job."""
    message = F.concat(F.lit(f"expected a {what} of {width} cells, got "), F.array_size(vector).cast("string"))
    failed = F.raise_error(message).cast("array<double>")
    return F.when(F.array_size(vector) != width, failed).when(_cells_known(vector, width), value)


def whole_rows(column: pa.Array, width: int, what: str = "vector") -> tuple[np.ndarray, np.ndarray]:
    """The rows of a list column without nulls as a matrix, and which rows they are; another length fails."""
    lengths = column.value_lengths().drop_null().to_numpy()
    if (lengths != width).any():
        raise ValueError(f"expected a {what} of {width} cells, got {lengths[lengths != width][0]}")
    known = column.is_valid().to_numpy(zero_copy_only=False).astype(bool)
    flat = column.flatten()
    if flat.null_count:
        holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width).any(axis=1)
        known[np.flatnonzero(known)[holes]] = False
        flat = flat.fill_null(0.0)
        rows = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)[~holes]
    else:
        rows = np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)
    return rows, known


def spread_rows(rows: pa.Array, known: np.ndarray) -> pa.Array:
    """Results of the known rows in their places, null in the others."""
    return rows.take(pa.array(np.cumsum(known) - 1, mask=~known))


def map_rows(vector: Column, width: int, fn: Callable[[np.ndarray], np.ndarray], what: str = "vector") -> Column:
    """``fn`` of the rows as a matrix, one batch at a time, by the rules of :func:`when_whole`."""

    @F.arrow_udf("array<double>")
    def mapped(x: pa.Array) -> pa.Array:
        rows, known = whole_rows(x, width, what)
        return spread_rows(vector_array(fn(rows)), known)

    return mapped(vector)


def linear_map(vector: Column, weights: np.ndarray, bias: np.ndarray | None = None) -> Column:
    """W·x (+ bias) for a wide vector, one matrix product per batch."""
    shift = 0.0 if bias is None else bias
    return map_rows(vector, weights.shape[1], lambda x: x @ weights.T + shift)


def squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """n × k squared distances, taken from the differences so that equal centres tie exactly."""
    out = np.empty((len(x), len(centres)))
    for k, c in enumerate(centres):
        diff = x - c
        out[:, k] = np.einsum("ij,ij->i", diff, diff)
    return out


def fold(df: DataFrame, step: Callable, finish: Callable[[object], Iterable[tuple]], schema: str) -> DataFrame:
    """Per-task fold: ``state = step(state, *columns)`` per batch, ``finish(state)`` gives the partial rows."""
    fields = [(name, ARROW_TYPES[kind]) for name, kind in (f.split() for f in schema.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            if batch.num_rows:
                state = step(state, *batch.columns)
        if state is not None:
            rows = list(finish(state))
            if rows:
                columns = [pa.array(list(c), kind) for c, (_, kind) in zip(zip(*rows), fields)]
                yield pa.RecordBatch.from_arrays(columns, names=[name for name, _ in fields])

    return df.mapInArrow(run, schema)


def _summed(vector: str) -> Column:
    return vector_to_array(Summarizer.sum(array_to_vector(F.col(vector)))).alias(vector)


def sum_vectors(
    df: DataFrame, keys: Sequence[str], vector: str, scalars: Sequence[str] = (), salt: int = 0
) -> DataFrame:
    """Element-wise sum of a vector column and plain sums of ``scalars`` per key.

    ``salt`` adds a first level of that many groups per key, for long vectors
    from very many tasks.
    """
    if salt:
        df = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salt)))
        df = df.groupBy(*keys, "_salt").agg(_summed(vector), *[F.sum(s).alias(s) for s in scalars])
    return df.groupBy(*keys).agg(_summed(vector), *[F.sum(s).alias(s) for s in scalars])


def group_codes(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct keys of a batch and the number of each row's key."""
    coded = column.dictionary_encode(null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy()


def gram(df: DataFrame, vector: str, key: str | None = None, salt: int = 32) -> DataFrame:
    """XᵀX of the rows of each key as a flat ``gram`` vector, with the row count ``n``.

    Partial products leave a task as they are made, a bounded number of cells
    at a time, so neither the number of keys nor the rows of a key are bounded.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix_of(batch.column(0))
            if key:
                distinct, code = group_codes(batch.column(1))
                x, counts = x[np.argsort(code, kind="stable")], np.bincount(code, minlength=len(distinct))
            else:
                distinct, counts = None, np.array([len(x)])
            ends = np.cumsum(counts)
            chunk = max(1, PARTIAL_CELLS // x.shape[1] ** 2)
            for first in range(0, len(counts), chunk):
                some = range(first, min(first + chunk, len(counts)))
                groups = [x[ends[g] - counts[g] : ends[g]] for g in some]
                products = np.array([(rows.T @ rows).reshape(-1) for rows in groups])
                lead = [] if distinct is None else [distinct.slice(first, len(some))]
                yield pa.RecordBatch.from_arrays(
                    [*lead, vector_array(products), pa.array([len(rows) for rows in groups], pa.int64())],
                    names=[*([key] if key else []), "gram", "n"],
                )

    keys = [key] if key else []
    lead = f"`{key}` {df.schema[key].dataType.simpleString()}, " if key else ""
    partials = df.select(vector, *keys).mapInArrow(partial, lead + "gram array<double>, n bigint")
    return sum_vectors(partials, keys, "gram", ["n"], salt)
