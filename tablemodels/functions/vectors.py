"""Dense vectors held as ``array<double>``: building, reshaping, arithmetic.

The expressions here run in the JVM and suit narrow vectors.  Work on wide
vectors goes through ``tablemodels.operators.blocks`` in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tablemodels.operators.blocks import linear_map, when_whole

# Products up to which a constant matrix is written out as an expression.
EXPRESSION_TERMS = 64

Kernel = Callable[[Column, Column], Column]


def as_vector(col: Column) -> Column:
    return col.cast("array<double>")


def literal_vector(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values])


def assemble(*cols: str | Column) -> Column:
    """Scalar columns to one vector, in the order given."""
    return F.array(*[(F.col(c) if isinstance(c, str) else c).cast("double") for c in cols])


def concat_blocks(*blocks: Column) -> Column:
    """Vectors side by side; wrap scalars with :func:`assemble`."""
    return F.concat(*blocks)


def append_bias(x: Column) -> Column:
    return F.array_append(x, F.lit(1.0))


def prepend_bias(x: Column) -> Column:
    return F.concat(F.array(F.lit(1.0)), x)


def polynomial_basis(x: Column, degree: int) -> Column:
    """1, x, x², … x^degree."""
    return F.array(F.lit(1.0), *[F.pow(x.cast("double"), F.lit(float(j))) for j in range(1, degree + 1)])


def sine_basis(x: Column, terms: int) -> Column:
    """1, sin(x), sin(x/2), … sin(x/terms)."""
    return F.array(F.lit(1.0), *[F.sin(x.cast("double") / F.lit(float(j))) for j in range(1, terms + 1)])


def flatten_matrix(m: Column) -> Column:
    """Row-major flattening of ``array<array<double>>``."""
    return F.flatten(m)


def reshape(x: Column, rows: int, cols: int) -> Column:
    """Vector to a rows × cols matrix, row-major; any other length fails the job."""
    cells = F.array(*[F.slice(x, r * cols + 1, cols) for r in range(rows)])
    message = F.concat(F.lit(f"cannot reshape to {rows}x{cols} a vector of length "), F.size(x).cast("string"))
    return F.when(F.size(x) == rows * cols, cells).otherwise(F.raise_error(message))


def slice_vector(x: Column, start: int, length: int) -> Column:
    """``length`` elements from 0-based ``start``."""
    return F.slice(x, start + 1, length)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p + q)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p - q)


def multiply(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: p * q)


def scale(x: Column, factor: float | Column) -> Column:
    return F.transform(x, lambda v: v * factor)


def power(x: Column, exponent: float) -> Column:
    return F.transform(x, lambda v: F.pow(v, F.lit(float(exponent))))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return total(multiply(a, b))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)))


def mat_vec(weights: Sequence[Sequence[float]], x: Column) -> Column:
    """Product of a constant matrix with a vector column: term by term when small, else in Arrow batches.

    Null for a vector that is null or holds a null; another length fails.
    """
    if len(weights) * len(weights[0]) > EXPRESSION_TERMS:
        return linear_map(x, np.array(weights, dtype=np.float64))
    terms = F.array(*[sum((x[j] * float(w) for j, w in enumerate(row)), F.lit(0.0)) for row in weights])
    return when_whole(x, len(weights[0]), terms)


def linear_kernel(a: Column, b: Column) -> Column:
    return dot(a, b)


def _minus(x: Column, scalar: Column) -> Column:
    # The scalar is repeated beside x: inside a lambda it would be worked out per element.
    return F.zip_with(x, F.array_repeat(scalar, F.size(x)), lambda v, s: v - s)


def log_sum_exp(x: Column) -> Column:
    """log Σ exp(x_i), shifted by the largest element so that it cannot overflow."""
    top = F.array_max(x)
    return top + F.log(F.aggregate(_minus(x, top), F.lit(0.0), lambda acc, v: acc + F.exp(v)))


def log_softmax(x: Column, lse: Column | None = None) -> Column:
    """x − log Σ exp(x); pass ``lse`` when it is a column already."""
    return _minus(x, log_sum_exp(x) if lse is None else lse)


def softmax(x: Column) -> Column:
    return F.transform(log_softmax(x), F.exp)


def first_argmax(x: Column) -> Column:
    """0-based position of the largest element, the lowest one on ties."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def first_argmin(x: Column) -> Column:
    return (F.array_position(x, F.array_min(x)) - 1).cast("int")


def clip_to_byte(x: Column) -> Column:
    """Clip to 0..255 and drop the fraction."""
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)).cast("int"))


def one_hot(index: Column, n: int) -> Column:
    """Dense 0/1 vector of length n, no category dropped; an index outside 0..n-1 fails the job."""
    i = index.cast("int")
    zero = F.lit(0.0)
    hot = F.concat(F.array_repeat(zero, i), F.array(F.lit(1.0)), F.array_repeat(zero, F.lit(n - 1) - i))
    message = F.concat(F.lit(f"index outside 0..{n - 1}: "), i.cast("string"))
    return F.when((i >= 0) & (i < n), hot).when(i.isNotNull(), F.raise_error(message))


def rescale(x: Column, n_min: float, n_max: float, o_min: float, o_max: float) -> Column:
    """Linear map of the fixed range o_min..o_max onto n_min..n_max, without clipping."""
    factor = (n_max - n_min) / (o_max - o_min)
    return F.transform(x, lambda v: (v - F.lit(float(o_min))) * F.lit(factor) + F.lit(float(n_min)))
