"""Cleaning and casting of dirty columns, as plain column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def blank_to_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Empty strings become null; whitespace is kept."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def require_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep rows where every listed column is neither null nor an empty string.

    One plain predicate per column, so that the filter reaches the file scan.
    """
    for c in cols:
        df = df.filter(F.col(c).isNotNull())
        if isinstance(df.schema[c].dataType, StringType):
            df = df.filter(F.col(c) != "")
    return df


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null in any of ``cols`` (all columns by default)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def cast_columns(df: DataFrame, cols: Sequence[str], to: str, strict: bool = False) -> DataFrame:
    """Cast in place.  Lenient: junk becomes null.  Strict: junk fails the job."""
    return df.withColumns({c: F.col(c).cast(to) if strict else F.col(c).try_cast(to) for c in cols})


def to_number(col: Column, default: float | None = 0.0) -> Column:
    """Text to double; what is not a number becomes ``default``.

    The JVM reads a trailing type suffix (``1d``, ``1f``) as part of a number,
    a data file does not.
    """
    suffix = F.lower(F.right(F.trim(col), F.lit(1))).isin("d", "f")
    number = F.when(~suffix, col.try_cast("double"))
    return number if default is None else F.coalesce(number, F.lit(float(default)))


def fill_null(df: DataFrame, value, cols: Sequence[str] | None = None) -> DataFrame:
    """Fill nulls in the columns whose type fits ``value``."""
    return df.na.fill(value, subset=list(cols) if cols else None)


def first_digits(col: Column) -> Column:
    """First run of digits as text, null when there is none; a sign is not part of it."""
    return F.regexp_substr(col, F.lit(r"\d+"))


def overwrite_above(col: Column, cap: float, value: float = 0) -> Column:
    """``value`` where the column is strictly greater than ``cap``; nulls stay null."""
    return F.when(col > cap, F.lit(value)).otherwise(col)


def bucket_by_cuts(col: Column, cuts: Sequence[float], boundary: str = "null") -> Column:
    """Class 1..len(cuts)+1 by ascending cuts.

    A value equal to a cut belongs to no class with ``boundary='null'`` and to
    the class above the cut with ``boundary='right'``.
    """
    if boundary not in ("null", "right"):
        raise ValueError("boundary is 'null' or 'right'")
    if list(cuts) != sorted(set(cuts)):
        raise ValueError("cuts must be strictly ascending")
    expr = F.when(col < cuts[0], F.lit(1))
    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:]), start=2):
        above = col > lo if boundary == "null" else col >= lo
        expr = expr.when(above & (col < hi), F.lit(k))
    above = col > cuts[-1] if boundary == "null" else col >= cuts[-1]
    return expr.when(above, F.lit(len(cuts) + 1))


def cycle(col: Column, n: int = 12) -> Column:
    """Position in an n-cycle: floored modulo, halves rounded to even."""
    rest = col % n
    return F.bround(F.when(rest < 0, rest + n).otherwise(rest), 0)
