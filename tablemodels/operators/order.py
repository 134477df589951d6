"""Order statistics, percentiles, prefix splits and row ranges without a global window.

Ranks are found by counting: each pass counts the values that can still hold a
wanted rank by cells and keeps only the cell that does, so no task ever sees a
whole column and a split by rank becomes a plain filter on the id.  Numbers are
cut into equal ranges between their bounds; dates and timestamps count as whole
numbers; strings and bytes go by the next bytes after what all values of the
cell share.  Several columns go through the same jobs.

Null and NaN have no rank and are left out.
"""

from __future__ import annotations

import datetime as dt
import itertools
import math
import os.path
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemodels.session import scratch_dir, small_table

# Below this many rows the built-in exact percentile (one value map in one task) is as cheap.
SMALL_ROWS = 50_000
BINS = 4096
# Cells that one pass may bring back, over all brackets.
MAX_CELLS = 1_000_000
# Bytes looked ahead for what the strings of a cell share.
AHEAD = 64
EPOCH = dt.datetime(1970, 1, 1)
# Bits that Spark's increasing row numbers keep for the place inside a partition.
PLACE_BITS = 33


@dataclass
class _Key:
    """What a column is ranked by: whole numbers, doubles or bytes."""

    column: Column
    kind: str  # 'long', 'double' or 'bytes'
    value: Callable  # key -> value of the column's type
    literal: Callable  # key -> literal column to compare with


def _key(df: DataFrame, col: str) -> _Key:
    c, kind = F.col(col), df.schema[col].dataType
    if isinstance(kind, T.IntegralType):
        return _Key(c, "long", int, F.lit)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return _Key(F.when(~F.isnan(c), c), "double", float, F.lit)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        value = lambda k: Decimal(k).scaleb(-kind.scale)
        return _Key((c * F.lit(10**kind.scale)).cast("long"), "long", value, lambda k: F.lit(value(k)))
    if isinstance(kind, T.BooleanType):
        return _Key(c.cast("int"), "long", bool, lambda k: F.lit(bool(k)))
    if isinstance(kind, T.DateType):
        value = lambda k: EPOCH.date() + dt.timedelta(days=k)
        return _Key(F.unix_date(c), "long", value, lambda k: F.lit(value(k)))
    if isinstance(kind, T.TimestampType):
        value = lambda k: EPOCH.replace(tzinfo=dt.timezone.utc) + dt.timedelta(microseconds=k)
        return _Key(F.unix_micros(c), "long", value, lambda k: F.timestamp_micros(F.lit(k)))
    if isinstance(kind, T.TimestampNTZType):
        value = lambda k: EPOCH + dt.timedelta(microseconds=k)
        moment = lambda v: F.lit(v.isoformat(" ")).cast("timestamp_ntz")  # noqa: E731 - as text, which has no zone
        return _Key(F.timestamp_diff("MICROSECOND", moment(EPOCH), c), "long", value, lambda k: moment(value(k)))
    if isinstance(kind, T.StringType):
        return _Key(c.cast("binary"), "bytes", lambda k: k.decode(), lambda k: F.lit(k.decode()))
    if isinstance(kind, T.BinaryType):
        return _Key(c, "bytes", bytes, F.lit)
    raise TypeError(f"{col} is {kind.simpleString()}, which has no ranks here")


def _bin_of(x: Column, lo, hi, integral: bool, bins: int) -> Column:
    if integral:
        if hi - lo >= 2**63:  # the difference does not fit: go by halves
            step = ((hi >> 1) - (lo >> 1)) // bins + 1
            return F.floor((F.shiftright(x.cast("long"), 1) - F.lit(lo >> 1)) / F.lit(step)).cast("int")
        step = (hi - lo) // bins + 1
        return F.floor((x - F.lit(lo)) / F.lit(step)).cast("int")
    if math.isinf(lo) or math.isinf(hi):  # infinities are bins of their own, what is finite follows in the next pass
        return F.when(x == float("-inf"), 0).when(x == float("inf"), 2).otherwise(1)
    if math.isinf(hi - lo):
        share = (x / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2)
    else:
        share = (x - F.lit(lo)) / F.lit(hi - lo)
    return F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")


@dataclass
class _Bracket:
    """Rows that can still hold some ranks: numbers from ``lo`` to ``hi``, or bytes that start with ``lo``."""

    lo: object
    hi: object
    below: int  # rows under the bracket
    ranks: list[int]


def _bounds(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple]:
    """Per column: rows that have a rank, and the least and greatest key of numbers."""
    keys = {c: _key(df, c) for c in cols}
    ends = {c: [F.lit(None)] * 2 if k.kind == "bytes" else [F.min(k.column), F.max(k.column)] for c, k in keys.items()}
    row = df.agg(*[a for c, k in keys.items() for a in (F.count(k.column), *ends[c])]).first()
    return {c: tuple(row[3 * i : 3 * i + 3]) for i, c in enumerate(cols)}


def _cells(key: _Key, brackets: Sequence[_Bracket], bins: int) -> tuple[Column, Column, Column, Column | None]:
    """Bracket number, cell, what the least and greatest are taken of, and the range that all brackets lie in."""
    x, which, cell, kept = key.column, None, None, key.column
    if key.kind == "bytes":
        ahead = None
        for b, k in enumerate(brackets):
            at = len(k.lo)
            inside = F.substring(x, 1, at) == F.lit(k.lo)
            mine, rest = F.substring(x, at + 1, 2 if bins > 256 else 1), F.substring(x, at + 1, AHEAD)
            which = F.when(inside, b) if which is None else which.when(inside, b)
            cell = F.when(inside, mine) if cell is None else cell.when(inside, mine)
            ahead = F.when(inside, rest) if ahead is None else ahead.when(inside, rest)
        return which, cell, ahead, None
    for b, k in enumerate(brackets):
        inside, pos = x.between(k.lo, k.hi), _bin_of(x, k.lo, k.hi, key.kind == "long", bins)
        which = F.when(inside, b) if which is None else which.when(inside, b)
        cell = F.when(inside, pos) if cell is None else cell.when(inside, pos)
    # One range predicate, which can reach the scan; a predicate per bracket
    # would have a computed column worked out once for each of them.
    return which, cell, kept, x.between(min(k.lo for k in brackets), max(k.hi for k in brackets))


def _count(df: DataFrame, keys: Mapping[str, _Key], pending: Mapping[str, list[_Bracket]], bins: int) -> dict[str, list]:
    """(bracket, cell, rows, least, greatest) per column, in cell order: one job for all columns."""
    fields = {"long": ("i", "l"), "double": ("i", "d"), "bytes": ("s", "t")}
    types = {"i": "int", "s": "binary", "l": "bigint", "d": "double", "t": "binary"}
    used = sorted({f for c in pending for f in fields[keys[c].kind]})
    columns, reach = [], []
    for number, (c, brackets) in enumerate(pending.items()):
        which, cell, kept, inside = _cells(keys[c], brackets, bins)
        own = dict(zip(fields[keys[c].kind], (cell, kept)))
        columns.append(F.struct(
            F.lit(number).alias("c"), which.alias("b"), *[own.get(f, F.lit(None)).cast(types[f]).alias(f) for f in used]
        ))
        reach.append(inside)
    if len(columns) == 1:
        rows = (df if reach[0] is None else df.filter(reach[0])).select(columns[0].alias("r")).select("r.*")
    else:
        rows = df.select(F.inline(F.array(*columns)))
    ends = [f(v).alias(f"{n}{v}") for v in used if v in "ldt" for n, f in (("lo", F.min), ("hi", F.max))]
    cells = [f for f in used if f in "is"]
    found = rows.filter("b IS NOT NULL").groupBy("c", "b", *cells).agg(F.count("*").alias("n"), *ends).collect()  # MAX_CELLS
    out: dict[str, list] = {}
    for number, c in enumerate(pending):
        cell, end = fields[keys[c].kind]
        plain = bytes if keys[c].kind == "bytes" else lambda v: v
        out[c] = sorted(
            ((r["b"], plain(r[cell]), r["n"], plain(r[f"lo{end}"]), plain(r[f"hi{end}"])) for r in found if r["c"] == number),
            key=lambda r: r[:2],
        )
    return out


def _next_brackets(key: _Key, brackets: list[_Bracket], cells: list, found: dict) -> list[_Bracket]:
    """Brackets of the cells that hold wanted ranks; ranks whose value is certain go to ``found``."""
    out = []
    for b, bracket in enumerate(brackets):
        start, mine = bracket.below, [r for r in cells if r[0] == b]
        for _, _, n, lo, hi in mine:
            held = [w for w in bracket.ranks if start <= w < start + n]
            if not held:
                pass
            elif key.kind == "bytes":
                if lo == hi and len(lo) < AHEAD:
                    found.update({w: bracket.lo + lo for w in held})
                else:
                    out.append(_Bracket(bracket.lo + os.path.commonprefix([lo, hi]), None, start, held))
            elif lo == hi:
                found.update({w: lo for w in held})
            elif len(mine) == 1 and (lo, hi) == (bracket.lo, bracket.hi):
                raise RuntimeError(f"counting does not narrow the values between {lo} and {hi}")
            else:
                out.append(_Bracket(lo, hi, start, held))
            start += n
    return out


def _ranked_keys(df: DataFrame, wanted: Mapping[str, Sequence[int]], bins: int, bounds: Mapping[str, tuple] | None) -> dict[str, dict]:
    bounds = bounds or _bounds(df, list(wanted))
    keys, found, pending = {c: _key(df, c) for c in wanted}, {c: {} for c in wanted}, {}
    for c, ranks in wanted.items():
        n, lo, hi = bounds[c]
        bad = [r for r in ranks if not 0 <= r < n]
        if bad:
            raise ValueError(f"ranks {bad} of {c} outside 0..{n - 1}")
        ranks = sorted(set(ranks))
        if keys[c].kind == "bytes":
            pending[c] = [_Bracket(b"", None, 0, ranks)]
        elif lo == hi:
            found[c] = {r: lo for r in ranks}
        else:
            pending[c] = [_Bracket(lo, hi, 0, ranks)]
    while pending := {c: b for c, b in pending.items() if b}:
        share = max(16, min(bins, MAX_CELLS // sum(map(len, pending.values()))))
        counted = _count(df, keys, pending, share)
        pending = {c: _next_brackets(keys[c], b, counted[c], found[c]) for c, b in pending.items()}
    return found


def order_statistics_of(
    df: DataFrame, wanted: Mapping[str, Sequence[int]], bins: int = BINS, bounds: Mapping[str, tuple] | None = None
) -> dict[str, dict]:
    """Exact value at each 0-based ascending rank of several columns; as many jobs as the deepest column needs."""
    at = _ranked_keys(df, wanted, bins, bounds)
    return {c: {r: _key(df, c).value(k) for r, k in at[c].items()} for c in wanted}


def order_statistics(df: DataFrame, col: str, ranks: Sequence[int], bins: int = BINS) -> dict:
    """Exact value at each 0-based ascending rank; numbers, dates, timestamps, strings and bytes."""
    return order_statistics_of(df, {col: ranks}, bins)[col]


def percentiles_of(
    df: DataFrame, cols: Sequence[str], probs: Sequence[float], small_rows: int = SMALL_ROWS, bounds: Mapping[str, tuple] | None = None
) -> dict[str, list]:
    """Exact percentiles of several numeric columns with linear interpolation between neighbouring values.

    ``bounds`` has (count, min, max) of each column when the caller knows them already.
    """
    bounds = bounds or _bounds(df, cols)
    out: dict[str, list] = {c: [None] * len(probs) for c in cols}
    few = [c for c in cols if 0 < bounds[c][0] <= small_rows]
    if few:
        # NaN has no rank; the key leaves it out.
        row = df.agg(*[F.percentile(_ranked(df, c), F.lit([float(p) for p in probs])) for c in few]).first()
        out |= dict(zip(few, row))
    many = [c for c in cols if bounds[c][0] > small_rows]
    spots = {c: [p * (bounds[c][0] - 1) for p in probs] for c in many}
    ranks = {c: {int(math.floor(s)) for s in at} | {int(math.ceil(s)) for s in at} for c, at in spots.items()}
    found = order_statistics_of(df, ranks, bounds={c: bounds[c] for c in many}) if many else {}
    for c, at in spots.items():
        out[c] = []
        for s in at:
            lo, hi = float(found[c][int(math.floor(s))]), float(found[c][int(math.ceil(s))])
            out[c].append(lo + (hi - lo) * (s - math.floor(s)))
    return out


def _ranked(df: DataFrame, col: str) -> Column:
    """The column without NaN."""
    return _key(df, col).column if isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType)) else F.col(col)


def percentiles(df: DataFrame, col: str, probs: Sequence[float], small_rows: int = SMALL_ROWS) -> list[float]:
    """Exact percentiles of one column."""
    return percentiles_of(df, [col], probs, small_rows)[col]


def prefix_split(df: DataFrame, id_col: str, fraction: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """First ``round(fraction * N)`` rows by ascending unique id of any kind, and the rest."""
    bounds = _bounds(df, [id_col])
    n = bounds[id_col][0]
    k = round(fraction * n)
    if k == 0:
        return df.limit(0), df
    if k >= n:
        return df, df.limit(0)
    cut = _key(df, id_col).literal(_ranked_keys(df, {id_col: [k - 1]}, BINS, bounds)[id_col][k - 1])
    return df.filter(F.col(id_col) <= cut), df.filter(F.col(id_col) > cut)


def row_slice(df: DataFrame, id_col: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """Rows ``start`` to ``stop - 1`` in ascending order of a unique id of any kind."""
    bounds = _bounds(df, [id_col])
    n = bounds[id_col][0]
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return df.limit(0)
    at = _ranked_keys(df, {id_col: [start, stop - 1]}, BINS, bounds)[id_col]
    first, last = map(_key(df, id_col).literal, (at[start], at[stop - 1]))
    return df.filter(F.col(id_col).between(first, last))


def head(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """First n rows in the given order."""
    return df.orderBy(*order).limit(n)


def number_rows(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Adds the 0-based place of every row in the given order, which must leave no ties, without a global window.

    Rows are sorted into ranges and written once with their place in the range;
    the sizes of the ranges before it make that a place among all rows.
    """
    spark, path = df.sparkSession, scratch_dir(df.sparkSession, "numbered")
    df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_at", PLACE_BITS))
    sizes = sorted(rows.groupBy("_part").agg(F.count("*")).collect())  # one row per range
    ends = list(itertools.accumulate(n for _, n in sizes))
    starts = small_table(spark, [(r[0], end - r[1]) for r, end in zip(sizes, ends)], "_part long, _start long")
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, place).drop("_part", "_at", "_start")
