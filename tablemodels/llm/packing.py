"""Packing of documents into sequences of a fixed length, dominance reduction before best fit.

Only the number of pieces of each length decides how they are packed, so the
plan is made on at most ``capacity`` counts, whatever the size of the corpus.
Reduction (Martello and Toth): a set of one, two or three lengths that
dominates every other set around its longest item is fixed for good, for as
many copies as there are. What remains is packed by best fit, longest first.
The plan says which ranks of each length go to which sequences; ranks come from
counts per task, so no task ever ranks all pieces of a common length.

Nulls: a null text is an empty document, which still has its end id; a null id
stays null. Repeated rows are packed each on its own. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemodels.llm.common import partition_id, saved
from tablemodels.llm.tokens import public_path, rank_encoder, slices

# Copies of one length that the choice of a dominating set can tell apart: three beside the longest item.
LOOKED_AT = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, k long"


class _Counts:
    """Lengths that are left, with their numbers, in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, lengths: tuple[int, ...], times: int) -> None:
        for s in lengths:
            self.n[s] -= times
            if not self.n[s]:
                del self.n[s]
                self.order.pop(bisect_left(self.order, s))

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the set can be taken."""
        return min(self.n.get(s, 0) // lengths.count(s) for s in set(lengths))

    def largest(self, most: int, used: tuple[int, ...]) -> int | None:
        """Largest length up to ``most`` of which more copies are left than ``used`` holds."""
        i = bisect_left(self.order, most + 1) - 1
        while i >= 0 and self.n[self.order[i]] <= used.count(self.order[i]):
            i -= 1
        return self.order[i] if i >= 0 else None

    def smallest(self, how_many: int, used: tuple[int, ...], above: int = 0) -> list[int]:
        """The smallest lengths over ``above`` that are left beside ``used``."""
        out, i = [], bisect_left(self.order, above + 1)
        while len(out) < how_many and i < len(self.order):
            s = self.order[i]
            out += [s] * min(how_many - len(out), self.n[s] - used.count(s))
            i += 1
        return out


def _dominating(left: _Counts, i: int, capacity: int) -> tuple[int, ...] | None:
    """A set around the longest item ``i`` that dominates all others, or None."""
    room = capacity - i
    j = left.largest(room, (i,)) if room else None
    if j is None:
        return (i,)  # nothing fits beside it
    if i + j == capacity:
        return (i, j)  # whatever else fits would fit into j's place
    small = left.smallest(3, (i,))
    if len(small) < 2 or small[0] + small[1] > room:
        return (i, j)  # only one more fits, and j is the largest
    if len(small) > 2 and sum(small) <= room:
        return None
    b = left.largest(room - j, (i, j))  # two more at most
    if b is None:
        pair = small[:2]
        return None if sum(pair) > j else (i, j) if _best_pair(left, i, room) <= j else None
    over = left.smallest(2, (i,), above=b)
    # Another pair escapes only if both its items are longer than b.
    if len(over) < 2 or sum(over) > room:
        return (i, j, b)
    return None


def _best_pair(left: _Counts, i: int, room: int) -> int:
    best = 0
    for a in left.order:
        if a > room:
            break
        if left.n[a] > (a == i):
            b = left.largest(room - a, (i, a))
            best = max(best, a + b if b is not None else 0)
    return best


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fixed (lengths, times) and the counts that are left."""
    left, fixed = _Counts(counts), []

    def fix(lengths, times):
        fixed.append((lengths, times))
        left.take(lengths, times)

    for i in list(left.order):  # exact pairs dominate, whatever else is left
        pair = (i, capacity - i)
        if i == capacity:
            fix((i,), left.n[i])
        elif i >= capacity - i and left.times(pair):
            fix(pair, left.times(pair))
    todo = sorted(left.order, reverse=True)
    for i in todo:
        while left.n.get(i):
            found = _dominating(left, i, capacity)
            if not found:
                break
            # Sets of one and two hold until one side runs out. The proof for a set of three looks at no more than
            # LOOKED_AT copies of a length, so it stays the same while all three have as many left.
            spare = min((left.n[s] - LOOKED_AT) // found.count(s) for s in found)
            fix(found, left.times(found) if len(found) < 3 else max(1, spare))
    return fixed, dict(left.n)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, times) by best fit, longest first; equal sequences are handled together."""
    open_rooms: list[int] = []  # ascending
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(lengths, times):
        room = capacity - sum(lengths)
        if room not in groups:
            groups[room] = []
            insort(open_rooms, room)
        groups[room].append((lengths, times))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            at = bisect_left(open_rooms, s)
            if at == len(open_rooms):
                per = min(capacity // s, n)
                put((s,) * per, n // per)
                n -= n // per * per
                continue
            room = open_rooms[at]
            lengths, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                open_rooms.pop(at)
            used = min(n, times)
            if times > used:
                put(lengths, times - used)
            put((*lengths, s), used)
            n -= used
    return [g for room in open_rooms for g in groups[room]]


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, last rank, sequence of the first rank, place in the sequence)."""
    fixed, left = reduce_by_dominance(counts, capacity)
    used: dict[int, int] = {}
    slots, sequence = [], 0
    for lengths, times in fixed + best_fit(left, capacity):
        place = 0
        for s in lengths:
            first = used.get(s, 0)
            used[s] = first + times
            slots.append((s, first, first + times - 1, sequence, place))
            place += s
        sequence += times
    return slots


def encode_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece with its length, its checksum and its number among the task's pieces of that length."""

    def run(batches):
        encoder, part, seen = rank_encoder(public_path(tokenizer)), partition_id(), {}
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = [i for slice_ in slices(text.as_py() or "") for i in encoder.ids(slice_)]
                ids = memoryview(struct.pack(f"<{len(ids) + 1}I", *ids, end_id))
                n = len(ids) // 4
                start, stop, piece = 0, (n - 1) % capacity + 1, 0
                while start < n:
                    length = stop - start
                    k = seen.get(length, 0)
                    seen[length] = k + 1
                    out.append((doc, piece, start, length, zlib.crc32(ids[4 * start : 4 * stop]), part, k))
                    start, stop, piece = stop, stop + capacity, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            columns = zip(*out) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "part", "k"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 1024) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A longer document is cut from its end into full pieces; the first may be
    shorter. Sequences are filled without gaps from place 0.
    """
    spark = docs.sparkSession
    pieces = saved(encode_pieces(docs, tokenizer, end_id, capacity), "pieces")
    each = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    each = saved(each.select("length", "part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "piece-counts")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    slots = plan_slots(counts, capacity)
    plan = spark.createDataFrame(slots, "s_length long, first long, last long, sequence long, place long")
    ranked = pieces.join(each.select("length", "part", "base"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("k"))
    fits = (F.col("length") == F.col("s_length")) & F.col("rank").between(F.col("first"), F.col("last"))
    placed = ranked.join(F.broadcast(plan), fits)  # a bounded number of rows per length
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), F.col("place").alias("offset"),
    )
