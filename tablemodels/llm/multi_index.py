"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own
centroids, so a pair of centroids names a cell. A query orders both lists of
centroids by distance and walks their pairs by summed distance with a heap,
until the cells it has met hold a given share of all entries; those entries are
reranked by their exact distance.

Centroids are fitted on the ``SAMPLE_ROWS`` rows with the smallest hash of
their id; every row is indexed. Entries lie in blocks by groups of first
centroids, and a block of queries travels only to the groups that its walks
met. Groups that hold many entries are split, so no task gets a hot cell whole.
The driver holds the sample, the centroids and one count per cell.

Rows without an id, null or all-zero vectors and vectors with a null, NaN or
infinite component take no part; vectors of another length than the others
fail with a message. Equal distances keep the smaller id. Repeated ids are
separate entries and separate queries; none answers a query with that id, and
they do not count towards its share. Fewer than ``k`` candidates: all of them.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemodels.llm.common import saved
from tablemodels.operators.blocks import matrix_of

SAMPLE_ROWS = 16_384
CENTROIDS = 64
ROUNDS = 12
SHARE = 0.5  # of all entries that a walk has to meet; isotropic vectors need many
LEAST_ENTRIES = 1_000
GROUPS = 16  # of first centroids
BLOCK_ROWS = 4096
QUERY_ROWS = 512
GROUP_ROWS = 65_536  # entries of a group that go to one task


def usable(vector: Column) -> Column:
    """The vector as doubles; null unless it holds finite numbers only and not just zeros."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(finite & F.exists(x, lambda v: v != 0), x)


@dataclass
class Codebooks:
    first: np.ndarray  # centroids of the first half
    second: np.ndarray

    @property
    def width(self) -> int:
        return self.first.shape[1] + self.second.shape[1]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(x) and x.shape[1] != self.width:
            raise ValueError(f"expected vectors of {self.width} components, got {x.shape[1]}")
        return x[:, : self.first.shape[1]], x[:, self.first.shape[1] :]

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.halves(x)
        return _distances(a, self.first).argmin(axis=1) * len(self.second) + _distances(b, self.second).argmin(axis=1)


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres**2).sum(axis=1), 0)


def _centroids(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Lloyd rounds from the first distinct rows; a centroid without rows stays."""
    _, at = np.unique(x, axis=0, return_index=True)
    centres = x[np.sort(at)[:k]].copy()
    for _ in range(rounds):
        best = _distances(x, centres).argmin(axis=1)
        n = np.bincount(best, minlength=len(centres))
        for c in np.flatnonzero(n):
            centres[c] = x[best == c].mean(axis=0)
    return centres


def fit(rows: DataFrame, centroids: int = CENTROIDS, sample: int = SAMPLE_ROWS, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks from the ``sample`` rows (id, v) of smallest id hash; None without rows."""
    drawn = rows.select(F.xxhash64("id").alias("h"), "id", "v").orderBy("h", "id").limit(sample).select("v")
    drawn = [r["v"] for r in drawn.collect()]  # at most ``sample`` rows
    if not drawn:
        return None
    if len({len(v) for v in drawn}) > 1:
        raise ValueError(f"vectors differ in length: {sorted({len(v) for v in drawn})}")
    x = np.array(drawn)
    half = x.shape[1] // 2
    return Codebooks(_centroids(x[:, :half], centroids, rounds), _centroids(x[:, half:], centroids, rounds))


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, target: int) -> list[int]:
    """Cells by ascending d1[i] + d2[j], until they hold ``target`` entries: the multi-sequence algorithm.

    A pair enters the heap when its neighbours with one smaller place on either
    side have left it, so the heap stays as short as the frontier.
    """
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    a, b = d1[o1].tolist(), d2[o2].tolist()
    n1, n2 = len(a), len(b)
    reached = [0] * n1  # row i has given its first reached[i] pairs
    heap, met, total = [(a[0] + b[0], 0, 0)], [], 0
    while heap and total < target:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        cell = o1[i] * n2 + o2[j]
        if counts[cell]:
            met.append(cell)
            total += int(counts[cell])
        if i + 1 < n1 and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if j + 1 < n2 and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
    return met


def _entries(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(grp, ids, cells, vectors, n): entries in blocks by group of first centroids, without a shuffle."""
    second = len(books.second)

    def run(batches):
        held: dict[int, list] = {}

        def block(g):
            ids, cells, x = (np.concatenate(c) for c in zip(*held.pop(g)))
            return pa.RecordBatch.from_pydict(
                {"grp": pa.array([g], pa.int32()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                 "cells": pa.array([cells.astype("<i4").tobytes()], pa.binary()),
                 "vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()), "n": pa.array([len(ids)], pa.int32())}
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(zero_copy_only=False), matrix_of(batch.column(1))
            cells = books.cells(x)
            groups = cells // second % GROUPS
            for g in np.unique(groups).tolist():
                some = np.flatnonzero(groups == g)
                for at in range(0, len(some), BLOCK_ROWS):
                    part = some[at : at + BLOCK_ROWS]
                    held.setdefault(g, []).append((ids[part], cells[part], x[part]))
                    if sum(len(h[0]) for h in held[g]) >= BLOCK_ROWS:
                        yield block(g)
        for g in sorted(held):
            yield block(g)

    schema = "grp int, ids binary, cells binary, vectors binary, n int"
    return saved(rows.select("id", "v").mapInArrow(run, schema), "index-blocks")


def _cell_counts(blocks: DataFrame, n_cells: int) -> np.ndarray:
    def run(batches):
        n = np.zeros(n_cells, np.int64)
        for batch in batches:
            n += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i4"), minlength=n_cells)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["cell", "n"])

    sums = blocks.select("cells").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    counts = np.zeros(n_cells, np.int64)
    for r in sums.collect():  # one row per cell
        counts[r["cell"]] = r["n"]
    return counts


def _walked(queries: DataFrame, books: Codebooks, counts: np.ndarray, share: float) -> DataFrame:
    """(groups, q, q_ids, q_vectors, q_met, q_n): blocks of queries, the cells each has met as bits, and their groups."""
    target, second = max(int(np.ceil(share * counts.sum())), LEAST_ENTRIES), len(books.second)

    def run(batches):
        def block(part, x, met):
            groups = np.unique(np.flatnonzero(met.any(axis=0)) // second % GROUPS)
            return pa.RecordBatch.from_pydict(
                {"groups": pa.array([groups.tolist()], pa.list_(pa.int32())),
                 "q": pa.array([part.column(0).to_numpy().astype("<i8").tobytes()], pa.binary()),
                 "q_ids": pa.array([part.column(1).to_numpy().astype("<i8").tobytes()], pa.binary()),
                 "q_vectors": pa.array([x.astype("<f8").tobytes()], pa.binary()),
                 "q_met": pa.array([np.packbits(met, axis=1).tobytes()], pa.binary()), "q_n": pa.array([len(x)], pa.int32())}
            )

        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(at, QUERY_ROWS)
                x = matrix_of(part.column(2))
                a, b = books.halves(x)
                d1, d2 = _distances(a, books.first), _distances(b, books.second)
                met = np.zeros((len(x), len(counts)), bool)
                for j, own in enumerate(part.column(3).to_pylist()):
                    met[j, walk(d1[j], d2[j], counts, target + own)] = True
                yield block(part, x, met)

    schema = "groups array<int>, q binary, q_ids binary, q_vectors binary, q_met binary, q_n int"
    return saved(queries.select("q", "id", "v", "own").mapInArrow(run, schema), "query-walks")


def rerank(ids, cells, x, q_ids, q, met, k: int):
    """Exact k nearest entries of a block among the cells each query has met: (query place, id, distance) arrays."""
    out = []
    for j in range(len(q)):
        some = np.flatnonzero(met[j][cells] & (ids != q_ids[j]))
        d = np.sqrt(((x[some] - q[j]) ** 2).sum(axis=1))
        if len(d) > k:
            near = d <= np.partition(d, k - 1)[k - 1]
            some, d = some[near], d[near]
        best = np.lexsort((ids[some], d))[:k]
        out.append((np.full(len(best), j), ids[some[best]], d[best]))
    return [np.concatenate(c) for c in zip(*out)]


def nearest(
    queries: DataFrame, candidates: DataFrame, k: int, share: float = SHARE, centroids: int = CENTROIDS,
    sample: int = SAMPLE_ROWS, group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest found for queries (id, v) among candidates (id, v) of usable vectors."""
    spark = queries.sparkSession
    books = fit(candidates, centroids, sample)
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if books is None:
        return empty
    width, n_cells = books.width, len(books.first) * len(books.second)
    blocks = _entries(candidates, books)
    counts = _cell_counts(blocks, n_cells)
    # A query's own id may be repeated; such entries answer nothing, so the walk has to meet as many more.
    own = candidates.join(queries.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count("*").alias("own"))
    asked = queries.join(own, "id", "left").select(
        F.monotonically_increasing_id().alias("q"), "id", "v", F.coalesce("own", F.lit(0)).alias("own")
    )
    walks = _walked(saved(asked, "queries"), books, counts, share)

    # How many tasks share the entries of a group; a table of GROUPS rows.
    per_group = np.bincount(np.arange(n_cells) // len(books.second) % GROUPS, weights=counts, minlength=GROUPS)
    parts = spark.createDataFrame([(g, max(1, int(-(-n // group_rows)))) for g, n in enumerate(per_group)], "grp int, parts int")
    spread = blocks.join(F.broadcast(parts), "grp").withColumn("part", F.pmod(F.xxhash64("ids"), "parts")).drop("parts")
    sent = walks.withColumn("grp", F.explode("groups")).drop("groups").join(F.broadcast(parts), "grp")
    sent = sent.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    met = spread.join(sent, ["grp", "part"])

    def run(batches):
        for batch in batches:
            for ids, cells, x, n, q, q_ids, vectors, bits, q_n in zip(*(c.to_pylist() for c in batch.columns)):
                met = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(q_n, -1), axis=1, count=n_cells).astype(bool)
                at, found, d = rerank(
                    np.frombuffer(ids, "<i8"), np.frombuffer(cells, "<i4"), np.frombuffer(x, "<f8").reshape(n, width),
                    np.frombuffer(q_ids, "<i8"), np.frombuffer(vectors, "<f8").reshape(q_n, width), met, k,
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(q, "<i8")[at]), pa.array(np.frombuffer(q_ids, "<i8")[at]), pa.array(found), pa.array(d)],
                    ["q", "query_id", "id", "score"],
                )

    columns = ["ids", "cells", "vectors", "n", "q", "q_ids", "q_vectors", "q_met", "q_n"]
    each = met.select(*columns).mapInArrow(run, "q long, query_id long, id long, score double")
    order = Window.partitionBy("q").orderBy("score", "id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
