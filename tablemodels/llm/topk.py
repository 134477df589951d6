"""Exact top-k inner products by MaxScore over shards of integer vectors.

A query's terms are its dimensions; a term's postings are the shard's values in
that dimension, and its bound is the most it can add to a score: the query's
value times the shard's largest or smallest one. With the k-th best score found
so far as threshold, the terms whose bounds, smallest first, add up to less are
non-essential: a vector that gets too little from the essential terms cannot
win, so essential postings are added up first and the others are only probed,
largest bound first, for vectors that can still pass. Ties keep the smaller id,
so a vector goes on as long as it can reach the threshold.

Shards and blocks of queries have a bounded size; each shard meets each block
once, its best k per query leave the task, and a second step merges them.

Vectors that are null or hold null, NaN or infinite components take no part,
nor do rows without an id. All vectors must have one length. Repeated ids are
separate candidates; none of them answers a query with that id. Empty tables
give no rows. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemodels.llm.common import saved

SHARD_ROWS = 8192
QUERY_ROWS = 2048
SEED_ROWS = 256
PROBES = 8  # terms probed at a time


def scaled(vector: Column, factor: int) -> Column:
    """floor(factor * x) of each component; null unless all components are finite numbers."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v * F.lit(float(factor))).cast("long")))


def _blocks(rows: DataFrame, size: int, label: str) -> DataFrame:
    """Rows (id, v) packed into (ids, cells, n) of at most ``size`` vectors, without a shuffle."""

    def run(batches):
        ids, cells = [], []

        def block():
            return pa.RecordBatch.from_pydict(
                {"ids": pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 "cells": pa.array([np.array(cells, "<i8").tobytes()], pa.binary()), "n": pa.array([len(ids)], pa.int32())}
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                cells.append(v)
                if len(ids) == size:
                    yield block()
                    ids, cells = [], []
        if ids:
            yield block()

    return saved(rows.mapInArrow(run, "ids binary, cells binary, n int"), label)


def top_of_shard(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int):
    """Best k rows of a shard for every query: (query, id, score) arrays. ``x`` is dimensions by rows."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], np.ascontiguousarray(x[:, order])
    # Sums of exact integers stay exact in doubles up to 2**53.
    most = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * len(x)
    if most >= 2**53:
        raise ValueError("components are too large for exact scores")
    kind = np.float32 if most < 2**24 else np.float64
    x, q = x.astype(kind), q.astype(kind)
    low, high = x.min(axis=1), x.max(axis=1)
    bounds = np.maximum(q * low, q * high)
    seeds = min(SEED_ROWS, len(ids))
    first = q @ x[:, :seeds]
    out = []
    for j in range(len(q)):
        scores, own = first[j].copy(), ids[:seeds] == query_ids[j]
        scores[own] = -np.inf
        floor = np.partition(scores, -k)[-k] if seeds >= k else -np.inf  # the k-th best so far
        terms = np.argsort(-bounds[j], kind="stable")
        rest = np.r_[np.cumsum(bounds[j][terms][::-1])[::-1][1:], 0]  # what the terms after each can add
        # Essential are the terms without which the threshold can be reached; the last ones that cannot are probed.
        n_essential = int(np.searchsorted(-(rest + 0), -floor, side="left")) + 1 if np.isfinite(floor) else len(terms)
        n_essential = min(max(n_essential, 1), len(terms))
        essential = terms[:n_essential]
        partial = q[j, essential] @ x[essential]
        alive = np.flatnonzero(partial + rest[n_essential - 1] >= floor)
        got = partial[alive]
        at = n_essential
        while at < len(terms) and len(alive):
            step = terms[at : at + PROBES]
            got = got + q[j, step] @ x[np.ix_(step, alive)]
            at += len(step)
            still = got + rest[at - 1] >= floor
            alive, got = alive[still], got[still]
        keep = ids[alive] != query_ids[j]
        alive, got = alive[keep], got[keep]
        best = np.lexsort((alive, -got))[:k]
        out.append((np.full(len(best), query_ids[j]), ids[alive[best]], got[best].astype(np.int64)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3


def top_products(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score) for queries (id, v) and candidates (id, v) of integer vectors."""
    shards = _blocks(candidates, SHARD_ROWS, "shards")
    blocks = _blocks(queries, QUERY_ROWS, "query-blocks").withColumn("block", F.crc32("ids"))
    blocks = saved(blocks.withColumnsRenamed({"ids": "q_ids", "cells": "q_cells", "n": "q_n"}), "query-blocks")
    names = [r["block"] for r in blocks.select("block").distinct().collect()]  # one number per block of queries
    if not names:
        return queries.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    spread = shards.withColumn("block", F.explode(F.array(*[F.lit(b) for b in names])))
    met = spread.join(blocks, "block").repartition(F.crc32("ids"), "block")

    def run(batches):
        for batch in batches:
            for ids, cells, n, q_ids, q_cells, q_n in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(cells, "<i8").reshape(n, -1).T
                q = np.frombuffer(q_cells, "<i8").reshape(q_n, -1)
                found = top_of_shard(np.frombuffer(ids, "<i8"), x, np.frombuffer(q_ids, "<i8"), q, k)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["query_id", "id", "score"])

    each = met.select("ids", "cells", "n", "q_ids", "q_cells", "q_n").mapInArrow(run, "query_id long, id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "id", "score")
