"""Ranked lexical search of many items at once, with what items share worked out once.

Items are sets of terms. Terms that stand in the same items form an atom; pairs
of atoms that several items hold together become inner nodes, pairs of those
again, until no pair is shared: a directed graph whose roots are the items. A
task reads the postings of its documents, fills one accumulator per atom and
document, adds accumulators up along the graph, level by level, and keeps the
best documents of each item; Spark merges these.

Scores are sums of integers, so the order of adding changes nothing. Document
counts are taken over all documents with a term in them. Item sets go in blocks
of a bounded number of terms, each block with its own graph and one pass over
the documents; only a block and its term counts are ever on the driver.

Nulls: a null text has no terms and takes no part; a null document id ranks
behind all ids of the same score; a null item id is kept. Repeated items get
the same rows each, repeated documents are separate ones. An empty table on
either side gives no rows. Other columns are ignored. Texts are read whole,
whatever their length.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablemodels.llm.common import partition_id, saved

# The characters that end a term, and the scoring constants of the contract.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LENGTH_SHARE = 90  # of 100, how much a document's length counts
SATURATION = 8
UNIT = 1_000_000_000

BLOCK_TERMS = 50_000  # terms of the item sets of one block, repeats included
PAIR_WINDOW = 32  # nodes of an item that each node is paired with while mining
CELLS = 4_000_000  # accumulators held at once
MERGE_SALT = 64

_TABLE = bytes(
    ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256)
)


def terms(text: Column) -> Column:
    """Sorted distinct terms of a text, A-Z in lower case."""
    lower = F.translate(text.cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_sort(F.array_distinct(F.filter(F.split(lower, BETWEEN), lambda t: t != "")))


@dataclass
class SharedGraph:
    """Item sets over a vocabulary as sums of shared nodes.

    Nodes are numbered atoms first, then level by level; ``levels`` holds
    (first node, left children, right children).
    """

    n_atoms: int
    term_order: np.ndarray  # terms grouped by atom
    atom_starts: np.ndarray
    levels: list[tuple[int, np.ndarray, np.ndarray]]
    n_nodes: int
    refs: np.ndarray  # remaining nodes of each item, one after the other
    ref_starts: np.ndarray

    def scores(self, parts: np.ndarray) -> np.ndarray:
        """Items by documents from contributions (terms by documents)."""
        acc = np.empty((self.n_nodes, parts.shape[1]), np.int64)
        acc[: self.n_atoms] = np.add.reduceat(parts[self.term_order], self.atom_starts, axis=0)
        for first, left, right in self.levels:
            np.add(acc[left], acc[right], out=acc[first : first + len(left)])
        return np.add.reduceat(acc[self.refs], self.ref_starts, axis=0)


def shared_graph(sets: list[list[int]]) -> SharedGraph:
    """Mine shared term sets; ``sets`` are distinct, not empty, and hold term numbers from 0 without gaps."""
    where: dict[int, list[int]] = {}
    for s, members in enumerate(sets):
        for t in members:
            where.setdefault(t, []).append(s)
    atoms: dict[tuple, list[int]] = {}
    for t in sorted(where):
        atoms.setdefault(tuple(where[t]), []).append(t)
    # Atoms of many items first, so that what is shared stands side by side.
    order = sorted(atoms, key=lambda sig: (-len(sig), sig))
    held: list[list[int]] = [[] for _ in sets]
    for node, sig in enumerate(order):
        for s in sig:
            held[s].append(node)
    sizes = [len(atoms[sig]) for sig in order]
    n_nodes, levels = len(order), []
    while True:
        together = Counter()
        for nodes in held:
            for i, a in enumerate(nodes):
                together.update(zip(repeat(a), nodes[i + 1 : i + 1 + PAIR_WINDOW]))
        merged: dict[int, tuple[int, int]] = {}  # left child -> (right child, new node)
        used: set[int] = set()
        left, right = [], []
        for (a, b), n in sorted(together.items(), key=lambda e: (-e[1], e[0])):
            if n < 2:
                break
            if a not in used and b not in used:
                used |= {a, b}
                merged[a] = (b, n_nodes + len(left))
                left.append(a)
                right.append(b)
        if not left:
            break
        levels.append((n_nodes, np.array(left), np.array(right)))
        n_nodes += len(left)
        for s, nodes in enumerate(held):
            have, gone, new = set(nodes), set(), []
            for a in nodes:
                if a in merged and merged[a][0] in have:
                    gone |= {a, merged[a][0]}
                    new.append(merged[a][1])
            if new:
                held[s] = new + [a for a in nodes if a not in gone]
    lengths = np.array([len(nodes) for nodes in held])
    return SharedGraph(
        len(order), np.array([t for sig in order for t in atoms[sig]], np.int64), np.cumsum(sizes) - sizes,
        levels, n_nodes, np.array([a for nodes in held for a in nodes], np.int64), np.cumsum(lengths) - lengths,
    )


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _postings(docs: DataFrame, vocabulary: dict[bytes, int], label: str) -> DataFrame:
    """(doc_id, n, ids, tfs) of documents with terms: their term count and the vocabulary's terms in them."""

    def run(batches):
        number, missing = vocabulary.get, repeat(-1)
        for batch in batches:
            names, counts, ids, tfs = [], [], [], []
            for name, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or b"").translate(_TABLE).split()
                if words:
                    found = np.fromiter(map(number, words, missing), np.int32, len(words))
                    term, tf = np.unique(found[found >= 0], return_counts=True)
                    names.append(name.as_py())
                    counts.append(len(words))
                    ids.append(term.astype("<i4").tobytes())
                    tfs.append(tf.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(tfs, pa.binary())],
                ["doc_id", "n", "ids", "tfs"],
            )

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary"))
    return saved(texts.mapInArrow(run, "doc_id long, n long, ids binary, tfs binary"), label)


def _document_counts(postings: DataFrame, n_terms: int) -> tuple[int, int, list[int]]:
    """Documents, their terms altogether, and the documents holding each term of the vocabulary."""

    def run(batches):
        df, n_docs, length = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            n_docs += batch.num_rows
            length += sum(batch.column(0).to_pylist())
            held = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4")
            df += np.bincount(held, minlength=n_terms)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-2, -1, *some.tolist()], pa.int64()), pa.array([n_docs, length, *df[some].tolist()], pa.int64())],
            ["term", "n"],
        )

    sums = postings.select("n", "ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = {r["term"]: r["n"] for r in sums.collect()}  # one row per term of a block, and two
    return got.get(-2, 0), got.get(-1, 0), [got.get(t, 0) for t in range(n_terms)]


class _Best:
    """The k best (score, document) pairs of each item so far; a null document goes last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.rows = [np.zeros(0, np.int64)] * 4  # item, score, null, document

    def add(self, scores: np.ndarray, docs: np.ndarray, null: np.ndarray):
        item, at = np.nonzero(scores >= self.floor[:, None])
        if not len(item):
            return
        new = item, scores[item, at], null[at].astype(np.int64), docs[at]
        rows = [np.concatenate(c) for c in zip(self.rows, new)]
        order = np.lexsort((rows[3], rows[2], -rows[1], rows[0]))
        rows = [c[order] for c in rows]
        first = np.searchsorted(rows[0], rows[0])
        rank = np.arange(len(order)) - first
        last = rank == self.k - 1
        self.floor[rows[0][last]] = rows[1][last]
        self.rows = [c[rank < self.k] for c in rows]


def _best_documents(postings: DataFrame, graph: SharedGraph, weights: list[int], n_docs: int, length: int, n_items: int, k: int):
    """(item, task, doc_id, score): the k best documents of each item in each task."""
    w, width = np.array(weights, np.int64), max(1, CELLS // (len(weights) + graph.n_nodes + len(graph.refs)))

    def run(batches):
        best = _Best(n_items, k)
        for batch in batches:
            for start in range(0, batch.num_rows, width):
                part = batch.slice(start, width)
                names, lengths, ids, tfs = (c.to_pylist() for c in part.columns)
                m = [100 - LENGTH_SHARE + LENGTH_SHARE * n * n_docs // length for n in lengths]
                term = np.frombuffer(b"".join(ids), "<i4")
                tf = np.frombuffer(b"".join(tfs), "<i8")
                sizes = [len(b) // 4 for b in ids]
                parts = np.zeros((len(w), part.num_rows), np.int64)
                norm = np.repeat(np.array(m, np.int64), sizes)
                parts[term, np.repeat(np.arange(part.num_rows), sizes)] = w[term] * (UNIT * tf // (1000 * tf + SATURATION * norm))
                null = np.array([d is None for d in names], bool)
                best.add(graph.scores(parts), np.array([d or 0 for d in names], np.int64), null)
        item, score, null, doc = best.rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(item.astype(np.int32)), pa.array(np.full(len(item), partition_id(), np.int64)),
             pa.array(doc, mask=null.astype(bool)), pa.array(score)],
            ["item", "task", "doc_id", "score"],
        )

    return postings.mapInArrow(run, "item int, task long, doc_id long, score long")


def search(items: DataFrame, docs: DataFrame, k: int, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents (doc_id, text) of every item (item_id, text)."""
    spark = docs.sparkSession
    held = items.select(F.col("item_id").cast("long").alias("item_id"), terms(F.col("text")).alias("terms"))
    held = held.filter(F.size("terms") > 0).withColumn("key", F.sha2(F.concat_ws(" ", "terms"), 256))
    held = saved(held, "search-items")
    sets = held.select("key", "terms").dropDuplicates(["key"])
    total = sets.agg(F.sum(F.size("terms"))).first()[0] or 0
    n_blocks = -(-total // block_terms)
    block = F.pmod(F.xxhash64("key"), F.lit(max(n_blocks, 1)))
    found = None
    for b in range(n_blocks):
        rows = sets.filter(block == b).orderBy("key").collect()  # about block_terms terms
        if not rows:
            continue
        words = sorted({t for r in rows for t in r["terms"]})
        number = {t: i for i, t in enumerate(words)}
        graph = shared_graph([[number[t] for t in r["terms"]] for r in rows])
        postings = _postings(docs, {t.encode(): i for t, i in number.items()}, "search-postings")
        n_docs, length, df = _document_counts(postings, len(words))
        if not n_docs:
            break
        weights = [term_weight(n_docs, n) for n in df]
        each = _best_documents(postings, graph, weights, n_docs, length, len(rows), k)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        for keys in (["item", "salt"], ["item"]):
            each = each.withColumn("salt", F.pmod("task", F.lit(MERGE_SALT)))
            each = each.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            each = each.filter(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r["key"]) for i, r in enumerate(rows)], "item int, key string")
        one = each.join(F.broadcast(names), "item").select("key", "rank", "doc_id", "score")
        one = saved(one, "search-found")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return held.join(found, "key").select("item_id", "rank", "doc_id", "score")
