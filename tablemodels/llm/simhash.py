"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of equal texts are equal, so the join works on distinct
fingerprints. Each of several tries starts with other bits: fingerprints that
agree in its first bits share a subtree, and inside a task the subtrees are
walked together: pairs of nodes go down bit by bit, the differing bits of a
pair are added up, and a pair is dropped as soon as they exceed the budget. A
node pair with few fingerprints is finished by counting bits; one whose rows
are all tied together already is left out, so that a large group of near
copies costs no pair of its members each.

``block_tries``: one trie per block of bits. Two fingerprints with at most
``budget`` differing bits agree in one of ``budget + 1`` blocks, so no link is
lost. For the large budgets that stand for a similarity of 0.8 blocks would be
too short to keep unlike fingerprints apart; ``drawn_tries`` starts each trie
with ``width`` drawn bits, and finds a pair with d of ``bits`` differing bits
with probability 1 - (1 - (1 - d/bits)^width)^count, about.

Only links from each fingerprint to the smallest one it is tied to inside its
subtree leave the task. First bits with very many fingerprints are cut deeper
first: their next bits become part of the key, and a fingerprint also visits
the subtrees whose next bits differ from its own by no more than the budget.

Nulls: a null text has no words and the fingerprint zero, linked like any
other; rows with a null id are kept and never become the smallest id unless
all are null. Repeated rows are kept. Empty tables give no rows. Other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemodels.llm.common import saved
from tablemodels.llm.graph import components

SEED = 42
LAST_ID = 2**63 - 1  # stands for a null id
HOT_TRIE = 500_000  # distinct fingerprints with the same first bits before these are cut deeper
DEEPER = 8
PAIRS_AT_ONCE = 20_000
FEW = 64  # fingerprint pairs of a node pair that is not walked further
TURNED_ROWS = 20_000

Trie = tuple[np.ndarray, int]  # the order in which bits are walked (0 is the highest), and how many of them are the key


def fingerprint(text: str | None, shingle: int, words: int = 1) -> bytes:
    """``words`` times 64 bits. Bit i is set if it is set in over half of the shingles' hashes; 0 without words.

    The first 64 bits come from XXH64, the others from that hash mixed anew.
    """
    return folded(shingle_hashes((text or "").encode().lower().split(), shingle), words)


def shingle_hashes(parts: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words, of all words if they are fewer; none without words."""
    import xxhash

    digest, join = xxhash.xxh64_intdigest, b" ".join
    n = max(1, len(parts) - shingle + 1) if parts else 0
    return np.fromiter((digest(join(parts[i : i + shingle]), SEED) for i in range(n)), np.uint64, n)


def folded(shingles: np.ndarray, words: int) -> bytes:
    """The fingerprint of these hashes."""
    n = len(shingles)
    if not n:
        return bytes(8 * words)
    ones = np.zeros((words, 64), np.int64)
    for done in range(0, n, 50_000):  # a long text in parts
        hashes = shingles[done : done + 50_000]
        for k in range(words):
            ones[k] += np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            if k + 1 < words:
                hashes = (hashes ^ (hashes >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                hashes ^= hashes >> np.uint64(32)
    return np.packbits(2 * ones.ravel() > n).tobytes()


def fingerprints(docs: DataFrame, shingle: int, words: int = 1) -> DataFrame:
    """(doc_id, h, g, fp): two hashes of the text, which tell rows with one id apart, and the fingerprint as bytes."""

    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle, words) for t in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], fps], ["doc_id", "h", "g", "fp"])

    text = F.col("text").cast("string")
    keys = [c.alias(n) for n, c in _text_hashes(text).items()]
    return docs.select(F.col("doc_id").cast("long"), *keys, text).mapInArrow(run, "doc_id long, h long, g long, fp binary")


def _text_hashes(text) -> dict:
    return {"h": F.xxhash64(text), "g": F.xxhash64(F.lit("second"), text)}


def block_tries(bits: int, budget: int) -> list[Trie]:
    """One trie per block of bits; the bits that follow the block come next."""
    cuts = [round(bits * k / (budget + 1)) for k in range(budget + 2)]
    return [(np.roll(np.arange(bits), -lo), hi - lo) for lo, hi in zip(cuts, cuts[1:])]


def drawn_tries(bits: int, count: int, width: int, seed: int = 1) -> list[Trie]:
    """``count`` tries whose bits come in a drawn order, with ``width`` of them as the key."""
    draw = np.random.default_rng(seed)
    return [(draw.permutation(bits), width) for _ in range(count)]


def _words(column: pa.Array, words: int) -> np.ndarray:
    """Fingerprints as rows of unsigned 64-bit integers, the highest first."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, ">u8").astype(np.uint64).reshape(-1, words)


def _bytes(rows: np.ndarray) -> pa.Array:
    width = 8 * rows.shape[1]
    raw = pa.py_buffer(np.ascontiguousarray(rows).astype(">u8").tobytes())
    return pa.Array.from_buffers(pa.binary(width), len(rows), [None, raw]).cast(pa.binary())


def _turned(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The fingerprints with their bits in another order."""
    bits = np.unpackbits(np.ascontiguousarray(rows).astype(">u8").view(np.uint8), axis=1)
    return np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view(">u8").astype(np.uint64)


def _all_pairs(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row of each range a with every row of its range b."""
    wide = b1 - b0
    n = (a1 - a0) * wide
    pair = np.repeat(np.arange(len(n)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return a0[pair] + k // wide[pair], b0[pair] + k % wide[pair]


def _tie(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``root`` (the smallest row tied to each row) after the links (i, j)."""
    root = root.copy()
    while True:
        ri, rj = root[i], root[j]
        apart = ri != rj
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(ri, rj)[apart], np.minimum(ri, rj)[apart])
        while (root[root] != root).any():
            root = root[root]


def trie_roots(keys: np.ndarray, fps: np.ndarray, walked: int, budget: int) -> np.ndarray:
    """The smallest row that each row is tied to by links between rows with equal keys and at most ``budget`` differing bits.

    ``fps`` holds distinct fingerprints per key, as rows of 64-bit words with
    the bits in the order of the trie. Rows are sorted by key and fingerprint:
    every run of equal keys is one trie, whose nodes are ranges of the rows.
    The last ``walked`` bits are walked.
    """
    n = len(keys)
    root, moved = np.arange(n), np.arange(n)  # moved: how often the root changes up to a row
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], n]
    many = ends - starts > 1
    stack = [(walked - 1, starts[many], ends[many], starts[many], ends[many], np.zeros(many.sum(), np.int64))]
    waiting, found_i, found_j = 0, [], []
    while stack:
        bit, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > PAIRS_AT_ONCE:
            for part in np.array_split(np.arange(len(a0)), -(-len(a0) // PAIRS_AT_ONCE)):
                stack.append((bit, a0[part], a1[part], b0[part], b1[part], diff[part]))
            continue
        tied = (moved[a0] == moved[a1 - 1]) & (moved[b0] == moved[b1 - 1]) & (root[a0] == root[b0])
        a0, a1, b0, b1, diff = a0[~tied], a1[~tied], b0[~tied], b1[~tied], diff[~tied]
        if not len(a0):
            continue
        small = (a1 - a0) * (b1 - b0) <= FEW
        if bit < 0 or small.any():  # no range is wider than one row below the last bit
            done = small if bit >= 0 else np.ones(len(a0), bool)
            i, j = _all_pairs(a0[done], a1[done], b0[done], b1[done])
            new = (i < j) & (root[i] != root[j])
            i, j = i[new], j[new]
            near = np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1) <= budget
            found_i.append(i[near])
            found_j.append(j[near])
            waiting += int(near.sum())
            if waiting > max(n, 50_000):
                root = _tie(root, np.concatenate(found_i), np.concatenate(found_j))
                moved = np.cumsum(np.r_[False, root[1:] != root[:-1]])
                waiting, found_i, found_j = 0, [], []
        go = ~small
        if bit < 0 or not go.any():
            continue
        a0, a1, b0, b1, diff = a0[go], a1[go], b0[go], b1[go], diff[go]
        am, bm = _split(fps, a0, a1, bit), _split(fps, b0, b1, bit)
        own = (a0 == b0) & (a1 == b1)
        nodes = [
            (a0, am, b0, bm, diff, None),
            (am, a1, bm, b1, diff, None),
            (a0, am, bm, b1, diff + 1, None),
            (am, a1, b0, bm, diff + 1, ~own),
        ]
        parts = []
        for x0, x1, y0, y1, d, keep in nodes:
            ok = (x1 > x0) & (y1 > y0) & (d <= budget)
            if keep is not None:
                ok &= keep
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], d[ok]))
        stack.append((bit - 1, *(np.concatenate(c) for c in zip(*parts))))
    return _tie(root, np.concatenate(found_i), np.concatenate(found_j)) if found_i else root


def _split(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: int) -> np.ndarray:
    """Where the given bit turns from 0 to 1 inside each sorted range: a binary search over all ranges at once."""
    word, shift = fps[:, fps.shape[1] - 1 - bit // 64], np.uint64(bit % 64)
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        one = ((word[np.minimum(mid, len(word) - 1)] >> shift) & np.uint64(1)).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def near_links(fps: DataFrame, words: int, tries: list[Trie], budget: int, hot_trie: int = HOT_TRIE) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``fps(fp)`` that tie together those within the budget and a trie."""

    def turn(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, TURNED_ROWS):
                rows = _words(batch.column(0).slice(at, TURNED_ROWS), words)
                for t, (order, width) in enumerate(tries):
                    v = _turned(rows, order)
                    high = v[:, 0]
                    block, own = high >> np.uint64(64 - width), (high << np.uint64(width)) >> np.uint64(64 - DEEPER)
                    columns = [pa.array(np.full(len(v), t, np.int32)), pa.array(block.view(np.int64)),
                               pa.array(own.view(np.int64)), _bytes(v)]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "block", "own", "v"])

    turned = fps.select("fp").mapInArrow(turn, "t int, block long, own long, v binary")
    counted = turned.groupBy("t", "block").count()
    hot = counted.filter(F.col("count") > hot_trie).select("t", "block", F.lit(True).alias("hot"))
    # Cold tries: the key is the block. Hot ones: the pair of the next bits of the two nodes that meet.
    turned = turned.join(F.broadcast(hot), ["t", "block"], "left")  # at most tries * rows / hot_trie rows
    masks = [m for m in range(1 << DEEPER) if bin(m).count("1") <= budget]
    own = F.col("own")
    cells = F.transform(
        F.array(*[F.lit(m).cast("long") for m in masks]),
        lambda m: F.least(own, own.bitwiseXOR(m)) * F.lit(1 << DEEPER) + F.greatest(own, own.bitwiseXOR(m)),
    )
    cells = F.when(F.col("hot"), cells).otherwise(F.array(F.lit(-1).cast("long")))
    turned = turned.select("t", "block", "v", F.explode(cells).alias("cell"))

    def walk(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        t, block, cell = (table.column(k).to_numpy() for k in (0, 1, 3))
        v = _words(table.column(2), words)
        for k, (order, width) in enumerate(tries):
            which = np.flatnonzero(t == k)
            if not len(which):
                continue
            which = which[np.lexsort((*v[which].T[::-1], cell[which], block[which]))]
            x, b, c = v[which], block[which], cell[which]
            keys = np.cumsum(np.r_[False, (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
            root = trie_roots(keys, x, 64 * words - width, budget)
            tied = np.flatnonzero(root != np.arange(len(x)))
            back = np.argsort(order)
            yield pa.RecordBatch.from_arrays([_bytes(_turned(x[tied], back)), _bytes(_turned(x[root[tied]], back))], ["a", "b"])

    spread = turned.repartition("t", "block", "cell")
    return spread.mapInArrow(walk, "a binary, b binary").distinct()


def _components(each: DataFrame, least, words: int, tries: list[Trie], budget: int, hot_trie: int) -> DataFrame:
    """(fp, first): the smallest ``least`` of the component of each fingerprint."""
    distinct = saved(each.groupBy("fp").agg(F.min(least).alias("least")), "distinct-fingerprints")
    tied = components(near_links(distinct.select("fp"), words, tries, budget, hot_trie))
    rooted = distinct.join(tied.select(F.col("node").alias("fp"), "root"), "fp", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "fp"))
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return saved(rooted.join(firsts, "root").select("fp", "first"), "named-fingerprints")


def near_components(docs: DataFrame, shingle: int, budget: int, hot_trie: int = HOT_TRIE) -> DataFrame:
    """(doc_id, fingerprint, component_id): components of 64-bit fingerprints within ``budget`` differing bits, every link kept."""
    each = saved(fingerprints(docs, shingle), "fingerprints")
    named = _components(each, F.col("doc_id"), 1, block_tries(64, budget), budget, hot_trie)
    return each.join(named, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("first").alias("component_id"))


def keep_one(
    docs: DataFrame, shingle: int, budget: int, words: int = 1, tries: list[Trie] | None = None, hot_trie: int = HOT_TRIE
) -> DataFrame:
    """One document of each component of fingerprints of ``words`` times 64 bits: that with the smallest id (ids that are
    null come last), one of repeated rows."""
    each = saved(fingerprints(docs, shingle, words), "fingerprints")
    id_ = F.coalesce("doc_id", F.lit(LAST_ID))
    named = _components(each, F.struct(id_.alias("k"), "h", "g"), words, tries or block_tries(64 * words, budget), budget, hot_trie)
    kept = named.select(*[F.col(f"first.{c}").alias(f"_first_{c}") for c in "khg"]).distinct()
    text = F.col("text").cast("string")
    keyed = docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)), **{f"_{n}": c for n, c in _text_hashes(text).items()}})
    # Repeated rows go first, at most one of a kind from each task; the join then needs no other shuffle of the texts.
    one = keyed.withColumn("_n", F.row_number().over(Window.partitionBy("_k", "_h", "_g").orderBy(F.lit(1)))).filter("_n = 1")
    same = [F.col(f"_{c}") == F.col(f"_first_{c}") for c in "khg"]
    return one.join(kept, same, "left_semi").drop("_k", "_h", "_g", "_n")
