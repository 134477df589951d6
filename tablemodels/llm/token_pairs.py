"""Alignment of two tokenizers, with corpus-wide counts of linked token pairs from inverted bitmaps.

Both tokenizers read a space and the text. Byte offsets where tokens of both
end cut the text into groups; every token of the first tokenizer is linked to
every token of the second in its group.

Counting: documents are numbered inside shards of bounded size. A task keeps,
for each linked id pair, the set of its documents in a shard as a compressed
bitmap (sorted places while sparse, bits when dense) and how often the pair is
linked in each of them as bit planes over the set's members. Shards are
disjoint, so OR-merging the bitmaps of a pair puts containers side by side and
its document count is the sum of their popcounts. The postings then return the
counts to the documents: per shard, each pair adds its count times the planes'
multiplicity to its documents. A pair has one row per shard however often it is
linked, so no pair can hold more than its share of the rows.

Neither tokenizer joins text across a space that follows a non-space and comes
before one, so long texts are taken in slices that begin there. The slices of
many documents are aligned together, as arrays: their ends are cuts anyway.

Nulls: null and empty texts, and texts that either tokenizer does not spell
byte by byte, have no tokens: zeros and an empty hash. Null and repeated
document ids are separate documents. An empty table gives no rows. Other
columns are ignored. Texts are read whole, in slices.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablemodels.llm.common import partition_id, per_worker, saved
from tablemodels.llm.tokens import RankEncoder, public_path

CHUNK_CHARS = 1_000_000
SHARD_DOCS = 4096
SHARD_POSTINGS = 3_000_000
# Links of one group that are written out; larger groups are counted by id first.
WIDE_LINKS = 10_000
# A link's key: place of its document in the chunk, id a, id b.
ID_BITS = 21

_CUT = re.compile(r"(?<=[^ ]) (?=\S)")

DOC_FIELDS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def slices(text: str, most: int | None = None) -> Iterator[str]:
    """The text in parts of about ``most`` characters that no token crosses; all but the first have lost a space."""
    start, most = 0, most or CHUNK_CHARS
    while len(text) - start > most:
        found = _CUT.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.end()
    yield text[start:]


@dataclass
class Aligned:
    """Texts of a chunk: per text sums, printed groups (None if not spelt byte by byte), and distinct links."""

    sums: np.ndarray  # texts by (tokens a, tokens b, groups, links)
    printed: list[str | None]
    text: np.ndarray  # of each distinct link: place of its text
    keys: np.ndarray  # a << 32 | b
    times: np.ndarray


class PairAligner:
    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = RankEncoder(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        spelt = self.a.spelt()
        self.bytes_a = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError("vocabularies are too large")
        self.sizes = [np.array([len(b) for b in known]) for known in (self.bytes_a, self.bytes_b)]
        # What is printed for an id, by whether it ends its side of a group.
        self.print_a = np.array([f"{i}{end}" for i in range(len(self.bytes_a)) for end in ",|"], object)
        self.print_b = np.array([f"{i}{end}" for i in range(len(self.bytes_b)) for end in ",;"], object)

    def align(self, texts: list[str]) -> Aligned:
        """Each text is read with a space in front of it."""
        ids = [], []
        sound = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1)):
            a, whole = self.a.ids(" " + text), b" " + text.encode()
            sound.append(b"".join([self.bytes_a[i] for i in a]) == whole == b"".join([self.bytes_b[i] for i in b]))
            ids[0].append(a if sound[-1] else [])
            ids[1].append(b if sound[-1] else [])
        n_a, n_b = (np.array([len(i) for i in side], np.int64) for side in ids)
        a, b = (np.fromiter(itertools.chain.from_iterable(side), np.int64, n.sum()) for side, n in zip(ids, (n_a, n_b)))
        end_a, end_b = np.cumsum(self.sizes[0][a]), np.cumsum(self.sizes[1][b])
        # A token closes a group if the other side has a token that ends there as well.
        total = int(end_a[-1]) if len(a) else 0
        ends = np.zeros((2, total + 1), bool)
        ends[0, end_a], ends[1, end_b] = True, True
        last_a, last_b = ends[1, end_a], ends[0, end_b]
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = int(last_a.sum())
        size_a, size_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        start_b = np.cumsum(size_b) - size_b
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        text_a = np.repeat(np.arange(len(texts)), n_a)
        text_of_group = text_a[last_a]
        sums = np.stack([
            n_a, n_b, np.bincount(text_of_group, minlength=len(texts)),
            np.bincount(text_of_group, weights=(size_a * size_b).astype(float), minlength=len(texts)).astype(np.int64),
        ], axis=1)
        # Printed in the order of groups, side a first.
        out = np.empty(len(a) + len(b), object)
        out[np.arange(len(a)) + start_b[group_a]] = self.print_a[2 * a + last_a]
        out[np.arange(len(b)) + np.cumsum(size_a)[group_b]] = self.print_b[2 * b + last_b]
        places = list(zip((first_a + first_b).tolist(), (n_a + n_b).tolist()))
        printed = ["".join(out[s : s + n].tolist())[:-1] if ok else None for ok, (s, n) in zip(sound, places)]
        keys, times = self._links(a, b, text_a, group_a, size_a, size_b, start_b)
        text = keys >> 2 * ID_BITS
        pair = (keys >> ID_BITS & (1 << ID_BITS) - 1) << 32 | keys & (1 << ID_BITS) - 1
        return Aligned(sums, printed, text, pair, times)

    @staticmethod
    def _links(a, b, text_a, group_a, size_a, size_b, start_b) -> tuple[np.ndarray, np.ndarray]:
        """Distinct links of each text and how often each stands there."""
        wide = (size_a * size_b > WIDE_LINKS)[group_a]
        some = np.flatnonzero(~wide)
        n = size_b[group_a[some]]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start_b[group_a[some]], n)
        lead = text_a[some] << 2 * ID_BITS | a[some] << ID_BITS
        keys, times = np.unique(np.repeat(lead, n) | b[at], return_counts=True)
        if not wide.any():
            return keys, times
        keys, times = [keys], [times]
        for g in np.unique(group_a[wide]):
            mine = np.flatnonzero(group_a == g)
            ids_a, count_a = np.unique(a[mine], return_counts=True)
            ids_b, count_b = np.unique(b[start_b[g] : start_b[g] + size_b[g]], return_counts=True)
            keys.append((int(text_a[mine[0]]) << 2 * ID_BITS | ids_a[:, None] << ID_BITS | ids_b).reshape(-1))
            times.append((count_a[:, None] * count_b).reshape(-1))
        keys, times = np.concatenate(keys), np.concatenate(times)
        distinct, where = np.unique(keys, return_inverse=True)
        out = np.zeros(len(distinct), np.int64)
        np.add.at(out, where, times)
        return distinct, out


def pack_places(places: np.ndarray) -> bytes:
    """A bitmap of places below 65 536: sorted 16-bit places, or bits where those are shorter."""
    span = int(places[-1]) // 8 + 1
    if 2 * len(places) <= span:
        return b"\0" + places.astype("<u2").tobytes()
    bits = np.zeros(8 * span, np.uint8)
    bits[places] = 1
    return b"\1" + np.packbits(bits, bitorder="little").tobytes()


def unpack_places(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.frombuffer(data, "<u2", offset=1).astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, offset=1), bitorder="little"))


def pack_planes(times: np.ndarray) -> bytes:
    """Multiplicities of the members as bit planes, lowest first; empty when all are one."""
    top = int(times.max())
    if top == 1:
        return b""
    return b"".join(np.packbits((times >> p & 1).astype(np.uint8)).tobytes() for p in range(top.bit_length()))


def unpack_planes(data: bytes, n: int) -> np.ndarray:
    if not data:
        return np.ones(n, np.int64)
    planes = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, -(-n // 8)), axis=1, count=n).astype(np.int64)
    return (planes << np.arange(len(planes))[:, None]).sum(axis=0)


class _Shard:
    """Documents and postings of one shard while it fills."""

    def __init__(self):
        self.docs: list[tuple] = []
        self.keys, self.places, self.times, self.size = [], [], [], 0

    def add_links(self, keys: np.ndarray, times: np.ndarray):
        """Distinct links of one slice of the document that comes next."""
        self.keys.append(keys)
        self.times.append(times)
        self.places.append(np.full(len(keys), len(self.docs), np.int64))
        self.size += len(keys)

    def mark(self) -> int:
        return len(self.keys)

    def drop(self, mark: int):
        """Forget what was added since ``mark``."""
        self.size -= sum(len(k) for k in self.keys[mark:])
        del self.keys[mark:], self.places[mark:], self.times[mark:]

    def batches(self, shard: int) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in DOC_FIELDS.split(", ")]
        kinds = [pa.string() if f.endswith("string") else pa.int64() for f in DOC_FIELDS.split(", ")]
        n = len(self.docs)
        doc_columns = [pa.array(c, kind) for c, kind in zip(zip(*self.docs), kinds)]
        lead = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
        head = ["shard", "place", "a", "b", "n", "docs", "planes", *names]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard)), pa.array(np.arange(n, dtype=np.int32)), *lead, *doc_columns], head
        )
        if not self.size:
            return
        keys, places, times = (np.concatenate(c) for c in (self.keys, self.places, self.times))
        order = np.lexsort((places, keys))
        keys, places, times = keys[order], places[order], times[order]
        # A document in slices has a row per slice.
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])])
        keys, places, times = keys[starts], places[starts], np.add.reduceat(times, starts)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)].tolist()
        several = np.maximum.reduceat(times, starts) > 1
        docs = [pack_places(places[s:e]) for s, e in zip(starts.tolist(), ends)]
        planes = [pack_planes(times[s:e]) if more else b"" for s, e, more in zip(starts.tolist(), ends, several.tolist())]
        keys, n = keys[starts], len(starts)
        rest = [pa.nulls(n, kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard)), pa.nulls(n, pa.int32()), pa.array((keys >> 32).astype(np.int32)),
             pa.array((keys & 0xFFFFFFFF).astype(np.int32)), pa.array((np.array(ends) - starts).astype(np.int32)),
             pa.array(docs, pa.binary()), pa.array(planes, pa.binary()), *rest],
            head,
        )


def _chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """(doc_id, slice, last) in runs of about ``CHUNK_CHARS`` characters."""
    run, size = [], 0
    for name, text in rows:
        parts = slices(text or "")
        part = next(parts)
        while part is not None:
            following = next(parts, None)
            run.append((name, part, following is None))
            size += len(part) + 100
            if size >= CHUNK_CHARS:
                yield run
                run, size = [], 0
            part = following
    if run:
        yield run


class _Document:
    """What the slices of a document add up to."""

    def __init__(self, mark: int):
        self.sums, self.sound, self.digest, self.mark = np.zeros(4, np.int64), True, hashlib.sha256(), mark

    def add(self, sums: np.ndarray, printed: str | None):
        if printed is None:
            self.sound = False
        else:
            self.digest.update((";" if self.sums[2] else "").encode() + printed.encode())
            self.sums += sums

    def row(self, name) -> tuple:
        if not self.sound or not self.sums[0]:
            return (name, 0, 0, 0, 0, 0, 0, "")
        return (name, *self.sums.tolist(), 0, 0, self.digest.hexdigest())


def _inverted(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, shard_docs: int, shard_postings: int) -> DataFrame:
    """Documents (place set) and postings (a set) of all shards in one written table."""

    def run(batches):
        aligner = per_worker(
            ("pairs", tokenizer_a, tokenizer_b), lambda: PairAligner(public_path(tokenizer_a), public_path(tokenizer_b))
        )
        part, number, shard = partition_id(), 0, _Shard()
        rows = ((i.as_py(), t.as_py()) for batch in batches for i, t in zip(batch.column(0), batch.column(1)))
        document = _Document(0)
        for chunk in _chunks(rows):
            found = aligner.align([text for _, text, _ in chunk if text])
            bounds = np.searchsorted(found.text, np.arange(len(found.printed) + 1))
            at = 0
            for name, text, last in chunk:
                if text:
                    document.add(found.sums[at], found.printed[at])
                    links = slice(bounds[at], bounds[at + 1])
                    shard.add_links(found.keys[links], found.times[links])
                    at += 1
                if last:
                    if not document.sound:
                        shard.drop(document.mark)
                    shard.docs.append(document.row(name))
                    if len(shard.docs) >= shard_docs or shard.size >= shard_postings:
                        yield from shard.batches(part << 32 | number)
                        number, shard = number + 1, _Shard()
                    document = _Document(shard.mark())
        if shard.docs:
            yield from shard.batches(part << 32 | number)

    schema = f"shard long, place int, a int, b int, n int, docs binary, planes binary, {DOC_FIELDS}"
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return saved(rows.mapInArrow(run, schema), "pair-postings")


def pair_scores(inverted: DataFrame) -> DataFrame:
    """(a, b, documents, best): how many documents hold a pair linked, and whether no other pair of its a has more."""
    counts = inverted.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("documents"))
    most = F.max("documents").over(Window.partitionBy("a"))
    return counts.withColumn("best", F.col("documents") == most)


def _returned(inverted: DataFrame, scores: DataFrame) -> DataFrame:
    """The documents with ``n_best`` and ``count_sum`` added up from the postings of their shard."""
    kinds = DOC_FIELDS.split(", ")
    names = [f.split()[0] for f in kinds]
    postings = inverted.filter("a IS NOT NULL").join(scores, ["a", "b"]).select(
        "shard", F.lit(-1).alias("place"), "n", "docs", "planes", "documents", "best",
        *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in kinds],
    )
    documents = inverted.filter("a IS NULL").select(
        "shard", "place", "n", "docs", "planes", F.lit(None).cast("long").alias("documents"),
        F.lit(None).cast("boolean").alias("best"), *names,
    )
    stream = postings.unionByName(documents).repartition("shard").sortWithinPartitions("shard", "place")

    def run(batches):
        current, best, total = None, None, None
        at_best, at_sum = 7 + names.index("n_best"), 7 + names.index("count_sum")
        for batch in batches:
            shards, places = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            is_doc = places >= 0
            for s in np.unique(shards):  # sorted, so a shard's postings come before its documents
                if s != current:
                    current, best, total = s, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
                some = np.flatnonzero((shards == s) & ~is_doc)
                if len(some):
                    rows = batch.take(pa.array(some))
                    for n, docs, planes, count, top in zip(*(rows.column(c).to_pylist() for c in range(2, 7))):
                        held, times = unpack_places(docs), unpack_planes(planes, n)
                        total[held] += times * count
                        if top:
                            best[held] += times
                some = np.flatnonzero((shards == s) & is_doc)
                if len(some):
                    columns = batch.take(pa.array(some)).columns[7:]
                    columns[at_best - 7], columns[at_sum - 7] = pa.array(best[places[some]]), pa.array(total[places[some]])
                    yield pa.RecordBatch.from_arrays(columns, names)

    return stream.mapInArrow(run, DOC_FIELDS)


def align(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, shard_docs: int = SHARD_DOCS, shard_postings: int = SHARD_POSTINGS
) -> DataFrame:
    """One row per document (doc_id, text): tokens, groups and links, and what the corpus says about the links.

    ``tokenizer_a`` is a byte-level vocabulary file, ``tokenizer_b`` a piece
    model that puts a space in front; both by the names of public files.
    """
    if shard_docs > 1 << 16:
        raise ValueError("a shard holds at most 65 536 documents")
    inverted = _inverted(docs, tokenizer_a, tokenizer_b, shard_docs, shard_postings)
    return _returned(inverted, pair_scores(inverted))
