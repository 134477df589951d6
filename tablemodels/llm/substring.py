"""Removal of word windows that occur more than once, by suffix automata of reference shards.

A window is ``window`` consecutive words of one document; it is repeated if the
same words start at any other place of the corpus. The corpus is its own
reference, which no worker can hold, so it is cut by content: the smallest hash
of the 12-word grams inside a window is the window's anchor, and equal windows
have equal anchors. Consecutive windows with one anchor form a segment.

1. The equal segments of a document give one small row: places, anchor, digest
   of their words. So a line that fills a document gives as many rows as it has
   different segments, however often it stands there. The digest is
   cryptographic, so segments with one digest are equal; anchors may collide,
   which only brings unlike segments together.
2. Anchors that occur once hold no repeated window. Where all segments of an
   anchor are equal, they are repeated as a whole. Both follow from counts that
   are added up before the shuffle, so a passage in a third of all documents
   costs no more than another.
3. The other anchors' distinct segments are the reference. It is dealt into
   shards by anchor; a task builds the suffix automaton of a shard (segments
   weighted by how often they occur) and streams the shard's segments through
   it. The matching statistics give the occurrences of every window.
4. Repeated windows go back to the documents, whose covered words are cut as
   maximal spans.

Automata go only to the tasks whose segments can match, because sending every
shard to every task would read the corpus once per shard.

Words are runs without ASCII white space, taken as they are. A null text has no
words; documents shorter than a window lose nothing; a null ``doc_id`` is kept;
repeated rows repeat their windows. Rows with one id are told apart by 128 bits
of hash of their text, and rows alike in both lose the same words. An empty
table gives no rows. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemodels.llm.common import chunks, per_worker, saved

GRAM = 12
CHUNK_BYTES = 300_000
SHARD_WORDS = 30_000
ROW = ["d", "h", "g"]  # what tells rows apart: id and two hashes of the text
SEGMENT = ["anchor", "seg", "seg2"]
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
SPACES = b" \t\n\x0b\x0c\r"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    held = per_worker("powers", dict)
    if len(held.get("up", ())) < n:
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 2**64))
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            row = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
            row[0] = 1
            held[name] = np.multiply.accumulate(row)
    return held["up"], held["down"]


class Hasher:
    """Hash of any range of a sequence of 64-bit symbols, from one running sum."""

    def __init__(self, symbols: np.ndarray):
        up, self.down = _powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[: len(symbols)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def word_symbols(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start and end of each word in the bytes, hash of the word)."""
    space = np.isin(buffer, np.frombuffer(SPACES, np.uint8))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    table = _mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
    return start, end, Hasher(table[buffer]).of(start, end)


def segments_of(texts: list[bytes], window: int, gram: int) -> dict[str, np.ndarray]:
    """Segments of several documents: row of the document, windows, anchor, 128-bit digest of the words, and where the
    document has them: first words ``starts[at[i] : at[i + 1]]``, ascending."""
    joined = b"\n".join(texts) + b"\n"
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    start, end, symbol = word_symbols(np.frombuffer(joined, np.uint8))
    doc = np.searchsorted(offsets, start, side="right") - 1
    first_word = np.searchsorted(start, offsets[:-1])
    n = len(start) - window + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return {"row": none, "starts": none, "at": np.zeros(1, np.int64), "n": none, "anchor": none, "seg": none, "seg2": none}
    words = Hasher(symbol)
    at = np.arange(len(start) - gram + 1)
    grams = words.of(at, at + gram)
    views = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)
    place = np.empty(n, np.int64)
    for i in range(0, n, 200_000):
        place[i : i + 200_000] = views[i : i + 200_000].argmin(axis=1)
    place += np.arange(n)
    place[doc[:n] != doc[window - 1 :]] = -1  # the window would reach into the next document
    first = np.flatnonzero(np.diff(place, prepend=-2))
    last = np.r_[first[1:], n]
    kept = place[first] >= 0
    first, last = first[kept], last[kept]
    row = doc[first]
    plain, after = memoryview(b" ".join(joined.split())), np.cumsum(end - start + 1)  # the words one space apart
    spans = zip((after[first] - (end - start)[first] - 1).tolist(), (after[last + window - 2] - 1).tolist())
    digests = np.frombuffer(b"".join([blake2b(plain[s:e], digest_size=16).digest() for s, e in spans]), "<i8").reshape(-1, 2)
    seg, seg2 = digests[:, 0], digests[:, 1]
    order = np.lexsort((seg2, seg, row))  # stable
    changes = [np.diff(x[order]) != 0 for x in (row, seg, seg2)]
    at = np.r_[0, np.flatnonzero(np.logical_or.reduce(changes)) + 1] if len(order) else order
    one = order[at]  # equal words have the same anchor and number of windows
    return {
        "row": row[one],
        "starts": (first - first_word[row])[order],
        "at": np.r_[at, len(order)],
        "n": (last - first)[one],
        "anchor": grams[place[first]].view(np.int64)[one],
        "seg": seg[one],
        "seg2": seg2[one],
    }


def _segments(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            for run_ in chunks(rows, lambda r: len(r[3] or ""), CHUNK_BYTES):
                found = segments_of([(r[3] or "").encode() for r in run_], window, gram)
                keys = [pa.array([r[i] for r in run_], pa.int64()).take(pa.array(found["row"])) for i in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *keys,
                        pa.ListArray.from_arrays(pa.array(found["at"].astype(np.int32)), pa.array(found["starts"], pa.int64())),
                        pa.array(found["n"].astype(np.int32)),
                        *(pa.array(found[c]) for c in ("anchor", "seg", "seg2")),
                    ],
                    [*ROW, "starts", "n", "anchor", "seg", "seg2"],
                )

    return docs.select(*ROW, "text").mapInArrow(run, "d long, h long, g long, starts array<long>, n int, anchor long, seg long, seg2 long")


class SuffixAutomaton:
    """Automaton of several word sequences, each with a weight."""

    def __init__(self):
        self.next, self.link, self.length, self.count = [{}], [-1], [0], [0]

    def _state(self, length, link, edges, count):
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(count)
        return len(self.next) - 1

    def add(self, words: list, weight: int) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)
            self.count[last] += weight

    def _extend(self, last: int, w) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(w)
        if q is not None:  # another sequence has been here
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, w, q)
        cur = self._state(length[last] + 1, 0, {}, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w, q: int) -> int:
        nxt, link = self.next, self.link
        copy = self._state(self.length[p] + 1, link[q], dict(nxt[q]), 0)
        link[q] = copy
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def finish(self) -> None:
        """Occurrences of a state's words: its own and those of the longer sequences that end in them."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeated(self, words: list, window: int) -> list[int]:
        """Starts of the windows of ``words`` that occur at least twice: matching statistics, word by word."""
        nxt, link, length, count = self.next, self.link, self.length, self.count
        state = matched = 0
        out = []
        for i, w in enumerate(words):
            while state and w not in nxt[state]:
                state = link[state]
                matched = length[state]
            if w in nxt[state]:
                state, matched = nxt[state][w], matched + 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = min(matched, length[state])
            if matched >= window and count[state] > 1:
                out.append(i - window + 1)
        return out


def _repeated_in_shards(reference: DataFrame, window: int) -> DataFrame:
    """Runs of repeated windows inside each distinct segment: (anchor, seg, seg2, places as start * 64 + windows)."""

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if size >= SHARD_WORDS and row[0] != last:
                    yield shard(held)
                    held, size = [], 0
                words = row[4].split(" ")
                held.append((row[:3], row[3], words))
                size, last = size + len(words), row[0]
        if held:
            yield shard(held)

    def shard(rows):
        automaton = SuffixAutomaton()
        for _, weight, words in rows:
            automaton.add(words, weight)
        automaton.finish()
        out = []
        for key, _, words in rows:
            places = runs_of(automaton.repeated(words, window))
            if places:
                out.append((*key, places))
        columns = list(zip(*out)) if out else [()] * 4
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.list_(pa.int64()))], [*SEGMENT, "places"]
        )

    dealt = reference.select(*SEGMENT, "weight", "text").repartition("anchor").sortWithinPartitions(*SEGMENT)
    return dealt.mapInArrow(run, "anchor long, seg long, seg2 long, places array<long>")


def runs_of(starts: list[int]) -> list[int]:
    """Consecutive window starts as start * 64 + number, at most 63 each."""
    out: list[int] = []
    for s in starts:
        if out and (out[-1] >> 6) + (out[-1] & 63) == s and out[-1] & 63 < 63:
            out[-1] += 1
        else:
            out.append(s * 64 + 1)
    return out


def _squeezed(text: Column) -> Column:
    """Texts made small for the shuffle."""

    @F.pandas_udf("binary")
    def squeeze(texts: pd.Series) -> pd.Series:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return pd.Series([None if t is None else pack(t.encode()) for t in texts], dtype=object)

    return squeeze(text.cast("string"))


def _cut(window: int):
    @F.pandas_udf("n_words long, n_removed long, kept string, text string")
    def cut(squeezed: pd.Series, places: pd.Series) -> pd.DataFrame:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        out = []
        for data, found in zip(squeezed, places):
            text = open_(data) if data is not None else None
            words = (text or b"").split()
            n, removed = len(words), 0
            if found is not None and len(found):
                found = np.asarray(found, np.int64)
                edge = np.zeros(n + 1, np.int64)
                np.add.at(edge, found >> 6, 1)
                np.add.at(edge, (found >> 6) + (found & 63) + window - 1, -1)
                keep = np.cumsum(edge[:-1]) == 0
                removed = int(n - keep.sum())
                words = [w for w, k in zip(words, keep.tolist()) if k]
            whole = None if removed or text is None else text.decode()
            out.append((n, removed, b" ".join(words).decode(), whole))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept", "text"])

    return cut


def _texts_of_segments(requests: DataFrame, window: int) -> DataFrame:
    """(anchor, seg, seg2, weight, text) from documents and the segments wanted of each."""

    def run(batches):
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for data, wanted in zip(batch.column(0), batch.column(1)):
                words = open_(data.as_py()).split()
                for w in wanted.as_py():
                    text = b" ".join(words[w["start"] : w["start"] + w["n"] + window - 1])
                    out.append((*(w[c] for c in SEGMENT), w["weight"], text.decode()))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string())], [*SEGMENT, "weight", "text"]
            )

    return requests.select("z", "wanted").mapInArrow(run, "anchor long, seg long, seg2 long, weight long, text string")


def _same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on ``ROW``; the right side's columns start with an underscore."""
    return left.d.eqNullSafe(right["_d"]) & (left.h == right["_h"]) & (left.g == right["_g"])


def remove_repeats(docs: DataFrame, window: int = 35, gram: int = GRAM) -> DataFrame:
    """The documents without their text, but with a struct column ``_repeats``: n_words, n_removed, the kept words
    joined by one space, and the text as it was if nothing was removed (else null)."""
    if not 1 <= gram <= window or window - gram + 1 > 63:
        raise ValueError("a gram must be at most as long as the window, and at most 62 words shorter")
    text = F.col("text").cast("string")
    row = {"d": F.col("doc_id").cast("long"), "h": F.xxhash64(text), "g": F.xxhash64(F.lit("second"), text)}
    plain = docs.select(*[c.alias(n) for n, c in row.items()], text.alias("text"))
    segments = saved(_segments(plain, window, gram), "segments")
    digest, times = F.struct("seg", "seg2"), F.size("starts")
    anchors = segments.groupBy("anchor").agg(F.sum(times).alias("c"), F.min(digest).alias("lo"), F.max(digest).alias("hi"))
    # Written, so that both sides of the join come from an exchange and a common anchor can be split.
    anchors = saved(anchors.filter("c > 1").select("anchor", (F.col("lo") == F.col("hi")).alias("alike")), "anchors")
    recurring = saved(segments.join(anchors, "anchor"), "recurring-segments")

    mixed = recurring.filter(~F.col("alike"))
    place = F.struct(F.coalesce("d", F.lit(-1)).alias("o"), *ROW, F.col("starts")[0].alias("start"), "n")
    distinct = mixed.groupBy(*SEGMENT).agg(F.sum(times).alias("weight"), F.min(place).alias("p"))
    wanted = distinct.select(
        *[F.col(f"p.{c}").alias(c) for c in ROW],
        F.struct(*SEGMENT, "weight", F.col("p.start").alias("start"), F.col("p.n").alias("n")).alias("w"),
    )
    wanted = wanted.groupBy(*[F.col(c).alias(f"_{c}") for c in ROW]).agg(F.collect_list("w").alias("wanted"))  # of one document
    small = plain.select(*ROW, _squeezed(F.col("text")).alias("z"))
    requests = small.join(wanted, _same_row(small, wanted)).select("z", "wanted")
    reference = _texts_of_segments(requests, window).groupBy(*SEGMENT).agg(
        F.first("weight").alias("weight"), F.first("text").alias("text")
    )
    inside = saved(_repeated_in_shards(reference, window), "repeated-windows")

    shifted = F.flatten(F.transform("starts", lambda s: F.transform("places", lambda p: p + s * 64)))
    of_mixed = mixed.join(inside, SEGMENT).select(*ROW, shifted.alias("places"))
    of_alike = recurring.filter("alike").select(*ROW, F.transform("starts", lambda s: s * 64 + F.col("n")).alias("places"))
    # A set, so that the copies of a repeated row do not add up.
    found = of_mixed.union(of_alike).groupBy(*[F.col(c).alias(f"_{c}") for c in ROW]).agg(F.flatten(F.collect_set("places")).alias("_places"))

    own = {f"_own_{n}": c for n, c in row.items()}
    carried = docs.withColumns({**own, "_z": _squeezed(F.col("text"))}).drop("text")
    same = F.col("_own_d").eqNullSafe(F.col("_d")) & (F.col("_own_h") == F.col("_h")) & (F.col("_own_g") == F.col("_g"))
    out = carried.join(found, same, "left").withColumn("_repeats", _cut(window)("_z", "_places"))
    return out.drop(*own, "_z", "_d", "_h", "_g", "_places")


def kept_sha256(repeats: Column) -> Column:
    return F.sha2(repeats["kept"].cast("binary"), 256)
