"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score is linear in its own features and
those of its two neighbours (shares of character classes, word lengths, being a
repeat of another line); the chain adds a score for each pair of neighbouring
labels. Forward-backward marginals, weighted by the lines' lengths, give the
document's quality between 0 and 1.

The field is fitted on a bounded sample of labelled documents, whose lines take
their document's label: at most ``sample`` documents (smallest hashes of their
ids) of at most ``sample_chars`` characters each. Scoring reads whole texts.

Nulls: a null text is an empty one, which is one empty line; a null id is kept
and scored. Labels that are null, contradict each other or name no document do
not count; without any usable label all documents score 0.5. Repeated rows are
scored each. An empty table gives no rows. Other columns stay as they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemodels.llm.common import chunks
from tablemodels.llm.substring import Hasher, word_symbols

CLASSES = 9
CHUNK_CHARS = 1_000_000


def _class_table() -> np.ndarray:
    """Byte to class: lower, upper, digit, space, stop mark, other mark, bracket, non-ASCII, control."""
    table = np.full(256, 8, np.uint8)
    for c in range(33, 127):
        table[c] = 5
    for chars, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2),
                     (b" \t\r\x0b\x0c", 3), (b".,;:?'\"-", 4), (b"()[]{}<>|/\\=", 6)):
        table[np.frombuffer(chars, np.uint8)] = k
    table[128:] = 7
    return table


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each line, its length in bytes + 1, number of lines of each text)."""
    raw = [t.encode() + b"\n" for t in texts]
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.r_[0, ends[:-1] + 1]
    text_ends = np.cumsum([len(r) for r in raw])
    doc = np.searchsorted(text_ends, starts, side="right")
    lines = np.bincount(doc, minlength=len(texts))
    size = (ends - starts + 1).astype(np.float64)
    kind = _class_table()[buffer]
    share = [np.add.reduceat(kind == k, starts, dtype=np.int32) / size for k in range(CLASSES - 1)]
    inside = (kind != 3) & (buffer != 10)
    word_start = inside & ~np.r_[False, inside[:-1]]
    words = np.add.reduceat(word_start, starts, dtype=np.int32).astype(np.float64)
    letters = np.add.reduceat(inside, starts, dtype=np.int32)
    first_kind = kind[np.minimum(starts, len(buffer) - 1)]
    # Mark at the end of a word: how many words end in something else than a letter or a stop.
    word_end = inside & ~np.r_[inside[1:], False]
    odd_end = np.add.reduceat(word_end & ((kind == 5) | (kind == 6)), starts, dtype=np.int32) / np.maximum(words, 1)
    short = letters / np.maximum(words, 1)
    # Words equal to the word before them in the line.
    at, _, symbol = word_symbols(buffer)
    again = np.r_[False, symbol[1:] == symbol[:-1]] if len(at) else np.zeros(0, bool)
    in_line = np.searchsorted(ends, at)
    again &= np.r_[False, in_line[1:] == in_line[:-1]] if len(at) else again
    stutter = np.bincount(in_line, weights=again, minlength=len(ends)) / np.maximum(words, 1)
    # A line that stands more than once in its text.
    hashed = Hasher(np.arange(1, 257, dtype=np.uint64)[buffer] * np.uint64(0xD6E8FEB86659FD93)).of(starts, ends)
    _, which, times = np.unique(np.stack([doc.astype(np.uint64), hashed]), axis=1, return_inverse=True, return_counts=True)
    repeat = (times[which.ravel()] > 1) & (size > 1)
    own = np.stack(
        [*share, np.log1p(size) / 5, np.log1p(words) / 4, np.minimum(short, 30) / 10, odd_end, stutter, repeat,
         first_kind == 1, words <= 2, size <= 1], axis=1,
    ).astype(np.float32)
    first = np.r_[True, doc[1:] != doc[:-1]] if len(doc) else np.zeros(0, bool)
    last = np.r_[first[1:], True] if len(doc) else first
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    edge = np.stack([first, last, np.ones(len(doc))], axis=1).astype(np.float32)
    return np.concatenate([own, before, after, edge], axis=1), size, lines


def forward_backward(score: np.ndarray, lines: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginal of good per line, expected label pairs per text as (texts, 2, 2)).

    ``score`` is the score of good against bad per line, texts one after the
    other; all texts take a step together, the longest first.
    """
    order = np.argsort(-lines, kind="stable")
    first = (np.cumsum(lines) - lines)[order]
    n = lines[order]
    steps = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(1, steps + 1), side="right")  # texts with more than t lines
    s = np.clip(score, -30, 30)
    shift = np.maximum(s, 0)
    emit = np.stack([np.exp(-shift), np.exp(s - shift)], axis=1)
    move = np.exp(trans)
    alpha, marginal = np.empty((len(score), 2)), np.empty((len(score), 2))
    for t in range(steps):
        at = first[: alive[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ move) * emit[at]
        alpha[at] = a / a.sum(axis=1, keepdims=True)
    beta = np.ones((len(n), 2))
    pairs = np.zeros((len(n), 2, 2))
    for t in range(steps - 1, -1, -1):
        k = alive[t]
        at = first[:k] + t
        m = alpha[at] * beta[:k]
        marginal[at] = m / m.sum(axis=1, keepdims=True)
        if t:
            back = emit[at] * beta[:k]
            joint = alpha[at - 1][:, :, None] * move * back[:, None, :]
            pairs[:k] += joint / joint.sum(axis=(1, 2), keepdims=True)
            b = back @ move.T
            beta[:k] = b / b.sum(axis=1, keepdims=True)
    out = np.empty_like(pairs)
    out[order] = pairs
    return marginal[:, 1], out


def fit(texts: list[str], good: np.ndarray, rounds: int = 150, ridge: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights that make the labels of the texts' lines likeliest; every text weighs the same."""
    x, _, lines = line_features(texts)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    mean[-1], std[-1] = 0, 1
    x = ((x - mean) / std).astype(np.float64)
    y = np.repeat(good, lines)
    weight = np.repeat(1 / lines, lines)
    params = np.zeros(x.shape[1] + 4)
    told = np.zeros((len(texts), 2, 2))
    told[np.arange(len(texts)), good, good] = lines - 1
    m, v = np.zeros_like(params), np.zeros_like(params)
    for t in range(1, rounds + 1):
        w, trans = params[:-4], params[-4:].reshape(2, 2)
        p, pairs = forward_backward(x @ w, lines, trans)
        g_w = x.T @ (weight * (y - p))
        g_t = ((told - pairs) / lines[:, None, None]).sum(axis=0).ravel()
        g = np.r_[g_w, g_t] / len(texts) - ridge * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    # A chain that only ever sees equal labels would let one line decide for all.
    return {"w": params[:-4], "trans": np.clip(params[-4:].reshape(2, 2), -1.0, 1.0), "mean": mean, "std": std}


def score_texts(model: dict[str, np.ndarray], texts: list[str]) -> list[float]:
    x, size, lines = line_features(texts)
    p, _ = forward_backward(((x - model["mean"]) / model["std"]) @ model["w"], lines, model["trans"])
    at = np.cumsum(lines) - lines
    return (np.add.reduceat(p * size, at) / np.add.reduceat(size, at)).tolist()


def training_sample(docs: DataFrame, labels: DataFrame, sample: int, sample_chars: int) -> tuple[list[str], np.ndarray]:
    """At most ``sample`` texts with their labels."""
    told = labels.select(F.col("doc_id").cast("long").alias("d"), F.col("quality").cast("double").alias("q")).dropna()
    told = told.groupBy("d").agg(F.min("q").alias("q"), F.max("q").alias("q_max")).filter("q = q_max AND q IN (0, 1)")
    held = docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").cast("string").alias("t"))
    held = held.filter(F.col("t").isNotNull() & (F.length("t") <= sample_chars))
    chosen = told.orderBy(F.xxhash64("d"), "d").limit(sample)
    rows = held.join(F.broadcast(chosen), "d").select("d", "q", "t").dropDuplicates(["d"]).collect()
    rows.sort(key=lambda r: r["d"])
    return [r["t"] for r in rows], np.array([int(r["q"]) for r in rows], np.int64)


def quality_score(text: Column, model: dict[str, np.ndarray] | None) -> Column:
    if model is None:
        return F.lit(0.5)

    @F.pandas_udf("double")
    def scored(batch: pd.Series) -> pd.Series:
        out: list[float] = []
        for run in chunks([t or "" for t in batch], len, CHUNK_CHARS):
            out += score_texts(model, run)
        return pd.Series(out, dtype="float64")

    return scored(text.cast("string"))


def train(docs: DataFrame, labels: DataFrame, sample: int = 2000, sample_chars: int = 20_000) -> dict | None:
    """The fitted field, or None if the sample lacks one of the two labels."""
    texts, good = training_sample(docs, labels, sample, sample_chars)
    return fit(texts, good) if len(set(good.tolist())) == 2 else None


def held_out(doc_id: Column) -> Column:
    """The fifth of the ids that never teaches."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
