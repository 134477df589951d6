"""Token-id shards in patched frame-of-reference blocks.

A shard is one file: a header, a table of its documents, an index with each
block's minimum, width, exception count and payload start, the bit-packed
payload and the exception lists. A block holds 128 ids less the block's
minimum, packed at the width that a given share of them needs; the rest are
kept whole as exceptions and patched in on reading.

Nulls: a null text is an empty document, a null id sorts first and stays null.
Repeated ids are separate documents, ordered by their text. An empty table
gives no shard and reads back as no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemodels.llm.common import attempt_id, fresh_folder, partition_id, saved, write_whole
from tablemodels.llm.tokens import encoder, public_path

MAGIC = b"PFORIDS1"
BLOCK = 128
SHARE = 0.9
SHARD_IDS = 2_000_000
HEADER = "<8sQQQQQ"  # magic, first id's place in the partition, documents, ids, payload bytes, exceptions
PIECE_BLOCKS = 4096  # blocks unpacked to bits at a time


def _pack_width(deltas: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 deltas as rows of 16 * width bytes."""
    bits = np.empty((len(deltas), BLOCK, width), np.uint8)
    for b in range(width):
        bits[:, :, b] = (deltas >> np.uint32(b)) & np.uint32(1)
    return np.packbits(bits.reshape(len(deltas), -1), axis=1, bitorder="little")


def _unpack_width(rows: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(rows), BLOCK, width)
    out = np.zeros((len(rows), BLOCK), np.uint32)
    for b in range(width):
        out |= bits[:, :, b].astype(np.uint32) << np.uint32(b)
    return out


def _by_width(widths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    for w in np.unique(widths):
        which = np.flatnonzero(widths == w)
        for i in range(0, len(which), PIECE_BLOCKS):
            yield int(w), which[i : i + PIECE_BLOCKS]


def pack_blocks(ids: np.ndarray, share: float = SHARE) -> tuple[bytes, bytes, bytes]:
    """(block index, payload, exceptions) of unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    padded = np.zeros(n * BLOCK, np.uint32)
    padded[: len(ids)] = ids
    if len(ids):
        padded[len(ids) :] = ids[-1]
    blocks = padded.reshape(n, BLOCK)
    least = blocks.min(axis=1) if n else np.zeros(0, np.uint32)
    deltas = blocks - least[:, None]
    need = np.frexp(deltas.astype(np.float64))[1].astype(np.uint8)
    widths = np.sort(need, axis=1)[:, int(np.ceil(share * BLOCK)) - 1] if n else np.zeros(0, np.uint8)
    outlier = need > widths[:, None]
    block, place = np.nonzero(outlier)
    exceptions = np.empty(len(block), dtype=[("place", "u1"), ("value", "<u4")])
    exceptions["place"], exceptions["value"] = place, deltas[outlier]
    deltas[outlier] = 0
    sizes = widths.astype(np.int64) * (BLOCK // 8)
    starts = np.cumsum(sizes) - sizes
    payload = np.empty(int(sizes.sum()), np.uint8)
    for w, which in _by_width(widths):
        if w:
            payload[starts[which][:, None] + np.arange(w * BLOCK // 8)] = _pack_width(deltas[which], w)
    index = np.empty(n, dtype=[("least", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u8")])
    index["least"], index["width"], index["start"] = least, widths, starts
    index["exceptions"] = outlier.sum(axis=1)
    return index.tobytes(), payload.tobytes(), exceptions.tobytes()


def unpack_blocks(index: bytes, payload: bytes, exceptions: bytes, n_ids: int) -> np.ndarray:
    index = np.frombuffer(index, dtype=[("least", "<u4"), ("width", "u1"), ("exceptions", "<u2"), ("start", "<u8")])
    payload = np.frombuffer(payload, np.uint8)
    exceptions = np.frombuffer(exceptions, dtype=[("place", "u1"), ("value", "<u4")])
    out = np.zeros((len(index), BLOCK), np.uint32)
    starts = index["start"].astype(np.int64)
    for w, which in _by_width(index["width"]):
        if w:
            out[which] = _unpack_width(payload[starts[which][:, None] + np.arange(w * BLOCK // 8)], w)
    out[np.repeat(np.arange(len(index)), index["exceptions"]), exceptions["place"]] = exceptions["value"]
    out += index["least"][:, None]
    return out.reshape(-1)[:n_ids]


def shard_bytes(first: int, doc_ids: list, counts: list[int], ids: np.ndarray) -> bytes:
    index, payload, exceptions = pack_blocks(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    docs = np.array([d if d is not None else 0 for d in doc_ids], "<i8")
    head = struct.pack(HEADER, MAGIC, first, len(doc_ids), len(ids), len(payload), len(exceptions) // 5)
    return b"".join((head, known.tobytes(), docs.tobytes(), np.array(counts, "<u8").tobytes(), index, payload, exceptions))


def read_shard(data: bytes) -> tuple[int, list, np.ndarray, np.ndarray]:
    """(place of the first id in its partition, document ids, id counts, ids)."""
    magic, first, n_docs, n_ids, n_payload, n_exceptions = struct.unpack_from(HEADER, data)
    if magic != MAGIC:
        raise ValueError("not a token shard")
    view, at, parts = memoryview(data), struct.calcsize(HEADER), []
    for size in (n_docs, 8 * n_docs, 8 * n_docs, -(-n_ids // BLOCK) * 15, n_payload, 5 * n_exceptions):
        parts.append(view[at : at + size])
        at += size
    if at != len(data):
        raise ValueError(f"token shard of {len(data)} bytes, {at} expected")
    known, docs = np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], "<i8")
    names = [int(d) if k else None for d, k in zip(docs, known)]
    return first, names, np.frombuffer(parts[2], "<u8").astype(np.int64), unpack_blocks(*parts[3:], n_ids)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> tuple[str, DataFrame]:
    """Encode whole texts in ascending order of ``doc_id`` into shards below a shared folder.

    Returns the folder and (part, n_ids): the number of ids each task wrote.
    ``tokenizer`` is the name of a public vocabulary file.
    """
    folder = fresh_folder(docs.sparkSession, "token-files")
    end = struct.pack("<I", end_id)

    def write(batches):
        words, part, attempt = encoder(public_path(tokenizer)), partition_id(), attempt_id()
        names, counts, held, size, first, number = [], [], [], 0, 0, 0

        def flush():
            nonlocal names, counts, held, size, first, number
            data = shard_bytes(first, names, counts, np.frombuffer(b"".join(held), "<u4"))
            write_whole(folder, f"part-{part:07d}-{number:07d}.pfor", data, attempt)
            first, number = first + size, number + 1
            names, counts, held, size = [], [], [], 0

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = words.ids_bytes(text.as_py()) + end
                names.append(name)
                counts.append(len(ids) // 4)
                held.append(ids)
                size += len(ids) // 4
                if size >= shard_ids:
                    flush()
        if names:
            flush()
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_ids": pa.array([first], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return folder, saved(ordered.mapInArrow(write, "part int, n_ids long"), "token-manifest")


def read_token_files(spark, folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) decoded from the shards of a folder.

    The manifest has one row per writing task, so its running sums are small.
    """
    base, total = {}, 0
    for row in manifest.orderBy("part").collect():  # one row per task
        base[row["part"]] = total
        total += row["n_ids"]

    def read(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = int(name.rsplit("/", 1)[-1].split("-")[1])
                first, docs, counts, ids = read_shard(content.as_py())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(docs, pa.int64()),
                        "start": pa.array(base[part] + first + ends - counts, pa.int64()),
                        "n_tokens": pa.array(counts, pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder)
    return files.select("path", "content").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
