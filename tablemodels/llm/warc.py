"""WARC archives: a writer with revisit records and a reader that salvages damaged files.

Every record is a gzip member of its own with digests of its block and payload.
The reader checks each record (member checksum, version line, header, length,
closing lines, block digest if its algorithm is known). Where a check fails it
looks for the next member or version line from which a whole record can be read,
goes on there, and reports the bytes in between as a quarantined gap with the
reason. The same is done inside a member of many records; of a damaged member
the whole records before the damage are kept, if it is not just cut off only
those whose digest was checked.

Nulls: a null payload is empty, a null url or id is left out of the header and
comes back null. Equal payloads of at least ``revisit_bytes`` bytes are stored
once, with the smallest id; rows that repeat that id are responses too, rows
without an id are revisits of it. Empty tables give no archive and no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemodels.llm.common import attempt_id, fresh_folder, partition_id, saved, write_whole

ARCHIVE_BYTES = 32_000_000
REVISIT_BYTES = 100
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
MEMBER = b"\x1f\x8b\x08"
DIGESTS = {"sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512",
           "md5": "md5"}
SLICE = 1 << 14  # bytes handed to the unpacker at once
CUT_OFF = "gzip member is cut off"
VERSIONS = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")

READ_SCHEMA = (
    "archive string, kind string, first_byte long, end_byte long, reason string, page_id long, url string, "
    "record_type string, refers_to long, stated_bytes long, stated_digest string, payload binary"
)


def with_record_types(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, digest, record_type, refers_to)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= revisit_bytes)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    # Written, so that the join can split the rows of a common payload.
    firsts = saved(firsts.select(F.col("digest").alias("key"), "first"), "first-pages")
    # Short payloads are never looked up and keep apart.
    key = F.when(F.octet_length("payload") >= revisit_bytes, F.col("digest"))
    key = F.coalesce(key, F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    joined = rows.withColumn("key", key).join(firsts, "key", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        "page_id", "url", "payload", "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"),
    )


def record_bytes(page_id, url, payload: bytes, digest: str, record_type: str, refers_to) -> bytes:
    """One uncompressed record; a revisit keeps the head of its response only."""
    block = HEAD if record_type == "revisit" else HEAD + payload
    lines = ["WARC/1.1", f"WARC-Type: {record_type}"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    if record_type == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += [
        f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


def write_warc(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> tuple[str, DataFrame]:
    """Archives of the rows of ``with_record_types`` below a shared folder, and (archive, records)."""
    folder = fresh_folder(rows.sparkSession, "warc")

    def write(batches):
        part, attempt, names, held, size = partition_id(), attempt_id(), [], [], 0

        def flush():
            nonlocal held, size
            name = f"part-{part:07d}-{len(names):06d}.warc.gz"
            write_whole(folder, name, b"".join(held), attempt)
            names.append((name, len(held)))
            held, size = [], 0

        for batch in batches:
            for row in zip(*batch.columns):
                data = member(record_bytes(*(v.as_py() for v in row)))
                held.append(data)
                size += len(data)
                if size >= archive_bytes:
                    flush()
        if held:
            flush()
        columns = list(zip(*names)) if names else [(), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64())], ["archive", "records"]
        )

    # A task that is repeated must write the same files.
    ordered = rows.sortWithinPartitions("page_id", "digest", "url")
    return folder, saved(ordered.mapInArrow(write, "archive string, records long"), "warc-manifest")


class Broken(ValueError):
    """A check of a record failed."""


def _digest_holds(stated: str, block: bytes) -> bool | None:
    """Whether a digest (hexadecimal or base32) is that of the block; None if its algorithm is not known."""
    name, _, value = stated.partition(":")
    if name.strip().lower() not in DIGESTS:
        return None
    own, value = hashlib.new(DIGESTS[name.strip().lower()], block).digest(), value.strip()
    if len(value) == 2 * len(own):
        return value.lower() == own.hex()
    try:
        return base64.b32decode(value.rstrip("=") + "=" * (-len(value.rstrip("=")) % 8), casefold=True) == own
    except (binascii.Error, ValueError):
        return False


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(fields, end) of the record that starts at ``at``; raises Broken."""
    if not data.startswith(VERSIONS, at):
        raise Broken("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Broken("no end of header")
    try:
        header = data[at:end].decode()
    except UnicodeDecodeError:
        raise Broken("header is not text") from None
    fields, name = {}, None
    for line in header.split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name is not None:  # a folded line goes on with the value before it
            fields[name] += " " + line.strip(" \t")
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Broken("header line without a value")
        name = name.strip(" \t").lower()
        # Addresses are written as they are, after one space.
        fields[name] = value.removeprefix(" ") if name == "warc-target-uri" else value.strip(" \t")
    size = fields.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise Broken("no length")
    first, last = end + 4, end + 4 + int(size)
    if data[last : last + 4] != b"\r\n\r\n":
        raise Broken("length does not lead to the end of a record")
    block = data[first:last]
    stated = fields.get("warc-block-digest")
    holds = None if stated is None else _digest_holds(stated, block)
    if holds is False:
        raise Broken("block digest differs")
    fields["block"], fields["checked"] = block, holds is True
    return fields, last + 4


def _decoded(data: bytes, at: int) -> tuple[bytes, int, str]:
    """(bytes, end, damage) of the gzip member that starts at ``at``; the bytes before the damage, if there is any."""
    # In slices: what follows the member is copied by the unpacker, which must not be the whole rest.
    unpacker, parts, end = zlib.decompressobj(31), [], at
    try:
        while end < len(data) and not unpacker.eof:
            parts.append(unpacker.decompress(data[end : end + SLICE]))
            end = min(end + SLICE, len(data))
        return b"".join(parts), end - len(unpacker.unused_data), "" if unpacker.eof else CUT_OFF
    except zlib.error:
        pass
    unpacker, parts, step = zlib.decompressobj(31), [], SLICE
    while at < len(data):
        before = unpacker.copy()
        try:
            parts.append(unpacker.decompress(data[at : at + step]))
            at += step
        except zlib.error:
            if step == 1:
                break
            unpacker, step = before, max(1, step // 16)
    return b"".join(parts), len(data), "gzip member is damaged"


def _plain_records(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of bytes that are not zipped."""
    at, gap, why = 0, None, ""
    while at < len(data):
        try:
            record, end = parse_record(data, at)
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            at = min((f for f in (data.find(v, at + 1) for v in VERSIONS) if f >= 0), default=len(data))
            continue
        if gap is not None:
            yield "gap", gap, at, why
            gap = None
        yield "record", at, end, record
        at = end
    if gap is not None:
        yield "gap", gap, len(data), why


def _member_records(data: bytes, at: int) -> tuple[list[tuple[str, object]], int, str]:
    """Records and gaps of a member, its end, and its damage; raises Broken if no record of it is sound."""
    out, end, damage = _decoded(data, at)
    found = []
    for kind, first, last, what in _plain_records(out):
        if kind == "gap":
            found.append((kind, what if damage else f"{what} (bytes {first} to {last} of the member)"))
        elif damage in ("", CUT_OFF) or what["checked"]:
            found.append((kind, what))
        else:
            found.append(("gap", damage))
    if found and not any(kind == "record" for kind, _ in found):
        raise Broken(damage or found[0][1].partition(" (bytes")[0])
    if damage:
        if not found:
            raise Broken(damage)
        found = [f for f in found if f[0] == "record"]  # the damage is reported with its bytes
    return found, end, damage


def _next_start(data: bytes, at: int) -> int:
    """Next place at which a record may start."""
    found = (data.find(start, at) for start in (MEMBER, *VERSIONS))
    return min((f for f in found if f >= 0), default=len(data))


def salvage(data: bytes) -> Iterator[tuple[str, int, int, object]]:
    """("record", start, end, fields) and ("gap", start, end, reason), covering all bytes in order.

    What a member holds has the bytes of the member. A damaged one with sound
    records gives these and then the gap, from the same byte.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        damage = ""
        try:
            if data.startswith(MEMBER, at):
                found, end, damage = _member_records(data, at)
            else:
                record, end = parse_record(data, at)
                found = [("record", record)]
        except Broken as e:
            if gap is None:
                gap, why = at, str(e)
            at = _next_start(data, at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, why
            gap = None
        if damage:
            gap, why, end = at, damage, _next_start(data, at + 1)
        for kind, what in found:
            yield kind, at, end, what
        at = end
    if gap is not None:
        yield "gap", gap, len(data), why


def _page(text: str | None) -> int | None:
    try:
        return int(text.removeprefix("<urn:page:").removesuffix(">")) if text else None
    except ValueError:
        return None


def _row(archive: str, kind: str, first: int, end: int, what) -> tuple:
    if kind == "gap":
        return (archive, kind, first, end, what) + (None,) * 7
    url = what.get("warc-target-uri")
    if url is not None:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    record_type, size = what.get("warc-type"), what.get("warc-payload-length", "")
    head, gap, body = what["block"].partition(b"\r\n\r\n")
    payload = (body if gap else what["block"]) if record_type != "revisit" else None
    return (
        archive, kind, first, end, None, _page(what.get("warc-record-id")), url, record_type,
        _page(what.get("warc-refers-to")), int(size) if size.isdigit() else None,
        what.get("warc-payload-digest", "").removeprefix("sha256:") or None, payload,
    )


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every record and every quarantined gap of the archives (``*.warc`` and ``*.warc.gz``) of a folder."""

    def read(batches):
        import pyarrow as arrow

        types = [arrow.string(), arrow.string(), arrow.int64(), arrow.int64(), arrow.string(), arrow.int64(),
                 arrow.string(), arrow.string(), arrow.int64(), arrow.int64(), arrow.string(), arrow.binary()]
        names = [c.split()[0] for c in READ_SCHEMA.split(", ")]

        def batch_of(rows):
            return arrow.RecordBatch.from_arrays([arrow.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for found in salvage(content.as_py()):
                    rows.append(_row(path.rsplit("/", 1)[-1], *found))
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{warc,warc.gz}").load(folder)
    return files.select("path", "content").mapInArrow(read, READ_SCHEMA)
