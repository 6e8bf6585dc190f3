"""Operator 8: WARC archives, written by Spark and read back by a salvage reader.

Writing: tasks turn records into bytes and gather them into archives of a bounded size,
each record a gzip member of its own; Spark's text writer puts every archive into
one file, so any file system that Spark knows will do and a lost task is just run again.

Reading: from the start of an archive a record is read (a gzip member, or plain from a
version line on) and checked: version line, header block, length, end of record and,
for responses, the payload's digest. After a failed check the reader searches for the next
valid member or version line, goes on there, and logs the bytes in between as a gap. Members of several
records are searched in the same way.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._work import new_path, settled

#: Bytes of an archive, about: it is closed by the record that reaches them.
ARCHIVE_BYTES = 8 << 20
#: Bounds of what is read as one: a record's headers, a name in a gzip header, what a member inflates to (larger ones are damage).
HEADER_BYTES, NAME_BYTES, MEMBER_BYTES = 1 << 16, 1 << 10, 1 << 28
VERSION = b"WARC/1.1"
_VERSION_LINE = re.compile(rb"WARC/1\.[01]\r\n")
_END = b"\r\n\r\n"
_GZIP = b"\x1f\x8b\x08"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, object]], block: bytes, compress: bool = True) -> bytes:
    """One record: headers without a value are left out; line breaks in values become spaces."""
    lines = [VERSION, *(f"{k}: {re.sub(r'[\r\n]+', ' ', str(v))}".encode() for k, v in [*headers, ("Content-Length", len(block))] if v is not None)]
    raw = b"\r\n".join(lines) + _END + block + _END
    return gzip.compress(raw, 6, mtime=0) if compress else raw


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, record_type, refers_to): of records with equal payloads of ``min_bytes`` at least, those with the largest id are responses, others revisit it.

    Payloads are UTF-8 bytes; null is empty. They are grouped by their SHA-256 and length, ids pre-aggregated. Only payloads that come several times are joined back; while
    these are too many to be broadcast, pages travel with the digest, and Spark splits the partitions of a frequent one. Null
    ids are smaller than others; a group of null ids only is all response.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("hash", F.concat(F.sha2("payload", 256), F.octet_length("payload").cast("string")))
    first = rows.groupBy("hash").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1")
    out = rows.join(settled(first.select("hash", "first"), "payloads"), "hash", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first")) & (F.octet_length("payload") >= min_bytes)
    return out.select("id", "url", "payload", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write rows (id, url, payload, record_type, refers_to) as .gz archives under ``path``; revisits carry no payload but its digest and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for id_, url, payload, kind, refers in zip(*(batch.column(c) for c in ("id", "url", "payload", "record_type", "refers_to"))):
                payload, id_, refers = payload.as_py(), id_.as_py(), refers.as_py()
                revisit = kind.as_py() == "revisit"
                headers = [
                    ("WARC-Type", kind.as_py()), ("WARC-Record-ID", None if id_ is None else f"<urn:page:{id_}>"), ("WARC-Date", date), ("WARC-Target-URI", url.as_py()),
                    ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("X-Payload-Length", len(payload)), ("WARC-Profile", REVISIT_PROFILE if revisit else None),
                    ("WARC-Refers-To", f"<urn:page:{refers}>" if revisit else None), ("Content-Type", "text/html; charset=utf-8"),
                ]
                held.append(record_bytes(headers, b"" if revisit else payload))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

    archives = records.select("id", "url", "payload", "record_type", "refers_to").mapInArrow(run, "value binary")
    archives.select(F.col("value").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _deflated(data: bytes, at: int) -> bool:
    """Whether a gzip header stands at ``at``: known flags, and fields of bounded length. Most false starts end here."""
    if at + 10 > len(data) or data[at + 3] & 0xE0:
        return False
    flags, pos = data[at + 3], at + 10
    if flags & 4:
        pos += 2 + int.from_bytes(data[pos : pos + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            pos = data.find(b"\0", pos, pos + NAME_BYTES) + 1
            if not pos:
                return False
    if flags & 2:
        if data[pos : pos + 2] != (zlib.crc32(data[at:pos]) & 0xFFFF).to_bytes(2, "little"):
            return False
        pos += 2
    return pos < len(data) and data[pos] & 6 != 6  # 3 is no kind of block


def _member(data: bytes, at: int, step: int = 1 << 16) -> tuple[bytes, int | None]:
    """What the gzip member at ``at`` holds, and where it ends; the end is None if it is damaged, cut off or larger than ``MEMBER_BYTES``, and the bytes are those before that."""
    if not _deflated(data, at):
        return b"", None
    d, out, pos, view, left = zlib.decompressobj(31), [], at, memoryview(data), MEMBER_BYTES
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(view[pos : pos + step], left))
            left -= len(out[-1])
            if left <= 0 or d.unconsumed_tail:
                return b"".join(out), None
            pos += step
    except zlib.error:
        return _member(data, at, 64) if step > 64 else (b"".join(out), None)
    return b"".join(out), min(pos, len(data)) - len(d.unused_data) if d.eof else None


def _same_digest(said: str, content: bytes) -> bool:
    """Whether a digest header fits; kinds other than SHA-1 are not checked."""
    kind, _, value = said.partition(":")
    return kind.lower() != "sha1" or value.upper() == base32_sha1(content) or value.lower() == hashlib.sha1(content).hexdigest()


def _length(said: str) -> int | None:
    return int(said) if re.fullmatch("[0-9]{1,18}", said) else None


def _record(raw: bytes, at: int) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, payload, end) of the plain record at ``at``, if version, headers, length, end and digests hold.

    The payload of an HTTP message is its body, of other records their block; a payload digest may be that of the block, too.
    """
    version = _VERSION_LINE.match(raw, at)
    if not version:
        return None
    headers, name, at = {}, "", version.end()
    while True:  # line by line: what is no header is found without reading on
        stop = raw.find(b"\r\n", at, version.end() + HEADER_BYTES)
        if stop < 0:
            return None
        line, at = raw[at:stop], stop + 2
        if not line:
            break
        if line[:1] in (b" ", b"\t") and name:  # a header goes on
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            return None
        name = key.strip().decode("utf-8", "replace").lower()
        headers[name] = value.strip().decode("utf-8", "replace")
    size = _length(headers.get("content-length", ""))
    if size is None:
        return None
    start = at
    end = start + size
    if raw[end : end + 4] != _END:
        return None
    block = payload = raw[start:end]
    if headers.get("content-type", "").lower().startswith("application/http"):
        head = block.find(_END)
        payload = block[head + len(_END) :] if head >= 0 else b""
    if not _same_digest(headers.get("warc-block-digest", ""), block):
        return None
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and not (_same_digest(said, payload) or _same_digest(said, block)):
        return None
    return headers, payload, end + 4


Found = tuple[str, int, int, int | None, dict[str, str] | None, bytes | None]


def _within(raw: bytes, start: int, end: int) -> Iterator[Found]:
    """Records of a member's bytes and the gaps between them, at their places in the member."""
    at, bad = 0, None
    while at < len(raw):
        found = _record(raw, at)
        if found or raw[at : at + 1] in (b"\r", b"\n") and bad is None:
            if bad is not None:
                yield "gap", start, end, bad, None, None
                bad = None
            if found:
                yield "record", start, end, at, found[0], found[1]
            at = found[2] if found else at + 1
            continue
        bad = at if bad is None else bad
        after = _VERSION_LINE.search(raw, at + 1)
        at = after.start() if after else len(raw)
    if bad is not None:
        yield "gap", start, end, bad, None, None


def salvage(data: bytes) -> Iterator[Found]:
    """Yield (kind, start, end, within, headers, payload) of an archive's records and gaps, in order.

    Every byte is in a record, a gap or a line break between records. ``within`` is the place in the bytes of the gzip member from start to end, null for
    plain records and for gaps of the archive itself. What a damaged member holds up to its damage is recovered, too; its bytes are a gap all the same.
    """
    at, bad, n = 0, None, len(data)
    starts = re.compile(re.escape(_GZIP) + rb"|" + _VERSION_LINE.pattern)
    while at < n:
        found: list[Found] = []
        end = None
        if data.startswith(_GZIP, at):
            raw, end = _member(data, at)
            found = list(_within(raw, at, n if end is None else end))
            if end is None:
                found = [f for f in found if f[0] == "record"]
            elif not any(f[0] == "record" for f in found):
                end = None if raw.strip(b"\r\n") else end
                found = []
        elif r := _record(data, at):
            found, end = [("record", at, r[2], None, r[0], r[1])], r[2]
        if end is not None:
            if bad is not None:
                yield "gap", bad, at, None, None, None
                bad = None
            yield from found
            at = end
            continue
        if bad is None and data[at : at + 1] in (b"\r", b"\n"):
            at += 1
            continue
        yield from found
        bad = at if bad is None else bad
        after = starts.search(data, at + 1)
        at = after.start() if after else n
    if bad is not None:
        yield "gap", bad, n, None, None, None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, start, end, within, kind, record_id, uri, record_type, refers_to, payload_digest, payload_bytes, payload) of all archives under ``path``.

    kind is record, or gap with the places only: the log of quarantined bytes (see ``salvage``). The payload of a revisit is null.
    Each archive is one file of a bounded size and is read whole by one task.
    """
    schema = "archive string, start long, end long, within long, kind string, record_id string, uri string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = pa.schema([("archive", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("within", pa.int64()), ("kind", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), target)], schema=target)
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                rows = []
                for kind, start, end, within, h, payload in salvage(content.as_py()):
                    if h is None:
                        rows.append((name, start, end, within, kind, *[None] * 7))
                    else:
                        revisit = h.get("warc-type") == "revisit"
                        length = _length(h.get("x-payload-length", ""))
                        length = length if length is not None or revisit else len(payload)
                        rows.append((name, start, end, within, kind, h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-type"), h.get("warc-refers-to"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, length, None if revisit else payload))
                    if len(rows) >= 256:
                        yield out(rows)
                        rows = []
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


def archived(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and return what the salvage reader finds there (see ``read_archives``).

    An empty table writes no archive and gives an empty frame. Other columns are not read.
    """
    spark = pages.sparkSession
    path = new_path(spark, "archives")
    write_archives(plan_records(pages, min_bytes=min_bytes, **columns), path)
    return read_archives(spark, path)
