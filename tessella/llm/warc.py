"""WARC archives under Zstandard: a writer, and a reader that validates what it decodes.

An archive begins with a skippable frame (magic 0x184D2A5D) that holds the dictionary, plain or itself compressed; each
record after it is one frame that was compressed with the dictionary. The reader decodes frame by frame, a small block of
the file at a time, checks version line, required headers, Content-Length, the record's end and payload digests, and raises
WarcError with the archive and the place otherwise. Tasks write archives of bounded size under names of their own, and
only archives of tasks that succeeded are in the manifest that the reader goes by; those of failed attempts stay unread. A dictionary of more
than 64 MB is refused on reading, so that a broken archive can't fill the memory.

Cases: null html is an empty payload; a null url has no WARC-Target-URI; control characters of a url are percent-encoded; a very long page is
one record, and one archive; of equal payloads under the same largest page_id the row with the largest number is the response; rows that
repeat a page_id are records of their own; a null page_id is kept; an empty table writes nothing and reads back empty; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import materialise, scratch_path, with_rows

DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 8 << 10
SAMPLE_BYTES = 128 << 10
BLOCK = 64 << 10
DATE = "1970-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")


class WarcError(ValueError):
    """An archive that breaks the format."""


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None = None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head only, whose Content-Length still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if kind == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for records like the samples; their own bytes where too few are there to train one."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:] or b"WARC/1.1\r\nWARC-Type: response\r\n"


def write_archive(out: BinaryIO, records: list[bytes], level: int = 3) -> int:
    """Writes the dictionary frame and a frame a record; returns the bytes written."""
    import zstandard

    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r[:BLOCK])
        size += len(samples[-1])
    raw = dictionary(samples)
    packed = zstandard.ZstdCompressor(level=level).compress(raw)
    written = out.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
    for r in records:
        written += out.write(press.compress(r))
    return written


def read_frames(source: BinaryIO) -> Iterator[tuple[int, bytes]]:
    """(number, bytes) of each record of an archive."""
    import zstandard

    head = source.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICTIONARY_FRAME:
        raise WarcError("no dictionary frame at the start")
    size = struct.unpack("<I", head[4:])[0]
    raw = source.read(size)
    if len(raw) < size:
        raise WarcError("the dictionary frame is cut off")
    if raw[:4] == b"\x28\xb5\x2f\xfd":
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=64 << 20)
    unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    rest, number = b"", 0
    while True:
        rest = rest or source.read(BLOCK)
        if not rest:
            return
        frame, parts = unpress.decompressobj(), []
        while True:
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame {number}: {e}") from e
            if frame.eof:
                rest = frame.unused_data
                break
            rest = source.read(BLOCK)
            if not rest:
                raise WarcError(f"frame {number} is cut off")
        yield number, b"".join(parts)
        number += 1


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record, validated."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line or no end of the headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"not a header: {line[:80]}")
        headers[name.lower()] = value.strip()
    missing = [h for h in REQUIRED if h not in headers]
    if missing:
        raise WarcError(f"missing headers: {', '.join(missing)}")
    if not headers["content-length"].isdigit():
        raise WarcError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise WarcError(f"Content-Length says {n}; the record has {len(rest) - 4}")
    return headers, rest[:n]


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """Length of the full payload, and the payload if the record holds it; checks length and digest."""
    head, mark, body = block.partition(b"\r\n\r\n")
    told = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head)
    if not mark or not told:
        raise WarcError("no HTTP head with a Content-Length")
    n = int(told[1])
    if headers["warc-type"] == "revisit":
        if body:
            raise WarcError("a revisit holds a payload")
        return n, None
    if len(body) != n:
        raise WarcError(f"the HTTP head says {n} bytes; the payload has {len(body)}")
    if headers.get("warc-payload-digest") not in (None, f"sha1:{payload_digest(body)}"):
        raise WarcError("the payload's digest differs")
    return n, body


def _urn(page_id: int | None) -> str:
    return f"urn:tessella:page:{'' if page_id is None else page_id}"


def _page(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:tessella:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def planned(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, refers_to, revisit: of equal payloads of at least min_bytes that with the largest page_id is the response."""
    rows = with_rows(pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")), "page_id")
    keys = rows.select("_row", "page_id", F.sha1("html").alias("_digest"), F.octet_length("html").alias("_bytes"))
    last = keys.groupBy("_digest").agg(F.max(F.struct("page_id", "_row")).alias("last"))
    revisit = (F.col("_bytes") >= min_bytes) & (F.col("last._row") != F.col("_row"))
    # only digests meet under a hot digest; the pages themselves are dealt by number
    told = keys.join(last, "_digest").select("_row", F.col("last.page_id").alias("refers_to"), revisit.alias("revisit"))
    return rows.join(told, "_row").select("page_id", "url", "html", "refers_to", "revisit")


def write(plan: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the planned records into archives of about archive_bytes (before compression); returns their manifest: path, records, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            store, base = fs.FileSystem.from_uri(folder)
            store.create_dir(base, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{base}/{name}") as out:
                n = write_archive(out, held)
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": pa.array([len(held)], pa.int64()), "bytes": pa.array([n], pa.int64())})

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")]
            for page_id, url, html, refers_to, revisit in zip(*columns, strict=True):
                payload = html.as_py().encode("utf-8", "surrogatepass")
                of = _urn(refers_to.as_py()) if revisit.as_py() else None
                held.append(record("revisit" if of else "response", _urn(page_id.as_py()), url.as_py(), payload, payload_digest(payload), of))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return materialise(plan.mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload of every record of the archives."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist(), strict=True):
                store, place = fs.FileSystem.from_uri(path)
                rows, size, seen = [], 0, 0
                with store.open_input_stream(place) as source:
                    for number, data in read_frames(source):
                        try:
                            headers, block = parse_record(data)
                            n, payload = payload_of(headers, block)
                        except (WarcError, UnicodeDecodeError) as e:
                            raise WarcError(f"{path}, record {number}: {e}") from e
                        digest = headers["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in headers else payload_digest(payload or b"")
                        rows.append((_page(headers["warc-record-id"]), headers.get("warc-target-uri"), n, digest, headers["warc-type"], _page(headers.get("warc-refers-to")), payload))
                        size, seen = size + len(data), seen + 1
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                if seen != expected:
                    raise WarcError(f"{path}: {seen} records; the manifest has {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = manifest.select("path", "records")
    return files.repartition(manifest.sparkSession.sparkContext.defaultParallelism * 2, F.xxhash64("path")).mapInArrow(run, schema)


def op9_warc(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes all pages into archives and reads them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    manifest = write(planned(pages, min_bytes), scratch_path(pages.sparkSession, "warc"))
    return read(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
