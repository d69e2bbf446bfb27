"""WARC archives compressed record by record with zstandard, with a dictionary in the leading skippable frame.

File layout: a skippable frame (magic 0x184D2A5D) holding the dictionary, then one zstandard frame per record. The reader
loads the dictionary first, decodes one frame at a time and validates every record: version line, mandatory headers,
Content-Length, the payload's length and digest, and the closing blank lines.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, new_file, open_file, out_dir, shuffle_partitions

#: Fixed values of the format.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
MANDATORY = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A file's dictionary is trained on its first records: at most so many, and so many bytes of each.
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 64, 4096, 16 * 1024
CHUNK = 1 << 20
_ID = "<urn:x-page:{}>"


class BadRecord(ValueError):
    """An archive that does not hold what its headers say."""


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, mark: str = "", date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC record: a response with its payload, or a revisit of page ``refers_to`` without.

    ``mark`` sets the record's id apart from others of its page; a response that revisits refer to has none.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:x-page:{page_id}"
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _ID.format(f"{page_id}:{mark}" if mark else page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        *([("WARC-Profile", PROFILE), ("WARC-Refers-To", _ID.format(refers_to))] if revisit else []),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in headers).encode("utf-8")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A dictionary for records like ``samples``: trained, or empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to ``stream``; memory holds the first ``SAMPLES`` records until the dictionary is trained."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.level, self.held, self.compressor, self.records = stream, level, [], None, 0

    def _start(self) -> None:
        trained = dictionary([r[:SAMPLE_BYTES] for r in self.held])
        self.stream.write(struct.pack("<II", SKIPPABLE, len(trained)) + trained)
        kind = zstandard.ZstdCompressionDict(trained) if trained else None
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=kind, write_checksum=True, write_content_size=True)
        for r in self.held:
            self.stream.write(self.compressor.compress(r))
        self.held = []

    def add(self, one: bytes) -> None:
        self.records += 1
        if self.compressor is None:
            self.held.append(one)
            if len(self.held) >= SAMPLES:
                self._start()
        else:
            self.stream.write(self.compressor.compress(one))

    def close(self) -> None:
        if self.compressor is None:
            self._start()
        self.stream.close()


def frames(stream) -> Iterator[bytes]:
    """The decoded frames of an archive, one at a time; memory holds one frame and one chunk."""
    head = stream.read(8)
    if len(head) < 8:
        raise BadRecord("no leading frame")
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise BadRecord("the file does not begin with a dictionary frame")
    raw = stream.read(size)
    if len(raw) != size:
        raise BadRecord("the dictionary is cut short")
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary itself may be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=1 << 24)
    decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    data = b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        one, parts = decompressor.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            data = stream.read(CHUNK)
            if not data:
                raise BadRecord("the last frame is cut short")
        yield b"".join(parts)


def read_record(one: bytes) -> dict:
    """Parses and validates a record: ``type``, ``page_id``, ``refers_to``, ``payload_bytes``, ``digest``, ``url``, ``payload``.

    Header names count in any case. Records of other types than response and revisit have their block as the payload, and no
    HTTP header is asked of them; a digest that is not given or not SHA-1 in hexadecimal is not compared with such a payload.
    """
    head, found, rest = one.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not found or lines[0] not in (b"WARC/1.0", VERSION):
        raise BadRecord("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("a header without a colon")
        headers[name.decode().strip().lower()] = value.decode().strip()
    if missing := [m for m in MANDATORY if m.lower() not in headers]:
        raise BadRecord(f"missing {', '.join(missing)}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord("the block's length is not Content-Length")
    block, kind = rest[:-4], headers["warc-type"].lower()
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    number = lambda x: int(m[1]) if x and (m := re.fullmatch(r"<urn:x-page:(-?\d+)(?::[\d.]+)?>", x)) else None
    found = {"page_id": number(headers["warc-record-id"]), "type": kind, "refers_to": number(headers.get("warc-refers-to")), "url": headers.get("warc-target-uri")}
    if kind not in ("response", "revisit"):
        own = hashlib.sha1(block).hexdigest()
        if re.fullmatch("[0-9a-f]{40}", digest) and digest != own:
            raise BadRecord("the payload is not what its digest says")
        return found | {"payload_bytes": len(block), "digest": own, "payload": block}
    http, end, payload = block.partition(b"\r\n\r\n")
    size = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
    if not end or not http.startswith(b"HTTP/") or not size:
        raise BadRecord("no HTTP header in the block")
    if kind == "response" and (len(payload) != int(size[1]) or hashlib.sha1(payload).hexdigest() != digest):
        raise BadRecord("the payload is not what its length and digest say")
    if kind == "revisit" and (payload or "warc-refers-to" not in headers):
        raise BadRecord("a revisit with a payload or without WARC-Refers-To")
    return found | {"payload_bytes": int(size[1]), "digest": digest, "payload": payload}


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Writes a record per row of ``pages`` (``page_id``, ``url``, ``html``) and lists the files: ``path``, ``records``.

    Of rows with equal payloads of at least ``least_bytes`` bytes that with the largest page_id is the response and the others
    revisit it. Null html is an empty payload; a null page_id never is the largest, and where all are null, or rows repeat the
    largest, each is a response. Smaller payloads stay where they are; larger ones meet by digest, and those of frequent digests
    stay too (``common.lookup``). A record's id is that of its page where revisits refer to it, and else has the task and a
    number added, so ids differ but for rows that repeat such a page. Other columns are not read; an empty table gives no file.
    """
    keyed = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    keyed = keyed.withColumn("digest", F.sha1("payload"))
    # Equal digests mean equal payloads, hence equal sizes.
    large, small = keyed.where(F.length("payload") >= least_bytes), keyed.where(F.length("payload") < least_bytes)
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("rows")).where("rows > 1 AND first IS NOT NULL")
    met = lookup(large, groups, "digest", "rows", pages.count())
    to = F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))
    named = F.coalesce(F.col("first") == F.col("page_id"), F.lit(False))
    rows = met.select("page_id", "url", "payload", "digest", to.alias("refers_to"), named.alias("named"))
    rows = rows.unionByName(small.select("page_id", "url", "payload", "digest", F.lit(None).cast("long").alias("refers_to"), F.lit(False).alias("named")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, task = None, TaskContext.get()
        for batch in batches:
            for *row, named in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    path, stream = new_file(folder, ".warc.zst")
                    writer = ArchiveWriter(stream)
                writer.add(record(*row, mark="" if named else f"{task.partitionId()}.{writer.records}"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [writer.records]})

    return cut(rows.mapInArrow(run, "path string, records long"))


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the archives in ``files`` (``path``): page_id, payload_bytes, payload_digest, record_type, refers_to.

    ``payloads`` adds url and payload (null for a revisit). A record that fails validation raises ``BadRecord``.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    names = ["page_id", "payload_bytes", "digest", "type", "refers_to", "url", "payload"][: 7 if payloads else 5]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()][: len(names)]
    columns = [c.split()[0] for c in schema.split(", ")]

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        values = [[None if n == "payload" and r["type"] == "revisit" else r[n] for r in rows] for n in names]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types, strict=True)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with open_file(path) as stream:
                    for one in frames(stream):
                        rows.append(read_record(one))
                        held += len(one)
                        if len(rows) >= 2000 or held > 16 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    parts = shuffle_partitions(files.sparkSession)
    return files.select("path").repartition(parts, "path").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives to a new folder in the shared one and reads them back."""
    return read_archives(write_archives(pages, out_dir(pages.sparkSession, "warc")))
