"""WARC records in Zstandard archives: a dictionary in the leading skippable frame, a frame for each record."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, written

# Fixed values of the Zstandard and WARC formats.
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE_FRAMES = range(0x184D2A50, 0x184D2A60)
DATA_FRAME = 0xFD2FB528
DICTIONARY = 0xEC30A437
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Record types of the format.  Those beside response and revisit have a block of any content.
RECORD_TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")

_ID = re.compile(r"<urn:page:(-?[0-9]+)>\Z")


def payload_digest(payload: bytes) -> str:
    """Upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record.  A revisit has the HTTP header of its page, which tells the length, and no payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that starts at ``at`` ends, from its header and its blocks' lengths."""
    (magic,) = struct.unpack_from("<I", data, at)
    if magic in SKIPPABLE_FRAMES:
        end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    elif magic == DATA_FRAME:
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            word = int.from_bytes(data[end : end + 3], "little")
            last, kind, size = word & 1, word >> 1 & 3, word >> 3
            if kind == 3 or end + 3 > len(data):
                raise ValueError("bad block")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    else:
        raise ValueError(f"no frame, but {magic:08x}")
    if end > len(data):
        raise ValueError("frame is cut short")
    return end


def frames(data: memoryview) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each data frame; the dictionary comes from the leading skippable frame."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    decoder, at = plain, 0
    while at < len(data):
        end = frame_end(data, at)
        (magic,) = struct.unpack_from("<I", data, at)
        if magic == DICTIONARY_FRAME and at == 0:
            raw = bytes(data[8:end])
            if raw[:4] == struct.pack("<I", DATA_FRAME):
                raw = plain.decompress(raw)
            if raw[:4] != struct.pack("<I", DICTIONARY):
                raise ValueError("the leading frame has no dictionary")
            decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic == DATA_FRAME:
            yield at, decoder.decompressobj().decompress(data[at:end])
        at = end


@dataclass
class Record:
    """``page_id`` and ``refers_to`` are the numbers of ids that :func:`record_bytes` gives, ``record_id`` and ``refers_to_id`` any ids as they stand."""

    kind: str
    page_id: int | None
    url: str | None
    size: int
    digest: str | None
    refers_to: int | None
    payload: bytes
    record_id: str
    refers_to_id: str | None


def _headers(lines: list[str]) -> dict[str, str]:
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"bad header line {line[:60]!r}")
        out[name.lower()] = value.strip()
    return out


def _number(headers: dict[str, str], name: str) -> int:
    value = headers.get(name, "")
    if not re.fullmatch("[0-9]+", value):
        raise ValueError(f"bad {name}")
    return int(value)


def _http_payload(block: bytes) -> tuple[bytes, int | None]:
    """Payload of an HTTP message, and the length its header tells."""
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not http.startswith(b"HTTP/"):
        raise ValueError("no HTTP header")
    headers = _headers(http.decode("latin-1").split("\r\n")[1:])
    return payload, _number(headers, "content-length") if "content-length" in headers else None


def parse_record(data: bytes) -> Record:
    """A record of any type whose headers, lengths and digests hold, or ValueError.

    A response, and a revisit, has an HTTP message where its content type says
    so (or says nothing), else a plain payload; records of other types have
    their whole block as payload.  Where no payload digest is given, that of
    the payload counts; a revisit without one has none.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC header")
    warc = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date"):
        if name not in warc:
            raise ValueError(f"no {name}")
    kind = warc["warc-type"]
    if kind not in RECORD_TYPES:
        raise ValueError(f"unknown type {kind[:20]}")
    length = _number(warc, "content-length")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError("content-length does not hold")
    payload, told = rest[:length], None
    if kind in ("response", "revisit") and warc.get("content-type", "application/http").lower().startswith("application/http"):
        payload, told = _http_payload(payload)
    digest = None
    if "warc-payload-digest" in warc:
        method, _, digest = warc["warc-payload-digest"].partition(":")
        if method != "sha1" or not re.fullmatch("[A-Z2-7]{32}", digest):
            raise ValueError("bad digest")
    if kind == "revisit":
        if payload or not any(f"warc-refers-to{x}" in warc for x in ("", "-target-uri")):
            raise ValueError("a revisit has a payload or refers to nothing")
    elif (told is not None and len(payload) != told) or (kind == "response" and digest not in (None, payload_digest(payload))):
        raise ValueError("payload does not match its length and digest")
    else:
        digest = digest or payload_digest(payload)
    size = told if told is not None else len(payload)
    ids = [int(m[1]) if (m := _ID.match(warc.get(x, ""))) else None for x in ("warc-record-id", "warc-refers-to")]
    return Record(kind, ids[0], warc.get("warc-target-uri"), size, digest, ids[1], payload, warc["warc-record-id"], warc.get("warc-refers-to"))


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark would read it by, so that a path without one is not taken for a machine's own disk."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def _opened(folder: str) -> tuple[pa.fs.FileSystem, str]:
    local = re.fullmatch("file:/*(/.*)", folder)
    return (pa.fs.LocalFileSystem(), local[1]) if local else pa.fs.FileSystem.from_uri(folder)


class _Archives:
    """Writes the records of one task to archives of bounded size, each renamed when it is whole."""

    def __init__(self, folder: str, most: int, sample: int):
        import zstandard

        self.zstd, self.most, self.sample = zstandard, most, sample
        self.fs, self.root = _opened(folder)
        context = TaskContext.get()
        self.part, self.attempt = context.partitionId(), context.taskAttemptId()
        self.waiting: list[bytes] = []
        self.held, self.count, self.file, self.done = 0, 0, None, []
        self.encoder, self.lead = None, b""

    def add(self, record: bytes) -> None:
        if self.encoder is None:
            self.waiting.append(record)
            self.held += len(record)
            if self.held >= self.sample:
                self._start()
        else:
            self._put(record)

    def _start(self) -> None:
        """The dictionary is trained on the first records of the task, ``sample`` bytes of them."""
        options = {"level": 3, "write_content_size": True, "write_checksum": True}
        try:
            trained = self.zstd.train_dictionary(16 << 10, [x[:4096] for x in self.waiting])
            raw = trained.as_bytes()
            self.lead = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
            self.encoder = self.zstd.ZstdCompressor(dict_data=trained, **options)
        except self.zstd.ZstdError:  # too few records to train on: an archive without dictionary
            self.encoder = self.zstd.ZstdCompressor(**options)
        for x in self.waiting:
            self._put(x)
        self.waiting = []

    def _put(self, record: bytes) -> None:
        if self.file is None:
            self.fs.create_dir(self.root, recursive=True)
            self.name = f"{self.root}/part-{self.part:06d}-{len(self.done):05d}.warc.zst"
            self.temporary = f"{self.root}/_{self.part:06d}-{self.attempt}.tmp"
            self.file, self.size = self.fs.open_output_stream(self.temporary), len(self.lead)
            self.file.write(self.lead)
        frame = self.encoder.compress(record)
        self.file.write(frame)
        self.size += len(frame)
        self.count += 1
        if self.size >= self.most:
            self._close()

    def _close(self) -> None:
        self.file.close()
        self.fs.move(self.temporary, self.name)
        self.done.append((self.name.rsplit("/", 1)[1], self.count, self.size))
        self.file, self.count = None, 0

    def end(self) -> list[tuple[str, int, int]]:
        if self.encoder is None and self.waiting:
            self._start()
        if self.file is not None:
            self._close()
        return self.done


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = 16 << 20, sample_bytes: int = 1 << 20, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each page into archives below ``folder``; returns a row for each archive.

    Of the pages with equal payloads of at least ``min_bytes``, the one with
    the largest id is a response and the others revisit it; all smaller ones
    are responses.  A null payload is empty.  Pages without an id are always
    responses, and so are all rows that share the largest id.  Repeated rows
    have a record each, an empty table makes no archive, other columns are not
    written, whatever their names.  A very long payload is one record, held
    whole by its task.  A task that is repeated writes the same files again
    and renames them when they are whole.  A folder without a scheme lies in
    the cluster's default file system.
    """
    folder = qualified(pages.sparkSession, folder)
    page = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    newest = page.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("newest"))
    # only a revisit's place in the archives is moved with an empty payload
    linked = page.join(newest, "sha1", "left").withColumn("refers_to", F.when((F.col("size") >= min_bytes) & (F.col("page_id") < F.col("newest")), F.col("newest")))
    rows = linked.select("page_id", "url", "size", "sha1", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).alias("payload"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Archives(folder, archive_bytes, sample_bytes)
        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("page_id", "url", "payload", "size", "sha1", "refers_to")]
            for page_id, url, payload, size, sha1, refers_to in zip(*columns):
                out.add(record_bytes(page_id, url, payload, size, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, date))
        done = out.end()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "records", "bytes"])

    return written(rows.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """A row for each record of the archives below ``folder``.

    A record whose headers, lengths or digest don't hold has an ``error`` and
    nothing else; so has the rest of an archive whose frames are broken.
    Records of all types are read; ``record_id`` and ``refers_to_id`` are the
    ids as they stand, page_id and refers_to the numbers in those that
    :func:`write_archives` gives, else null.  A folder without archives gives
    no rows.  Returns archive, position, page_id, url, record_type,
    payload_bytes, payload_digest, refers_to, record_id, refers_to_id, error,
    and payload if asked for.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path", "content")
    names = ["archive", "position", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "record_id", "refers_to_id", "error"] + ["payload"] * payloads
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * payloads
    schema = "archive string, position long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_id string, error string" + ", payload binary" * payloads

    def records(path: str, data: memoryview) -> Iterator[tuple]:
        at = 0
        try:
            for at, raw in frames(data):
                try:
                    r = parse_record(raw)
                    row = (path, at, r.page_id, r.url, r.kind, r.size, r.digest, r.refers_to, r.record_id, r.refers_to_id, None, r.payload)
                except ValueError as e:
                    row = (path, at, *[None] * 8, str(e), None)
                yield row[: len(names)]
        except Exception as e:  # broken frames: struct.error, ZstdError, ValueError
            yield (path, at, *[None] * 8, f"{type(e).__name__}: {e}", None)[: len(names)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("path")[i].as_py().rsplit("/", 1)[-1]
                rows, held = [], 0
                for row in records(name, memoryview(batch.column("content")[i].as_buffer())):
                    rows.append(row)
                    held += len(row[-1] or b"") if payloads else 200
                    if held > 4 << 20:
                        yield _batch(rows, names, kinds)
                        rows, held = [], 0
                yield _batch(rows, names, kinds)

    return files.mapInArrow(read, schema)


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Writes the pages to archives, in the shared folder by default, and reads them back.

    A row for each page: nulls, ties, repeated rows, very long payloads and
    columns of any names as in :func:`write_archives`; an empty table gives an
    empty one.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    made = write_archives(pages, folder, **options)
    if made.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, error string")
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
