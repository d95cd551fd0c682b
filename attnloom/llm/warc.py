"""WARC archives of single records compressed with one Zstandard dictionary.

An archive begins with a skippable frame (magic 0x184D2A5D) whose content is the
dictionary, itself a Zstandard frame. Each record follows as a frame of its own,
so records can be read one by one and archives can be joined end to end.

The dictionary is trained in one task on a bounded sample: at most SAMPLES
records, the first SAMPLE_BYTES of each. Without enough records to train on,
archives have no leading frame. Every page is written whole.

Pages are turned into compressed response records in one pass. Of equal payloads
(same SHA-1, which the records carry anyway) one stays; the others become
`revisit` records that name it. Archives are written under names of their task
attempt and reported in a stored list, so repeated attempts do no harm. Files go
through Arrow's file systems into the shared folder.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .common import read_table, slices, spread_join, stored

MAGIC = 0x184D2A5D  # fixed value: the skippable frame that holds a dictionary
SAMPLES, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 1 << 14, 1 << 16
LEVEL = 6
ARCHIVE_BYTES = 1 << 28
LEAST_BYTES = 0
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
_SEEN = pa.schema([("row", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("frame", pa.binary())])


# ------------------------------------------------------------ records


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(b'page-record-%d' % row).digest(), version=4)}>"


def _uri(url: str | None, page_id: int | None) -> str:
    """The url with white space and control signs percent-encoded; a name of the page where there is none."""
    if not url:
        return f"urn:page:{'' if page_id is None else page_id}"
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url)


def record(kind: str, row: int, page_id: int | None, url: str | None, size: int, payload_digest: str, payload: bytes, refers: tuple | None = None) -> bytes:
    """A WARC/1.1 record. `refers` is (row, page_id, url) of the record that a revisit names."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(row)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_uri(url, page_id)}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers[0])}", f"WARC-Refers-To-Target-URI: {_uri(refers[2], refers[1])}"]
        if refers[1] is not None:
            head.append(f"X-Refers-To-Page-Id: {refers[1]}")
    head.append(f"Content-Length: {len(http) + len(payload)}")
    return b"".join(["\r\n".join(head).encode("utf-8", "surrogatepass"), b"\r\n\r\n", http, payload, b"\r\n\r\n"])


def records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed stream."""
    reader = io.BufferedReader(stream, 1 << 16)
    while line := reader.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers = {}
        while (line := reader.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "surrogatepass").rstrip("\r\n").partition(":")
            headers[name.lower()] = value.strip()
        size = int(headers["content-length"])
        block = reader.read(size)
        if len(block) < size or reader.read(4) != b"\r\n\r\n":
            raise ValueError("a record is cut off")
        yield headers, block


# ------------------------------------------------------------ dictionary


def train(samples: list[bytes]) -> bytes:
    """A dictionary of at most DICTIONARY_BYTES; empty if there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary(pages: DataFrame) -> bytes:
    """Trained on a bounded sample of the records of `pages` (page_id, url, payload)."""
    share = min(1.0, 2 * SAMPLES / max(1, pages.count()))
    some = pages.filter(F.rand(7) < share).limit(SAMPLES) if share < 1 else pages.limit(SAMPLES)
    some = some.select("page_id", "url", F.octet_length("payload").alias("size"), F.substring("payload", 1, SAMPLE_BYTES).alias("payload"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        samples = [record("response", i, None if pd.isna(r.page_id) else int(r.page_id), r.url, r.size, digest(r.payload), r.payload)
                   for i, r in enumerate(rows.itertuples())]
        return pd.DataFrame({"content": [train(samples)]})

    found = some.groupBy(F.lit(0).alias("one")).applyInPandas(run, "content binary").collect()
    return bytes(found[0]["content"]) if found else b""


def leading_frame(content: bytes) -> bytes:
    """The skippable frame with the compressed dictionary; empty without one."""
    packed = zstandard.ZstdCompressor(level=19).compress(content) if content else b""
    return struct.pack("<II", MAGIC, len(packed)) + packed if packed else b""


def read_dictionary(start: bytes) -> tuple[bytes, int]:
    """The dictionary at the start of an archive and the length of its frame."""
    if len(start) < 8 or struct.unpack("<I", start[:4])[0] != MAGIC:
        return b"", 0
    size = struct.unpack("<I", start[4:8])[0]
    return zstandard.ZstdDecompressor().decompress(start[8 : 8 + size], max_output_size=1 << 24), 8 + size


# ------------------------------------------------------------ writing


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    made = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
    return zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True, **made)


def _framed(content: bytes):
    """Pages (row, page_id, url, payload) to response records, compressed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _compressor(content).compress
        for batch in batches:
            for part in slices(batch, "payload", 1 << 20):
                row, page_id, url, payload = (c.to_pylist() for c in part.columns)
                digests = [digest(p) for p in payload]
                frames = [pack(record("response", r, i, u, len(p), d, p)) for r, i, u, p, d in zip(row, page_id, url, payload, digests, strict=True)]
                columns = [pa.array(row, pa.int64()), pa.array(page_id, pa.int64()), pa.array(url, pa.string()),
                           pa.array(list(map(len, payload)), pa.int64()), pa.array(digests, pa.string()), pa.array(frames, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, schema=_SEEN)

    return run


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _writer(folder: str, content: bytes, start: bytes):
    """Rows to archives of about ARCHIVE_BYTES; gives their names, records and bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _place(folder)
        pack = _compressor(content).compress
        file, name, count, size = None, "", 0, 0

        def closed() -> pa.RecordBatch:
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([count]), pa.array([size])], ["archive", "records", "bytes"])

        for r in chain.from_iterable(part.to_pylist() for batch in batches for part in slices(batch, "frame", 1 << 20)):
            if file is None:
                system.create_dir(path, recursive=True)
                name, count, size = f"{uuid.uuid4().hex}.warc.zst", 0, len(start)
                file = system.open_output_stream(f"{path}/{name}", compression=None)
                file.write(start)
            frame = r["frame"]
            if r["refers_row"] is not None:
                refers = (r["refers_row"], r["refers_page_id"], r["refers_url"])
                frame = pack(record("revisit", r["row"], r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], b"", refers))
            file.write(frame)
            count, size = count + 1, size + len(frame)
            if size >= ARCHIVE_BYTES:
                yield closed()
                file = None
        if file is not None:
            yield closed()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write a record for every row of `pages` (page_id, url, html); returns the stored list of archives.

    archive (file name in `folder`), records, bytes. A null html is an empty
    payload. Of records with equal payloads of at least `least_bytes` bytes, that
    of the largest page_id is the response (null is smallest; equal ids: the
    largest url, then any); the others refer to it. A null url becomes a name
    of the page. Repeated rows are records of their own. Other columns are
    ignored; an empty table gives no archives.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload)
    content = dictionary(given)
    numbered = given.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "payload")
    seen = stored(numbered.mapInArrow(_framed(content), "row long, page_id long, url string, payload_bytes long, payload_digest string, frame binary"), "warc-frames")
    mark = F.struct("page_id", "url", "row")
    first = seen.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max(mark).alias("first"), F.count(F.lit(1)).alias("n"))
    first = stored(first.filter("n > 1").select("payload_digest", "first"), "warc-first")
    narrow = seen.filter(F.col("payload_bytes") >= least_bytes).select("row", "payload_digest")
    again = spread_join(narrow, first, "payload_digest").filter("row <> first.row")
    again = stored(again.select("row", F.col("first.row").alias("refers_row"), F.col("first.page_id").alias("refers_page_id"), F.col("first.url").alias("refers_url")), "warc-revisits")
    rows = seen.join(again, "row", "left").withColumn("frame", F.when(F.col("refers_row").isNull(), F.col("frame")))
    return stored(rows.mapInArrow(_writer(folder, content, leading_frame(content)), "archive string, records long, bytes long"), "warc-archives")


# ------------------------------------------------------------ reading


class _Rest(io.RawIOBase):
    """Decompressed bytes of an archive behind its leading frame."""

    def __init__(self, source, content: bytes) -> None:
        made = {"dict_data": zstandard.ZstdCompressionDict(content)} if content else {}
        self.inner = zstandard.ZstdDecompressor(**made).stream_reader(source, read_across_frames=True, closefd=False)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        return self.inner.readinto(buffer)


def open_archive(folder: str, name: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, read as a stream."""
    system, path = _place(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        start = f.read(8)
        size = struct.unpack("<I", start[4:8])[0] if len(start) == 8 and struct.unpack("<I", start[:4])[0] == MAGIC else 0
        content, length = read_dictionary(start + f.read(size)) if size else (b"", 0)
        f.seek(length)
        yield from records(_Rest(f, content))


def _page(headers: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    said = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError(f"the payload of {headers['warc-record-id']} is not what was archived")
    page_id, refers = headers.get("x-page-id"), headers.get("x-refers-to-page-id")
    return page_id and int(page_id), size, said, headers["warc-type"], refers and int(refers)


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record.

    Payloads are checked against their digests, records against the number written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for name, count in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, seen = [], 0
                for found in open_archive(folder, name):
                    rows.append(_page(*found))
                    seen += 1
                    if len(rows) == 5000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)
                if seen != count:
                    raise ValueError(f"{name} holds {seen} whole records of {count}")

    each = archives.select("archive", "records").repartitionByRange(max(1, archives.count()), "archive")
    return each.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all rows of `pages` and read the archives back."""
    folder = scratch_path(spark, "warc")
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"), folder), folder)
