"""WARC records in seekable Zstandard bundles: written, indexed, and read back by frame."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesift.operators.joins import many_to_one
from rolesift.session import fresh_path, stage

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
READ_BYTES = 16 << 20

# Fixed values of the seekable Zstandard format and of WARC 1.1
_SKIPPABLE_MAGIC = 0x184D2A5E
_SEEKABLE_MAGIC = 0x8F92EAB1
_FOOTER_BYTES = 9
_IDENTICAL_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NO_URI = "about:blank"
_EPOCH = "1970-01-01T00:00:00Z"

INDEX_SCHEMA = "page_id long, bundle string, frame long, frame_start long, frame_bytes long, start long, bytes long"
RECORD_SCHEMA = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
                  revisit: bool, date: str = _EPOCH) -> bytes:
    """One record; a revisit has no payload of its own, only its size and digest."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url, safe='%/:=&?~#+!$,;@()*[]') if url else _NO_URI}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Url: {'' if url is None else '=' + quote(url, safe='')}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += [
            f"WARC-Profile: {_IDENTICAL_PAYLOAD}",
            f"WARC-Refers-To: {record_id(refers_to, digest)}",
            f"X-Refers-To-Page: {refers_to}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(record: bytes) -> dict:
    """The fields of RECORD_SCHEMA; a response's payload is checked against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    field = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "")
                 for line in head.decode().split("\r\n")[1:])
    block = rest[: int(field["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest = field["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = field["WARC-Type"] == "revisit"
    if not revisit and (base32_sha1(payload) != digest or len(payload) != int(field["X-Payload-Length"])):
        raise ValueError(f"payload of {field['WARC-Record-ID']} does not match its digest")
    return {
        "page_id": int(field["X-Page-Id"]) if field["X-Page-Id"] else None,
        "url": unquote(field["X-Url"][1:]) if field["X-Url"] else None,
        "payload": None if revisit else payload,
        "payload_bytes": int(field["X-Payload-Length"]),
        "payload_digest": digest,
        "record_type": field["WARC-Type"],
        "refers_to": int(field["X-Refers-To-Page"]) if revisit else None,
    }


class BundleWriter:
    """One seekable file: independent frames of whole records, then the seek table."""

    def __init__(self, files: fs.FileSystem, path: str, name: str, frame_bytes: int, level: int):
        self.name, self.frame_bytes = name, frame_bytes
        self.out = files.open_output_stream(path, compression=None)  # else the name's ending would choose one
        self.coder = zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int]] = []
        self.written, self.filled = 0, 0
        self.waiting: list[tuple[int | None, bytes]] = []

    def add(self, page_id: int | None, record: bytes) -> list[tuple]:
        """Index rows of the frame that the record completes, if it does."""
        self.waiting.append((page_id, record))
        self.filled += len(record)
        return self.end_frame() if self.filled >= self.frame_bytes else []

    def end_frame(self) -> list[tuple]:
        if not self.waiting:
            return []
        frame = self.coder.compress(b"".join(r for _, r in self.waiting))
        self.out.write(frame)
        rows, at = [], 0
        for page_id, record in self.waiting:
            rows.append((page_id, self.name, len(self.frames), self.written, len(frame), at, len(record)))
            at += len(record)
        self.frames.append((len(frame), self.filled))
        self.written, self.filled, self.waiting = self.written + len(frame), 0, []
        return rows

    def close(self) -> list[tuple]:
        rows = self.end_frame()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, _SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", _SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return rows


def read_seek_table(file: pa.NativeFile) -> list[tuple[int, int, int]]:
    """Start, stored size and content size of each frame, from the file's footer."""
    size = file.size()
    file.seek(size - _FOOTER_BYTES)
    count, _, magic = struct.unpack("<IBI", file.read(_FOOTER_BYTES))
    if magic != _SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the file")
    file.seek(size - _FOOTER_BYTES - 8 * count)
    frames, start = [], 0
    for stored, content in struct.iter_unpack("<II", file.read(8 * count)):
        frames.append((start, stored, content))
        start += stored
    return frames


def _write(batches: Iterator[pa.RecordBatch], folder: str, frame_bytes: int, bundle_bytes: int, level: int
           ) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)
    names = [f.split()[0] for f in INDEX_SCHEMA.split(", ")]
    files.create_dir(root, recursive=True)
    writer = None
    for batch in batches:
        rows = []
        columns = (batch.column(c) for c in ("page_id", "url", "payload", "refers_to", "revisit"))
        for page_id, url, payload, refers_to, revisit in zip(*columns):
            if writer is None:
                name = f"{uuid.uuid4().hex}.warc.zst"  # of this attempt only; the index names what counts
                writer = BundleWriter(files, f"{root}/{name}", name, frame_bytes, level)
            page_id = page_id.as_py()
            record = encode_record(page_id, url.as_py(), payload.as_py(), refers_to.as_py(), revisit.as_py())
            rows += writer.add(page_id, record)
            if writer.written >= bundle_bytes:
                rows += writer.close()
                writer = None
        yield _index_batch(rows, names)
    if writer is not None:
        yield _index_batch(writer.close(), names)


def _index_batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.int64(), pa.string(), *[pa.int64()] * 5]
    columns = list(zip(*rows)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    files, root = fs.FileSystem.from_uri(folder)
    decoder = zstandard.ZstdDecompressor()
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ])
    opened = file = table = loaded = content = None
    for batch in batches:
        rows, size = [], 0
        for row in batch.to_pylist():
            if row["bundle"] != opened:
                opened, loaded = row["bundle"], None
                file = files.open_input_file(f"{root}/{opened}")
                table = read_seek_table(file)
            if row["frame"] != loaded:
                loaded = row["frame"]
                start, stored, plain = table[loaded]
                file.seek(start)
                content = decoder.decompress(file.read(stored), max_output_size=plain)
            rows.append(decode_record(content[row["start"] : row["start"] + row["bytes"]]))
            size += row["bytes"]
            if size >= 16 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def mark_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """page_id, url, payload, refers_to, revisit of every page.

    Only payloads that occur more than once, by digest and size, are looked up; a payload
    of a third of all pages is joined as a hot key.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        payload.alias("payload"), F.sha1(payload).alias("digest"),
    )
    first = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")
    )
    repeated = stage(first.filter((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n"), "warc-repeated")
    marked = many_to_one(rows, repeated, ["digest"], "left")
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    return marked.select("page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"),
                         revisit.alias("revisit"))


def write_bundles(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES,
                  bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, **columns: str) -> tuple[str, DataFrame]:
    """Write a record per page; returns the folder and the index of all records.

    The index (INDEX_SCHEMA) holds for each record its page id, bundle, frame, and its
    place inside the frame's content. Each task writes bundles of its own to `folder`, on
    any storage that has a URI and that all executors reach, a frame at a time. An attempt
    that fails leaves files that no index row names.

    A null html is an empty payload, a null url is kept as null. Of equal payloads of at
    least `min_bytes` bytes the least page id is the response. Null page ids are written,
    and refer to the least id; if a payload has null ids only, each is a response. Rows that
    repeat the least id are all responses. Other columns are not read. Empty input writes no
    bundle and gives an empty index.
    """
    folder = folder or _as_uri(fresh_path(pages.sparkSession, "warc"))
    write = partial(_write, folder=folder, frame_bytes=frame_bytes, bundle_bytes=bundle_bytes, level=level)
    index = mark_revisits(pages, min_bytes, **columns).mapInArrow(write, INDEX_SCHEMA)
    return folder, stage(index, "warc-index")


def read_bundles(folder: str, index: DataFrame) -> DataFrame:
    """The records (RECORD_SCHEMA) that `index` names: all of it, or any choice of its rows.

    Records of one frame are read together, each frame once, by tasks of about READ_BYTES of
    records; the index rows that are shuffled say little about that.
    """
    content = index.agg(F.sum("bytes")).first()[0] or 0
    placed = index.repartition(content // READ_BYTES + 1, "bundle", "frame").sortWithinPartitions("bundle", "frame", "start")
    return placed.mapInArrow(partial(_read, folder=folder), RECORD_SCHEMA)


def _as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"


def archive_digest(pages: DataFrame, min_bytes: int = 0, **options) -> DataFrame:
    """Write `pages`, read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    folder, index = write_bundles(pages, min_bytes=min_bytes, **options)
    return read_bundles(folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
