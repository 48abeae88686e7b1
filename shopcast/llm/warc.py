"""WARC archives: write them as one gzip stream, normalise them, read them by index.

A monolithic archive is one gzip stream over all records, so that a record can
be reached only by inflating what precedes it.  The normaliser inflates the
stream once, from start to end, writes every record as a gzip member of its own
and notes the member's offset and length in a sidecar file.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopcast.llm.common import slices
from shopcast.sources import stage

#: Payloads below this size are always written in full.
REVISIT_BYTES = 1000
#: Payload bytes after which a task starts another archive.
ARCHIVE_BYTES = 256 << 20
LEVEL = 4
_CHUNK = 1 << 20
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"

INDEX_SCHEMA = "archive string, offset long, length long, record_id string, record_type string, digest string"
_MANIFEST = "archive string, records long, payload_bytes long"


def _opened(path: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path inside it; any store that pyarrow reaches, local paths too."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


class _Output:
    """A file that appears under its name when it is whole; a repeated task replaces it."""

    def __init__(self, path: str):
        self.system, self.path = _opened(path)
        self.part = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.file = self.system.open_output_stream(self.part, compression=None)

    def close(self) -> None:
        self.file.close()
        self.system.move(self.part, self.path)


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if ord(c) >= 32 and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(page: dict, date: str) -> bytes:
    """Headers and block of one page as WARC/1.1."""
    payload = (page["payload"] or "").encode("utf-8", "replace")
    digest = base64.b32encode(bytes.fromhex(page["digest"])).decode()
    name = "" if page["page_id"] is None else str(page["page_id"])
    revisit = page["refers_to"] is not None
    size = page["payload_bytes"]
    block = _HTTP % size + (b"" if revisit else payload)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(page['url'] or f'urn:page:{name}')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        lines.append(f"WARC-Refers-To: <urn:page:{page['refers_to']}>")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def mark_revisits(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    least_bytes: int = REVISIT_BYTES,
) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, refers_to): a revisit has refers_to.

    Of equal payloads of at least ``least_bytes`` the page with the largest id is
    written in full; pages repeated with that id are too, and pages without an
    id refer to it like others.  If no page of a group has an id, all are full.
    A null payload is empty.  Payloads do not move: only digests are grouped.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    repeated = stage(
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_bytes", "digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .drop("n"),
        "warc-repeated",
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(repeated, ["payload_bytes", "digest"], "left").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "digest",
        F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to"),
    )


def write_monolithic(
    marked: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES
) -> DataFrame:
    """One or more archives per partition, each a single gzip stream; returns their manifest.

    Names follow from the partition, so a repeated task replaces its own files.
    An empty partition writes none.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        out = stream = None
        done: list[dict] = []

        def finish() -> None:
            nonlocal out, stream, number
            stream.close()
            out.close()
            out, number = None, number + 1

        for batch in batches:
            for some in slices(batch, "payload"):
                for page in some.to_pylist():
                    if out is None:
                        path = posixpath.join(folder, f"part-{part:05d}-{number:04d}.warc.gz")
                        out = _Output(path)
                        stream = gzip.GzipFile(
                            fileobj=out.file, mode="wb", compresslevel=LEVEL, mtime=0, filename=""
                        )
                        done.append({"archive": path, "records": 0, "payload_bytes": 0})
                    stream.write(_record(page, date))
                    done[-1]["records"] += 1
                    done[-1]["payload_bytes"] += page["payload_bytes"]
                    if done[-1]["payload_bytes"] >= archive_bytes:
                        finish()
        if out is not None:
            finish()
        kinds = pa.schema([("archive", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64())])
        yield pa.RecordBatch.from_pylist(done, schema=kinds)

    system, inner = _opened(folder)
    system.create_dir(inner, recursive=True)
    return stage(marked.mapInArrow(run, _MANIFEST), "warc-manifest")


def _headers(stream: BinaryIO) -> list[bytes] | None:
    """Header lines of the next record; None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    lines = [line]
    while True:
        line = stream.readline()
        if not line:
            raise EOFError("a record ends inside its headers")
        if line in (b"\r\n", b"\n"):
            return lines
        lines.append(line)


def _named(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def normalise_archive(source: str, target: str) -> list[dict]:
    """Rewrite one archive with a member per record and write its index beside it.

    The source is inflated once, in pieces; a record larger than a piece is
    passed on piece by piece.  Archives that already have members are read too.
    """
    system, path = _opened(source)
    out, index, at = _Output(target), [], 0
    with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="rb") as stream:
        while (lines := _headers(stream)) is not None:
            named = _named(lines)
            member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            size, left = 0, int(named["content-length"])
            pieces = [member.compress(b"".join(lines) + b"\r\n")]
            while pieces:
                data = pieces.pop()
                out.file.write(data)
                size += len(data)
                if left > 0:
                    block = stream.read(min(left, _CHUNK))
                    if not block:
                        raise EOFError("a record ends inside its block")
                    left -= len(block)
                    pieces.append(member.compress(block))
            data = member.compress(b"\r\n\r\n") + member.flush()
            out.file.write(data)
            size += len(data)
            index.append(
                {
                    "archive": target,
                    "offset": at,
                    "length": size,
                    "record_id": named.get("warc-record-id", ""),
                    "record_type": named.get("warc-type", ""),
                    "digest": named.get("warc-payload-digest", ""),
                }
            )
            at += size
    out.close()
    side = _Output(f"{target}.idx.json")
    side.file.write("".join(json.dumps(x) + "\n" for x in index).encode())
    side.close()
    return index


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Normalise every archive of ``manifest`` into ``folder``, one task step per archive.

    Returns (archive, records).  The index is in the sidecar files, see
    :func:`read_index`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                target = posixpath.join(folder, posixpath.basename(path))
                records = len(normalise_archive(path, target))
                yield pa.RecordBatch.from_pylist([{"archive": target, "records": records}])

    system, inner = _opened(folder)
    system.create_dir(inner, recursive=True)
    rows = manifest.select("archive").repartition(max(1, manifest.count()), F.xxhash64("archive"))
    return stage(rows.mapInArrow(run, "archive string, records long"), "warc-normalised")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the sidecar index files of ``folder``."""
    system, inner = _opened(folder)
    infos = system.get_file_info(pa.fs.FileSelector(inner, allow_not_found=True))
    if not any(i.path.endswith(".idx.json") for i in infos):
        return spark.createDataFrame([], INDEX_SCHEMA)
    return spark.read.schema(INDEX_SCHEMA).json(posixpath.join(folder, "*.idx.json"))


def _parsed(data: bytes) -> dict:
    """One gzip member as a record; the payload is what follows the HTTP headers."""
    record = zlib.decompress(data, 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    named = _named(head.split(b"\r\n"))
    block = rest[: int(named["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)\r\nContent-Length: *(\d+)", http)
    algorithm, _, digest = named.get("warc-payload-digest", "").partition(":")
    page = lambda v: re.sub(r"^<urn:page:(.*)>$", r"\1", v or "") or None
    revisit = named["warc-type"] == "revisit"
    if revisit:
        found = base64.b32decode(digest).hex()
    else:
        found = hashlib.sha1(payload).hexdigest()
        if algorithm == "sha1" and base64.b32decode(digest).hex() != found:
            raise ValueError(f"payload of {named['warc-record-id']} does not match its digest")
    return {
        "record_id": page(named["warc-record-id"]),
        "url": named.get("warc-target-uri"),
        "record_type": named["warc-type"],
        "refers_to": page(named.get("warc-refers-to")),
        "payload_bytes": int(length[1]) if revisit and length else len(payload),
        "payload_digest": found,
        "payload": None if revisit else payload,
    }


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of the index rows, read by offset: one seek and one inflated member each.

    record_id and refers_to are the page ids as text, null where a page had
    none; payload is null for a revisit.  Digests of payloads are checked.
    """
    fields = [
        ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
        ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("payload", pa.binary()),
    ]
    if not with_payload:
        fields.pop()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for batch in batches:
            held, size = [], 0
            for row in batch.select(["archive", "offset", "length"]).to_pylist():
                if row["archive"] != path:
                    if file is not None:
                        file.close()
                    path = row["archive"]
                    system, inner = _opened(path)
                    file = system.open_input_file(inner)
                file.seek(row["offset"])
                record = _parsed(file.read(row["length"]))
                held.append({n: record[n] for n, _ in fields})
                size += record["payload_bytes"] if with_payload else 200
                if size >= 2 * _CHUNK:
                    yield pa.RecordBatch.from_pylist(held, schema=pa.schema(fields))
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=pa.schema(fields))
        if file is not None:
            file.close()

    kinds: dict[pa.DataType, Callable] = {
        pa.string(): T.StringType, pa.int64(): T.LongType, pa.binary(): T.BinaryType
    }
    return index.mapInArrow(run, T.StructType([T.StructField(n, kinds[k]()) for n, k in fields]))
