"""WARC archives: records with revisits, a normaliser for whole-file gzip streams, and reading by offset index.

Files lie in the shared folder and are written through pyarrow's file systems, so that any store that
the executors reach will do. A task writes under a name of its own attempt and renames at the end: a
task that runs again replaces its file by the same content.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from typing import BinaryIO

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, scratch, short_lived_shuffles, with_text_ids

#: Payload bytes after which a task starts a new archive file.
FILE_BYTES = 1 << 28
CHUNK = 1 << 16
#: Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("/") else fs.FileSystem.from_uri(f"file://{posixpath.abspath(uri)}")


@contextmanager
def _new_file(uri: str) -> Iterator[BinaryIO]:
    store, path = _store(uri)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    store.create_dir(posixpath.dirname(path), recursive=True)
    with store.open_output_stream(draft, compression=None) as out:
        yield out
    store.move(draft, path)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | str | None, url: str | None, payload: bytes, original: int | str | None, date: str) -> bytes:
    """A response record, or a revisit of `original`; its HTTP headers keep the length of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if original is not None else http + payload
    lines = [("WARC-Type", "response" if original is None else "revisit"), ("WARC-Record-ID", f"<urn:x-page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    if url is not None:
        lines.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    lines.append(("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"))
    if original is not None:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:x-page:{original}>")]
    lines += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines).encode("utf-8", "replace")
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def read_head(stream: BinaryIO) -> tuple[bytes, dict[str, str]] | None:
    """The head of the next record as bytes and as lower-cased names with values; None at the end."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no WARC record here: {line[:40]!r}")
    raw, fields = [line], {}
    while (line := stream.readline()).strip():
        raw.append(line)
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields[name.strip().lower()] = value.strip()
    raw.append(line)
    return b"".join(raw), fields


def write_archives(pages: DataFrame, folder: str, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row into gzip streams of whole files; returns file, records and payload_bytes of each.

    Of records with equal payloads (length and SHA-256) of at least least_bytes, that with the smallest
    id is the response and the others revisit it. Rows that tie on the smallest id are all responses, so
    are rows whose payload no row with an id has. Null html is an empty payload. Payloads travel once, to
    the id of their group; groups are combined on the map side and hot ones split by adaptive execution.
    """
    payload = F.encode(F.coalesce(pages[html_column].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[id_column].cast("long").alias("page_id"), pages[url_column].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    originals = durable(rows.select("page_id", "size", "digest").groupBy("digest", "size").agg(F.min("page_id").alias("original")))
    joined = rows.join(originals, ["digest", "size"])
    refers = F.when((F.col("size") >= least_bytes) & ~F.col("original").eqNullSafe(F.col("page_id")), F.col("original"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, batches = TaskContext.get().partitionId(), 0, iter(batches)
        rest = _records(batches, date)
        while (first := next(rest, None)) is not None:
            name, records, total = f"raw-{part:06d}-{number:04d}.warc.gz", 0, 0
            with _new_file(f"{folder}/{name}") as out:
                packer = zlib.compressobj(6, wbits=31)
                record: tuple[bytes, int] | None = first
                while record is not None:
                    out.write(packer.compress(record[0]))
                    records, total = records + 1, total + record[1]
                    record = next(rest, None) if total < FILE_BYTES else None
                out.write(packer.flush())
            number += 1
            yield pd.DataFrame({"file": [name], "records": [records], "payload_bytes": [total]})

    with short_lived_shuffles(pages.sparkSession):
        return durable(with_text_ids(joined.select("page_id", "url", "payload", refers.alias("original")), "page_id", "original").mapInPandas(write, "file string, records long, payload_bytes long"))


def _records(batches: Iterator[pd.DataFrame], date: str) -> Iterator[tuple[bytes, int]]:
    for batch in batches:
        for page_id, url, payload, original in zip(batch["page_id"], batch["url"], batch["payload"], batch["original"], strict=True):
            yield record_bytes(page_id, url, bytes(payload), original, date), len(payload)


def normalise_archives(files: DataFrame, folder: str, target: str) -> DataFrame:
    """Rewrites every file so that each record is a gzip member of its own, with a sidecar offset index.

    A file is inflated once, as a stream, whatever members it has; at most one record's head and CHUNK
    bytes are held. The sidecar <name>.index holds a JSON line per record: offset and length of the
    member, record id and type. Returns file and records of each archive.
    """

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name in batch["file"]:
                yield pd.DataFrame({"file": [name], "records": [normalise_file(f"{folder}/{name}", f"{target}/{name}")]})

    parts = max(1, files.count())  # a range for each name: a task of its own, which hashing would not give
    return durable(files.select("file").repartitionByRange(parts, "file").mapInPandas(rewrite, "file string, records long"))


def normalise_file(source: str, target: str) -> int:
    store, path = _store(source)
    offset = count = 0
    with (
        store.open_input_stream(path, compression=None) as compressed,
        gzip.GzipFile(fileobj=compressed) as stream,
        _new_file(target) as out,
        _new_file(f"{target}.index") as index,
    ):
        while (head := read_head(stream)) is not None:
            packer, begin = zlib.compressobj(6, wbits=31), offset
            offset += out.write(packer.compress(head[0]))
            left = int(head[1]["content-length"])
            while left:
                chunk = stream.read(min(CHUNK, left))
                if not chunk:
                    raise EOFError(f"{source} ends inside a record")
                left -= len(chunk)
                offset += out.write(packer.compress(chunk))
            offset += out.write(packer.compress(b"\r\n\r\n") + packer.flush())
            line = {"file": posixpath.basename(target), "offset": begin, "length": offset - begin, "id": head[1].get("warc-record-id"), "type": head[1].get("warc-type")}
            index.write(json.dumps(line).encode() + b"\n")
            count += 1
    return count


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """All sidecars of a folder: file, offset, length, id, type."""
    return spark.read.schema("file string, offset long, length long, id string, type string").json(f"{folder}/*.index")


def read_records(index: DataFrame, folder: str, *, with_payload: bool = False) -> DataFrame:
    """Reads the members that the index names: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    Length and digest of a response are taken from its payload, and the digest must be the stated one;
    those of a revisit are the stated ones. with_payload adds the payload (null for revisits).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, own in batch.groupby("file", sort=False):
                rows = []
                store, path = _store(f"{folder}/{name}")
                with store.open_input_file(path) as file:
                    for offset, length in zip(own["offset"].tolist(), own["length"].tolist(), strict=True):
                        rows.append(_parse(zlib.decompress(file.read_at(length, offset), wbits=31), with_payload))
                        if len(rows) == 500:
                            yield _frame(rows, with_payload)
                            rows = []
                if rows:
                    yield _frame(rows, with_payload)

    return index.select("file", "offset", "length").mapInPandas(read, schema)


def _frame(rows: list[tuple], with_payload: bool) -> pd.DataFrame:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if with_payload else [])]
    kinds = {"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"}
    return pd.DataFrame({n: pd.Series(list(v), dtype=kinds.get(n, object)) for n, v in zip(names, zip(*rows, strict=True), strict=True)})


def _parse(member: bytes, with_payload: bool) -> tuple:
    import io

    stream = io.BytesIO(member)
    _, fields = read_head(stream)
    block = stream.read(int(fields["content-length"]))
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").rpartition(":")[2]) else None
    kind = fields["warc-type"]
    if kind == "response":
        if sha1_base32(payload) != digest:
            raise ValueError(f"the payload of {fields['warc-record-id']} is not the one that was written")
        size = len(payload)
    else:
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    row = (number("warc-record-id"), fields.get("warc-target-uri"), size, digest, kind, number("warc-refers-to"))
    return (*row, payload if kind == "response" else None) if with_payload else row


def archive_pages(pages: DataFrame, *, least_bytes: int = 0, folder: str | None = None, **columns: str) -> DataFrame:
    """Writes, normalises and reads back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    See write_archives for revisits, nulls and ties. Every row is a record, repeated rows too; an empty
    table writes no file. The archives stay in `folder` (by default a fresh one in the shared folder).
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    files = write_archives(pages, f"{folder}/raw", least_bytes=least_bytes, **columns)
    if files.isEmpty():
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    normalise_archives(files, f"{folder}/raw", f"{folder}/records")
    found = read_records(read_index(spark, f"{folder}/records"), f"{folder}/records")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
