"""Deterministic sharded WARC files, and a reader for them.

Records are range-sorted by page number, so each task has a contiguous run. It writes gzip members, one for each record,
and begins a new file once the present one has the set compressed size. Headers and digests are made anew from the row;
record ids are name-based, so equal input gives equal bytes. Files are written to temporary names and renamed; a manifest
of names, sizes and digests is written last and renamed too, and a reader opens only what it names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.llm.common import fresh_path, small_enough, stored

#: Compressed bytes at which a file ends.
ROLL = 64 << 20
#: Date of all records unless another is given; a clock would make the files differ from run to run.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:quarryline:warc")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(kind: str, page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, nth: int) -> bytes:
    """One record, uncompressed. A revisit has the head of its response but not the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + (payload if kind == "response" else b"")
    target = "".join(c if c.isprintable() and c != " " else "%" + "%".join(f"{b:02X}" for b in c.encode("utf-8", "replace")) for c in url or "")
    name = uuid.uuid5(_NAMES, f"{page}|{target}|{digest}|{nth}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target or 'about:blank'}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page is not None:
        lines.append(f"X-Page-Id: {page}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}"] + ([f"X-Refers-To-Page: {refers_to}"] if refers_to is not None else [])
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def compressed(data: bytes) -> bytes:
    """A gzip member without a time or a name."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as member:
        member.write(data)
    return out.getvalue()


class Roller:
    """Writes members to files below a folder, each up to the size where the next one begins."""

    def __init__(self, folder: str, label: str, roll: int) -> None:
        self.store, self.root = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.root)
        self.label, self.roll, self.sink, self.done = label, roll, None, []

    def add(self, data: bytes) -> None:
        if self.sink is None:
            self.temporary = f"{self.root}/.{uuid.uuid4().hex}.tmp"
            self.sink, self.size, self.records, self.hash = self.store.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.sink.write(data)
        self.hash.update(data)
        self.size += len(data)
        self.records += 1
        if self.size >= self.roll:
            self.close()

    def close(self) -> None:
        if self.sink is not None:
            self.sink.close()
            name = f"{self.label}-{len(self.done):05d}.warc.gz"
            self.store.move(self.temporary, f"{self.root}/{name}")
            self.done.append({"name": name, "bytes": self.size, "records": self.records, "sha256": self.hash.hexdigest()})
            self.sink = None


def payload(html: str = "html") -> Column:
    return F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, roll: int = ROLL, date: str = DATE) -> list[dict]:
    """Writes each row of ``pages`` (page_id, url, html) as a record below ``folder``; returns the manifest.

    Of rows with equal payloads of ``min_bytes`` or more, the one with the largest page_id is the response and the others are
    revisits of it; among rows of that page_id the first by url is. A null html is an empty payload, a null page_id is less
    than all others; a null url is written, and read back, as about:blank. Rows that are equal in everything are records of
    their own. A long page is one record, whole in its task. Other columns are not written; an empty table gives an empty
    manifest.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload().alias("payload"))
    pages = pages.withColumn("sha1", F.unhex(F.sha1("payload")))
    long = F.octet_length("payload") >= min_bytes
    keyed = pages.select(F.when(long, F.col("sha1")).alias("sha1"), "page_id", F.coalesce("url", F.lit("")).alias("u"))
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), (-F.col("page_id")).alias("down"), "u"))
    repeated = stored(keyed.filter("sha1 is not null").groupBy("sha1").agg(F.count("*").alias("n"), first.alias("r")).filter("n > 1").select("sha1", (-F.col("r.down")).alias("response"), F.col("r.u").alias("at")), "payloads")
    right = F.broadcast(repeated) if small_enough(repeated.count(), 128) else repeated
    joined = pages.join(right.withColumnRenamed("sha1", "__sha1"), long & (F.col("sha1") == F.col("__sha1")), "left")
    role = F.when(F.col("__sha1").isNull(), 0).when(F.col("page_id").eqNullSafe(F.col("response")) & (F.coalesce("url", F.lit("")) == F.col("at")), 1).otherwise(2)
    rows = joined.select("page_id", "url", "payload", "sha1", "response", role.alias("role"))
    rows = rows.repartitionByRange("page_id", "sha1", "url").sortWithinPartitions("page_id", "sha1", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller(folder, f"pages-{TaskContext.get().partitionId():06d}", roll)
        before, nth = None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                page, url, data, sha1, response, role = (batch.column(c)[k].as_py() for c in range(6))
                nth = nth + 1 if before == (page, url, sha1) else 0
                before = (page, url, sha1)
                # Rows that are equal in everything lie side by side, in one partition: the first is the response.
                kind = "response" if role == 0 or role == 1 and not nth else "revisit"
                roller.add(compressed(record(kind, page, url, data, base64.b32encode(sha1).decode(), response, date, nth)))
        roller.close()
        if roller.done:
            yield pa.RecordBatch.from_pylist(roller.done)

    files = sorted((r.asDict() for r in rows.mapInArrow(run, "name string, bytes long, records long, sha256 string").collect()), key=lambda f: f["name"])
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root)
    with store.open_output_stream(f"{root}/.manifest.tmp") as sink:
        sink.write("".join(json.dumps(f, sort_keys=True) + "\n" for f in files).encode())
    store.move(f"{root}/.manifest.tmp", f"{root}/manifest.jsonl")
    return files


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a stream of gzip members; memory is one record."""
    inflate, buffer = zlib.decompressobj(31), b""
    rest = source.read(1 << 20)
    while rest:
        buffer += inflate.decompress(rest)
        if inflate.eof:
            head, _, body = buffer.partition(b"\r\n\r\n")
            lines = head.decode("utf-8").split("\r\n")
            headers = dict(x.split(": ", 1) for x in lines[1:])
            yield headers, body[: int(headers["Content-Length"])]
            rest, inflate, buffer = inflate.unused_data or source.read(1 << 20), zlib.decompressobj(31), b""
        else:
            rest = source.read(1 << 20)
    if buffer:
        raise ValueError("an archive ends inside a record")


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of each record in the manifest's files.

    A digest or a file size that isn't right raises an error.
    """
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_stream(f"{root}/manifest.jsonl") as source:
        files = [json.loads(x) for x in source.read().decode().splitlines()]
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    if not files:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for k in batch.column(0).to_pylist():
                rows: list[tuple] = []
                n = 0
                with store.open_input_stream(f"{root}/{files[k]['name']}", compression=None) as source:
                    for headers, block in records(source):
                        data = block.partition(b"\r\n\r\n")[2]
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        if f"sha1:{base32_sha1(block)}" != headers["WARC-Block-Digest"] or kind == "response" and base32_sha1(data) != digest:
                            raise ValueError(f"wrong digest in {files[k]['name']}")
                        number = lambda name, headers=headers: int(headers[name]) if name in headers else None
                        rows.append((number("X-Page-Id"), headers["WARC-Target-URI"], number("X-Payload-Length"), digest, kind, number("X-Refers-To-Page")))
                        n += 1
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows = []
                if n != files[k]["records"]:
                    raise ValueError(f"{files[k]['name']} has {n} records, not {files[k]['records']}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return spark.range(0, len(files), 1, len(files)).mapInArrow(run, schema)


def warc_round_trip(pages: DataFrame, min_bytes: int = 0, roll: int = ROLL) -> DataFrame:
    """Writes ``pages`` to a fresh folder of the shared storage and returns what its archives hold; see write_warc. An empty
    table gives an empty result."""
    spark = pages.sparkSession
    folder = fresh_path(spark, "warc")
    folder = folder if "://" in folder else f"file://{folder}"
    write_warc(pages, folder, min_bytes, roll)
    return read_warc(spark, folder)
