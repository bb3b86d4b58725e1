"""Deterministic sharded WARC writer, and a reader that checks what it reads.

Pages are cut into range shards of ``page_id`` by bytes (see ``_ranges``), dealt by shard once, sorted
inside each, and streamed to gzip members, one a record. A file is closed when its compressed size
passes ``roll_bytes``. Every header and digest is made anew from the payload, and nothing depends on
clocks or attempts, so a task that runs again after a lost executor writes the same bytes. Files are
written under a temporary name and renamed; a shard's manifest (files, sizes, SHA-256) follows in the
same way; the archive counts as complete once the manifest table of all shards is there.

Repeats of a payload become revisits. Which page is first is decided on (page_id, digest, length)
alone: a map-side combined minimum for each digest, however many pages share it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._common import durable, fresh_path, shuffle_partitions, table
from loomgraph.llm._ranges import LOWEST, range_cuts, shard_of

#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass(frozen=True)
class Archive:
    """``shard_bytes``: payload of a shard, from the data alone: a 1024th of all, within these bounds.
    ``revisit_from``: payloads smaller than this are never written as revisits."""

    shard_bytes: tuple[int, int] = (8 << 20, 1 << 30)
    roll_bytes: int = 256 << 20
    revisit_from: int = 0
    date: str = "2024-01-01T00:00:00Z"
    level: int = 6


DEFAULT = Archive()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def header_text(value: str | None) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value or "")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, p: Archive) -> bytes:
    """One record, not compressed: a response, or a revisit if ``refers_to`` is given."""
    digest = digest32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = [VERSION, f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {p.date}", f"WARC-Target-URI: {header_text(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{digest32(block)}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class ShardWriter:
    """The files of one shard: temporary names, then renames, then the shard's manifest."""

    def __init__(self, root: str, shard: int, p: Archive):
        self.fs, self.root = fs.FileSystem.from_uri(root)
        self.shard, self.p = shard, p
        self.tmp = f"{self.root}/_tmp/{shard:06d}-{uuid.uuid4().hex}"
        self.fs.create_dir(self.tmp, recursive=True)
        self.files: list[dict] = []
        self.out = None

    def _open(self) -> None:
        self.name = f"shard-{self.shard:06d}-{len(self.files):05d}.warc.gz"
        self.out = self.fs.open_output_stream(f"{self.tmp}/{self.name}", compression=None)
        self.size, self.count, self.sha = 0, 0, hashlib.sha256()

    def write(self, raw: bytes) -> None:
        if self.out is None:
            self._open()
        member = gzip.compress(raw, self.p.level, mtime=0)
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.count += 1
        if self.size >= self.p.roll_bytes:
            self._roll()

    def _roll(self) -> None:
        self.out.close()
        self.files.append({"file": self.name, "records": self.count, "bytes": self.size, "sha256": self.sha.hexdigest()})
        self.out = None

    def commit(self) -> list[dict]:
        if self.out is not None:
            self._roll()
        for f in self.files:
            self.fs.move(f"{self.tmp}/{f['file']}", f"{self.root}/{f['file']}")
        with self.fs.open_output_stream(f"{self.tmp}/manifest") as out:
            out.write(json.dumps({"shard": self.shard, "files": self.files}, indent=1).encode())
        self.fs.move(f"{self.tmp}/manifest", f"{self.root}/shard-{self.shard:06d}.manifest.json")
        self.fs.delete_dir(self.tmp)
        return self.files


def _first_pages(pages: DataFrame, p: Archive) -> tuple[DataFrame, DataFrame]:
    """((key, weight) of every page, (page_id, digest, refers_to) of pages whose payload repeats)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    slim = durable(pages.select("page_id", F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("bytes")), "payloads")
    first = slim.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    first = first.where((F.col("n") > 1) & (F.col("bytes") >= p.revisit_from) & F.col("refers_to").isNotNull())
    repeats = slim.join(first.select("digest", "bytes", "refers_to"), ["digest", "bytes"]).select("page_id", "digest", "refers_to").distinct()
    weights = slim.select(F.coalesce("page_id", F.lit(LOWEST)).alias("key"), (F.col("bytes") + 512).alias("weight"))
    return weights, repeats


def write_archive(pages: DataFrame, root: str, p: Archive = DEFAULT) -> DataFrame:
    """Write ``pages`` (page_id, url, html) under ``root``; returns the manifest table (shard, file, records, bytes, sha256).

    A null html is an empty payload; a null url an empty header; a null page_id has no X-Page-Id, comes
    first in the order and is never referred to. Rows that repeat page_id and payload: the first is the
    response, the others revisit it. An empty table gives an archive without files.
    """
    spark = pages.sparkSession
    weights, repeats = _first_pages(pages, p)
    total = weights.agg(F.sum("weight")).first()[0] or 0
    cuts = range_cuts(weights, min(max(total // 1024, p.shard_bytes[0]), p.shard_bytes[1]))
    key = F.coalesce(F.col("page_id"), F.lit(LOWEST))
    rows = pages.select("page_id", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"))
    notes = repeats.select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    both = rows.unionByName(notes).withColumn("shard", shard_of(key, cuts))
    dealt = both.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "kind", "html", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, shard, page, first, seen = None, None, object(), {}, set()

        def done(w: ShardWriter) -> pa.RecordBatch:
            files = w.commit()
            cols = {"shard": pa.array([w.shard] * len(files), pa.int32()), "file": pa.array([f["file"] for f in files], pa.string()), "records": pa.array([f["records"] for f in files], pa.int64()), "bytes": pa.array([f["bytes"] for f in files], pa.int64()), "sha256": pa.array([f["sha256"] for f in files], pa.string())}
            return pa.RecordBatch.from_pydict(cols)
        for batch in batches:
            c = {n: batch.column(n) for n in batch.schema.names}
            for i in range(batch.num_rows):
                at, pid = c["shard"][i].as_py(), c["page_id"][i].as_py()
                if at != shard:
                    if out is not None:
                        yield done(out)
                    out, shard, page = ShardWriter(root, at, p), at, object()
                if pid != page:
                    page, first, seen = pid, {}, set()
                if c["kind"][i].as_py() == 0:
                    first[c["digest"][i].as_py()] = c["refers_to"][i].as_py()
                    continue
                payload = (c["html"][i].as_py() or "").encode()
                refers = None
                if first:
                    digest = hashlib.sha1(payload).hexdigest()
                    refers = first.get(digest)
                    if refers is not None and refers == pid and digest not in seen:
                        seen.add(digest)
                        refers = None
                out.write(record(pid, c["url"][i].as_py(), payload, refers, p))
        if out is not None:
            yield done(out)
    manifest = dealt.select("shard", "page_id", "kind", "url", "html", "digest", "refers_to").mapInArrow(write, "shard int, file string, records long, bytes long, sha256 string")
    path = f"{root}/_manifest"
    manifest.write.parquet(path)  # its _SUCCESS file is the archive's commit
    return spark.read.schema(manifest.schema).parquet(path)


def parse(stream: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an uncompressed stream, digests recomputed; a record that doesn't match raises."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no record begins here")
        head: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        size = int(head["content-length"])
        block = stream.read(size)
        if len(block) != size or digest32(block) != head["warc-block-digest"].removeprefix("sha1:"):
            raise ValueError(f"a block of {head.get('warc-record-id')} is damaged")
        http, _, payload = block.partition(b"\r\n\r\n")
        length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        if head["warc-type"] == "response" and (digest32(payload) != digest or len(payload) != length):
            raise ValueError(f"the payload of {head.get('warc-record-id')} is damaged")
        page, refers = head.get("x-page-id"), head.get("x-refers-to-page-id")
        yield {"page_id": int(page) if page else None, "url": head.get("warc-target-uri"), "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": head["warc-type"], "refers_to": int(refers) if refers else None}


def read_archive(manifest: DataFrame, root: str, payload: bool = False) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every record of the
    files in ``manifest``; a file is streamed, and a file whose record count differs raises."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payload else [])]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, wanted in zip(batch.column("file").to_pylist(), batch.column("records").to_pylist()):
                rows, count = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain, io.BufferedReader(plain, 1 << 20) as f:
                    for r in parse(f):
                        rows.append(r)
                        count += 1
                        if len(rows) >= 500:
                            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in zip(names, kinds)], names)
                            rows = []
                if count != wanted:
                    raise ValueError(f"{name} has {count} records, its manifest {wanted}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], t) for n, t in zip(names, kinds)], names)
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if payload else "")
    return manifest.select("file", "records").repartition(shuffle_partitions(manifest.sparkSession), "file").mapInArrow(read, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = fresh_path(spark, "warc")
    return read_archive(write_archive(table(spark, sf_dir, "pages").select("page_id", "url", "html"), root), root)


#: The first page of each payload answers, the others revisit it. DuckDB has SHA-1 as hex only, so the
#: base32 text is put together from the digest's 5-bit groups.
OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hx,
             min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((('0x' || substr(hx || '00', 1 + ((k * 5) // 4)::INT, 3))::BIGINT)
      // (CASE (k * 5) % 4 WHEN 0 THEN 128 WHEN 1 THEN 64 WHEN 2 THEN 32 ELSE 16 END)) % 32)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
