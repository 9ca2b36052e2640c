"""WARC archives: a deterministic sharded writer and its reader.

The writer range-sorts the records, each task streams its range into archive files that roll over by
*compressed* size, and every record gets freshly generated headers and digests.  A file is written under
a temporary name that no other attempt shares, moved to its final name when whole, and counts only once
the manifest names it; an attempt that is lost or repeated leaves nothing that a reader would see.
"""

from __future__ import annotations

import base64
import datetime as dt
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut, scratch, table

SMALLEST_SHARED = 100  # bytes from which equal payloads become revisits
ROLL_BYTES = 64 << 20
SMALL_REVISITS = 500_000
EPOCH = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

WRITTEN = "path string, records long, compressed_bytes long, sha256 string"
READ = (
    "page_id long, url string, record_type string, refers_to long, payload_digest string, "
    "payload_bytes long, payload binary, path string, position long, record_id string, refers_id string"
)


def _digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def _record_id(page_id: int | None, url: str, digest: str, n: int) -> str:
    """n counts the equal records before it, so the first of them can be named from anywhere."""
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{n}|{digest}|{url}").urn


def _block(kind: str, headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(body)))])
    return head.encode("utf-8", "surrogatepass") + b"\r\n" + body + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    """A header value holds no line break; other characters stay."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 else c for c in url or "")


def _http(body: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()


def _record(kind: str, page_id: int | None, url: str, n: int, payload: bytes, refers: tuple[int, str] | None) -> bytes:
    digest = _digest(payload)
    block = _http(payload) + (payload if refers is None else b"")
    headers = [("WARC-Record-ID", f"<{_record_id(page_id, url, digest, n)}>"), ("WARC-Date", EPOCH), ("WARC-Target-URI", url), ("X-Page-Id", "" if page_id is None else str(page_id))]
    if refers is not None:
        headers += [("WARC-Refers-To", f"<{_record_id(*refers, digest, 0)}>"), ("WARC-Refers-To-Target-URI", refers[1]), ("WARC-Refers-To-Date", EPOCH), ("X-Refers-To-Page-Id", str(refers[0])), ("WARC-Profile", PROFILE)]
    headers += [("WARC-Payload-Digest", digest), ("X-Payload-Length", str(len(payload))), ("WARC-Block-Digest", _digest(block)), ("Content-Type", "application/http; msgtype=response")]
    return _block(kind, headers, block)


def _info(shard: int, n: int) -> bytes:
    """The record that opens a file."""
    body = b"format: WARC File Format 1.1\r\nsoftware: counterpoise\r\n"
    return _block("warcinfo", [("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'info|{shard}|{n}').urn}>"), ("WARC-Date", EPOCH), ("WARC-Block-Digest", _digest(body)), ("Content-Type", "application/warc-fields")], body)


def _member(raw: bytes, level: int) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(raw) + pack.flush()


class _Roll:
    """One archive file at a time: temporary name, then a move to its place."""

    def __init__(self, uri: str, shard: int, attempt: str) -> None:
        self.store, self.root = pafs.FileSystem.from_uri(uri)
        self.shard, self.attempt, self.n, self.out = shard, attempt, 0, None
        self.store.create_dir(f"{self.root}/_temporary/{attempt}", recursive=True)

    def put(self, member: bytes) -> None:
        if self.out is None:
            head = _member(_info(self.shard, self.n), 6)
            self.temp = f"{self.root}/_temporary/{self.attempt}/{self.n:05d}"
            self.out, self.size, self.records, self.sha = self.store.open_output_stream(self.temp, compression=None), len(head), 0, hashlib.sha256(head)
            self.out.write(head)
        self.out.write(member)
        self.size, self.records = self.size + len(member), self.records + 1
        self.sha.update(member)

    def close(self) -> dict | None:
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        # Equal bytes get an equal name; a repeated attempt replaces what it would have written anyway.
        name = f"shard-{self.shard:05d}-{self.n:05d}-{self.sha.hexdigest()[:16]}.warc.gz"
        self.store.move(self.temp, f"{self.root}/{name}")
        self.n += 1
        return {"path": name, "records": self.records, "compressed_bytes": self.size, "sha256": self.sha.hexdigest()}


def write(records: DataFrame, uri: str, roll_bytes: int = ROLL_BYTES, level: int = 6, shards: int | None = None) -> str:
    """Write ``records`` (page_id, url, html, refers_to, refers_url) below ``uri``; return the manifest's path.

    Order: by page_id, then url, then html.  Nulls: html is written as an empty payload, url as an empty
    target, a page_id as an empty field.  An empty table gives a manifest without files.
    """
    spark = records.sparkSession

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get()
        roll, done, last, same = _Roll(uri, at.partitionId(), f"{at.partitionId()}-{at.taskAttemptId()}-{uuid.uuid4().hex}"), [], None, 0
        for batch in batches:
            for page_id, url, html, refers, of in zip(*(batch.column(i).to_pylist() for i in range(5))):
                payload, url = (html or "").encode("utf-8", "surrogatepass"), _clean(url)
                same = same + 1 if (page_id, url, payload) == last else 0
                last = (page_id, url, payload)
                raw = _record("response", page_id, url, same, payload, None) if refers is None else _record("revisit", page_id, url, same, payload, (refers, _clean(of)))
                roll.put(_member(raw, level))
                if roll.size >= roll_bytes:
                    done.append(roll.close())
        done += [x for x in [roll.close()] if x]
        if done:
            yield pa.RecordBatch.from_pylist(done)

    keys = ("page_id", "url", "html", "refers_to", "refers_url")
    n = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = records.select(*keys).repartitionByRange(n, "page_id", "url").sortWithinPartitions("page_id", "url", "html")
    # Each row names a finished file; the rows are few (one a file), and only these are committed.
    files = cut(rows.mapInArrow(task, WRITTEN), "warc-files").orderBy("path")
    manifest = f"{uri}/manifest-{uuid.uuid4().hex}"
    files.coalesce(1).write.json(f"{manifest}.tmp")
    jvm = spark.sparkContext._jvm
    at, to = jvm.org.apache.hadoop.fs.Path(f"{manifest}.tmp"), jvm.org.apache.hadoop.fs.Path(manifest)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.rename(at, to)
    store.delete(jvm.org.apache.hadoop.fs.Path(f"{uri}/_temporary"), True)
    return manifest


def _parse(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:] if x)


def records_of(stream, path: str) -> Iterator[dict]:
    """The responses and revisits of one archive; digests and lengths of all records are checked."""
    at = 0
    while True:
        line = stream.readline()
        if not line:
            return
        head = bytearray(line)
        while (line := stream.readline()) not in (b"\r\n", b""):
            head += line
        h = _parse(bytes(head))
        body = stream.read(int(h["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n" or _digest(body) != h["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {at} in {path}")
        if h["WARC-Type"] == "warcinfo":
            continue
        payload = body.partition(b"\r\n\r\n")[2] if h["WARC-Type"] == "response" else None
        if payload is not None and _digest(payload) != h["WARC-Payload-Digest"]:
            raise ValueError(f"payload digest differs at record {at} in {path}")
        refers = h.get("X-Refers-To-Page-Id", "")
        yield {"page_id": int(h["X-Page-Id"]) if h["X-Page-Id"] else None, "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "refers_to": int(refers) if refers else None, "record_id": h["WARC-Record-ID"], "refers_id": h.get("WARC-Refers-To"), "payload_digest": h["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": int(h["X-Payload-Length"]), "payload": payload, "path": path, "position": at}
        at += 1


def read(spark: SparkSession, manifest: str, uri: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names, one file at a time in each task.

    ``payloads=False`` leaves the payload column null (it is checked against its digest all the same).
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("path", pa.string()), ("position", pa.int64()), ("record_id", pa.string()), ("refers_id", pa.string())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{path}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    held, size = [], 0
                    for r in records_of(stream, path):
                        size += len(r["payload"] or b"") if payloads else 200
                        held.append(r if payloads else r | {"payload": None})
                        if size > 4 << 20 or len(held) >= 10_000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    files = spark.read.schema(WRITTEN).json(manifest).select("path")
    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "path").mapInArrow(task, READ)


def with_refers(pages: DataFrame) -> DataFrame:
    """page_id, url, html, refers_to, refers_url: for payloads of at least SMALLEST_SHARED bytes that an earlier page
    (smaller page_id) has too, that page's id and url; else null.

    Digests alone are compared; the pages are then joined to the revisits found, which are broadcast if there are
    at most ``SMALL_REVISITS`` (about 80 bytes each), and else by a join that can be split.  A payload that a third
    of the pages share is one row on the small side of the digest join.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.when(F.octet_length("html") >= SMALLEST_SHARED, F.unhex(F.sha2("html", 256))))
    short = cut(rows.filter("digest is not null and page_id is not null").select("page_id", "url", "digest"), "warc-digests")
    first = short.groupBy("digest").agg(F.min(F.struct("page_id", "url")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("f.page_id").alias("refers_to"), F.col("f.url").alias("refers_url"))
    revisits = cut(short.drop("url").join(first, "digest").filter("refers_to < page_id").distinct(), "warc-revisits")
    if revisits.count() <= SMALL_REVISITS:
        revisits = F.broadcast(revisits)
    return rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to", "refers_url")


def round_trip(pages: DataFrame, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write ``pages`` as WARC into the shared folder and read the archives back.

    Returns page_id, payload_bytes, payload_digest, record_type, refers_to, path, position, one row per
    input row.  Repeated rows stay (the second copy of a page_id has no smaller id to refer to and is a
    response); null html is an empty payload; extra columns of the input are ignored.
    """
    spark, uri = pages.sparkSession, scratch(pages.sparkSession, "warc")
    manifest = write(with_refers(pages), uri, roll_bytes)
    return read(spark, manifest, uri, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "path", "position")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages")).drop("path", "position")


OP7_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""
