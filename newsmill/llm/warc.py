"""WARC archives: writing, normalising monolithic gzip files, and reading back by offset.

``write_monolithic`` makes one archive per partition as a single gzip stream, the form that hides record offsets.
``normalise`` inflates such a file once, front to back, rewrites every record as a gzip member of its own and writes a sidecar
index (a JSON line per record: offset, length, type, id). ``read_indexed`` then fetches records by seeking. Each step holds
one record and a chunk of the stream. Files appear under their final name only when whole, so tasks may be repeated.

Pages with equal payloads of at least ``min_bytes`` bytes are stored once: the row with the largest page_id is the response,
the others are revisits that refer to it.

Rules for odd input: null html is an empty payload; a null url is written as ``urn:x-page:no-url``; a row with null page_id is
always a response and comes back with a null page_id; rows that share the largest page_id and its payload are all responses;
repeated rows come back as often as they were given; an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import joined, new_folder, parted, pieces, stored

#: Payload digests that are broadcast at most (about 60 bytes each); of more, those pages are shuffled that may have one.
BROADCAST_ROWS = 500_000
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "file string, offset long, length long, type string, id string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


# --- record format -----------------------------------------------------------------------------


def record_id(page_id, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def _block(headers: list[tuple[str, str]], body: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(body)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + body + b"\r\n\r\n"


def record(page_id, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """The bytes of one record; ``refers_to`` is the response's page_id for a revisit, else None."""
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~") if url else "urn:x-page:no-url"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-ID", str(page_id)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return _block(headers, http + payload)
    return _block([*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Page", str(refers_to))], http)


def headers_of(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def inflated(stream, chunk: int = CHUNK):
    """Chunks of the plain bytes of a gzip stream of one or many members."""
    z = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            plain = z.decompress(data, 8 * chunk)
            if plain:
                yield plain
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, zlib.decompressobj(31)
    if tail := z.flush():
        yield tail


def records(chunks):
    """(header bytes, whole record bytes) of a plain WARC stream."""
    buf, at = bytearray(), 0
    size = head_end = None
    for chunk in chunks:
        del buf[:at]
        at = 0
        buf += chunk
        while True:
            if size is None:
                head_end = buf.find(b"\r\n\r\n", at)
                if head_end < 0:
                    break
                size = head_end + 4 - at + int(headers_of(bytes(buf[at:head_end]))["content-length"]) + 4
                head_end -= at
            if len(buf) - at < size:
                break
            whole = bytes(buf[at : at + size])
            yield whole[:head_end], whole
            at += size
            size = None
    if len(buf) > at:
        raise ValueError("the archive ends inside a record")


def member(plain: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(plain) + z.flush()


# --- Spark steps -------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, digest, refers_to. The table of repeated digests is broadcast if it is small; else a bitmap of fixed size picks the pages
    that may have one, and only those are shuffled, copies of one payload over several tasks."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    shared = stored(
        p.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first"),
        "warc-digests",
    )
    if shared.count() <= BROADCAST_ROWS:
        out = p.join(F.broadcast(shared), "digest", "left")
    else:
        may, cannot = parted(p, "digest", shared)
        found = joined(may, shared, "digest", ["page_id"], "left").select(*p.columns, "first")
        # A shuffle leaves rows in any order; a repeated task must write the same file.
        out = found.sortWithinPartitions("digest", "page_id", "url").union(cannot.withColumn("first", F.lit(None).cast("long")))
    return out.withColumn("refers_to", F.when(F.col("page_id") < F.col("first"), F.col("first"))).drop("first")


def write_monolithic(rows: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """One gzip stream per partition of ``rows`` (see :func:`with_revisits`); returns the file names and record counts, stored."""

    def run(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        rows = (r for b in pieces(batches, 200) for r in b.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        name = f"part-{part:06d}.warc.gz"
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        with files.writing(f"{folder}/{name}") as out:
            r = first
            while r is not None:
                out.write(z.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], date)))
                n += 1
                r = next(rows, None)
            out.write(z.flush())
        yield pa.RecordBatch.from_pydict({"file": [name], "n": [n]})

    cols = ["page_id", "url", "payload", "digest", "refers_to"]
    return stored(rows.select(*cols).mapInArrow(run, "file string, n long"), "warc-files")


def normalise(names: DataFrame, source: str, folder: str, level: int = 6) -> DataFrame:
    """Rewrite the archives named by ``names.file`` under ``source``, a task each, as record-wise members with a sidecar ``.idx``."""

    def run(batches):
        for b in batches:
            for name in b.column(0).to_pylist():
                at, lines = 0, 0
                with files.reading(f"{source}/{name}") as raw, files.writing(f"{folder}/{name}") as out, files.writing(f"{folder}/{name}.idx") as idx:
                    for head, whole in records(inflated(raw)):
                        h = headers_of(head)
                        m = member(whole, level)
                        out.write(m)
                        line = {"file": name, "offset": at, "length": len(m), "type": h.get("warc-type"), "id": h.get("warc-record-id")}
                        idx.write(json.dumps(line).encode() + b"\n")
                        at += len(m)
                        lines += 1
                yield pa.RecordBatch.from_pydict({"file": [name], "n": [lines]})

    n = names.count()
    return stored(names.select("file").repartitionByRange(max(1, n), "file").mapInArrow(run, "file string, n long"), "warc-normal")


def index_of(spark: SparkSession, folder: str, any_file: bool = True) -> DataFrame:
    """The sidecar indexes of a folder, a row per record."""
    if not any_file:
        return spark.createDataFrame([], INDEX)
    return spark.read.schema(INDEX).json(f"{folder}/*.idx")


def read_indexed(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Records fetched by the index's offsets; a response's digest is computed anew and must equal its header's."""

    def parsed(plain: bytes):
        head, _, block = plain.partition(b"\r\n\r\n")
        h = headers_of(head)
        http, _, payload = block.partition(b"\r\n\r\n")
        payload = payload[:-4] if h["warc-type"] == "response" else b""
        size = int(headers_of(http)["content-length"])
        digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
        if h["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"record {h.get('warc-record-id')} doesn't match its digest")
        ref, page = h.get("x-refers-to-page"), h.get("x-page-id")
        return page and int(page), h.get("warc-target-uri"), h["warc-type"], size, digest, ref and int(ref), payload if with_payload else None

    schema = pa.schema(
        [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]
    )

    def run(batches):
        name = stream = None
        for b in pieces(batches, 200):
            rows = []
            for file, offset, length in zip(*(b.column(i).to_pylist() for i in range(3))):
                if file != name:
                    if stream:
                        stream.close()
                    name, stream = file, files.reading(f"{folder}/{file}")
                stream.seek(offset)
                rows.append(parsed(zlib.decompress(stream.read(length), 31)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        if stream:
            stream.close()

    return index.select("file", "offset", "length").mapInArrow(run, RECORD)


def op8_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    whole, normal = new_folder(spark, "warc-monolithic"), new_folder(spark, "warc")
    names = write_monolithic(with_revisits(pages), whole)
    done = normalise(names, whole, normal)
    files.delete_folder(spark, whole)
    records_ = read_indexed(index_of(spark, normal, done.count() > 0), normal, with_payload=False)
    return records_.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM p LEFT JOIN m ON p.payload_digest = m.payload_digest
"""
