"""WARC archives, each with a Zstandard dictionary of its own in a leading skippable frame.

An archive holds the records of one partition: a skippable frame (magic 0x184D2A5D) with the dictionary, then each
record as a Zstandard frame of its own, so that a reader can start at any record. The dictionary is trained on the
first records of the archive, up to ``sample_bytes``.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_folder, text_slices

SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1\r\n"
#: A fixed date: records made of the same rows are the same bytes, whichever attempt writes them.
DATE = "1970-01-01T00:00:00Z"


def record(page_id, url: str | None, payload: bytes | None, digest: str, size: int, refers_to=None) -> bytes:
    """One record: a response with its payload, or (payload None) a revisit of the response ``refers_to``."""
    head = [
        ("WARC-Type", "revisit" if payload is None else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", quote(url or "", safe=":/?#[]@!$&'()*+,;=%~-._")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("X-Payload-Length", str(size)),
    ]
    if payload is None:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
        body = b""
    else:
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    head.append(("Content-Length", str(len(body))))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; its payload must have the length and digest that the headers give."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != VERSION.decode().strip():
        raise ValueError("not a WARC record")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[: int(head["Content-Length"])]
    payload = body.partition(b"\r\n\r\n")[2]
    if head["WARC-Type"] == "response":
        if len(payload) != int(head["X-Payload-Length"]) or hashlib.sha256(payload).hexdigest() != head["WARC-Payload-Digest"][7:]:
            raise ValueError(f"damaged payload of {head['WARC-Record-ID']}")
    return head, payload


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the samples are too few for training, their own first bytes serve as one."""
    if sum(map(len, samples)) > 16 * size and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def write_archive(stream, records, dict_bytes: int = 1 << 15, sample_bytes: int = 1 << 22, level: int = 3) -> tuple[int, int]:
    """Writes records (an iterable of bytes) to a binary stream: (records, bytes written)."""
    records = iter(records)
    held, size = [], 0
    for data in records:
        held.append(data)
        size += len(data)
        if size >= sample_bytes:
            break
    words = dictionary(held, dict_bytes)
    compress = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True).compress
    stream.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
    written = 8 + len(words)
    n = 0
    for part in (held, records):
        for data in part:
            frame = compress(data)
            stream.write(frame)
            written += len(frame)
            n += 1
    return n, written


def read_archive(stream, block: int = 1 << 18):
    """The records of an archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary")
    words = zstandard.ZstdCompressionDict(stream.read(size))
    reader = zstandard.ZstdDecompressor(dict_data=words)
    left = b""
    while True:
        decoder, out = reader.decompressobj(), []
        while not decoder.eof:
            data = left or stream.read(block)
            left = b""
            if not data:
                if out:
                    raise ValueError("the archive ends within a record")
                return
            out.append(decoder.decompress(data))
        left = decoder.unused_data
        yield b"".join(out)


def classify(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100) -> DataFrame:
    """(key, url, html, size, digest, refers_to): refers_to is null for responses, else the smallest key with an equal payload."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key), F.col(url), body.alias(html), F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"))
    first = (
        rows.filter((F.col("size") >= least) & F.col(key).isNotNull())
        .groupBy("digest")  # summed up on the map side first: a payload that many pages share is one row a task
        .agg(F.min(key).alias("first"), F.count("*").alias("copies"))
        .filter("copies > 1")
        .select("digest", "first")
    )
    # small rows meet by digest, where a payload with many pages may be hot (adaptive execution splits it)
    later = rows.filter((F.col("size") >= least) & F.col(key).isNotNull()).select(F.col(key).alias("later"), "digest").join(first, "digest")
    later = later.filter(F.col("later") > F.col("first")).select("later", "first", F.col("digest").alias("same")).distinct()
    # a key alone decides, unless pages repeat it with other payloads: then the digest does
    return rows.join(later, (F.col(key) == F.col("later")) & (F.col("digest") == F.col("same")), "left").select(
        key, url, html, "size", "digest", F.col("first").alias("refers_to")
    )


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100, archives: int | None = None) -> DataFrame:
    """Writes every row of ``pages`` to archives in ``folder`` (a URI that all executors reach): (path, records, bytes).

    A null text or url is an empty one. Records with equal payloads of at least ``least`` bytes: that with the smallest
    key is the response, the others revisit it. Rows that repeat key and payload are all of the same type; a null key
    makes a response. No rows, no archives. Other columns are not read. An attempt writes to a name of its own and is
    moved to the partition's name when whole, so that a retried task leaves the same archives.
    """
    rows = classify(pages, key, url, html, least)
    if archives:
        rows = rows.repartition(archives, key)

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rest = (b for b in batches if b.num_rows)
        head = next(rest, None)
        if head is None:
            return
        store, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        store.create_dir(base, recursive=True)
        name = f"{base}/part-{part:05d}.warc.zst"
        attempt = f"{base}/.{part:05d}-{uuid.uuid4().hex}"

        def records():
            for batch in (x for whole in ([head], rest) for b in whole for x in text_slices([b], html, 1 << 23)):
                for k, u, h, size, digest, ref in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    yield record(k, u, None if ref is not None else h.encode(), digest, size, ref)

        with store.open_output_stream(attempt, compression=None) as out:
            n, size = write_archive(out, records())
        try:
            store.move(attempt, name)
        except OSError:  # stores that don't replace: another attempt has left the same records there
            if store.get_file_info(name).type == fs.FileType.NotFound:
                raise
            store.delete_file(attempt)
            size = store.get_file_info(name).size
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["path", "records", "bytes"])

    return rows.mapInArrow(run, "path string, records long, bytes long")


def read(manifest: DataFrame, folder: str, batch_rows: int = 2000) -> DataFrame:
    """The records of the archives that ``write`` has listed: (page_id, payload_bytes, payload_digest, record_type, refers_to, payload).

    Each archive is read as a stream, a record in memory at a time; payload is null for revisits.
    """

    def number(text):
        inner = text[len("<urn:page:") : -1]
        return int(inner) if inner else None

    def run(batches):
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        store, _ = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with store.open_input_stream(path, compression=None) as stream:
                    rows, size = [], 0
                    for data in read_archive(stream):
                        head, payload = parse(data)
                        kind = head["WARC-Type"]
                        rows.append((number(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"][7:], kind, number(head["WARC-Refers-To"]) if kind == "revisit" else None, payload.decode() if kind == "response" else None))
                        size += len(payload)
                        if len(rows) >= batch_rows or size >= 1 << 23:
                            yield out(rows)
                            rows, size = [], 0
                    if rows:
                        yield out(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"
    return manifest.select("path").mapInArrow(run, schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, written to archives and read back from them."""
    folder = new_folder(spark, "warc")
    manifest = cut(write(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder))
    manifest = manifest.repartition(max(1, spark.sparkContext.defaultParallelism), F.xxhash64("path"))
    return read(manifest, folder).drop("payload")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND p.payload_bytes >= 100
"""
