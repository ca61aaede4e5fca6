"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort_spark.llm.common import checked_broadcast, fresh_path, saved, text_batches

MAGIC = b"\x1f\x8b\x08"
#: Compressed bytes of an archive, about, after which a task starts another.
ARCHIVE_BYTES = 256 << 20
#: Bytes of an archive that one task owns.
SPLIT_BYTES = 4 << 20
READ_BYTES = 1 << 18
#: Tasks over which the splits are spread evenly, at most.
MOST_TASKS = 100_000
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str):
    """(file system, path) of a folder or file on any store that Arrow reaches; Spark's names of S3 are taken for it."""
    from pyarrow import fs

    scheme, colon, rest = uri.partition("://")
    if scheme == "file":
        return fs.LocalFileSystem(), rest
    return fs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One gzip member; a revisit holds the response's HTTP headers without its payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    target = "".join(f"%{ord(c):02X}" if c in "\r\n\t %" and c != "%" else c for c in url or "")
    head = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if refers_to is None else "revisit"),
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {target}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record for each row and return the manifest (path, bytes, records); paths keep the folder's scheme.

    Of records with equal payloads of at least ``least_bytes`` bytes, that with
    the largest id is a response and those with smaller ids revisit it; all
    others, and rows with a null id, are responses, so rows that share the
    largest id and a payload are responses all. A null payload is empty.

    Tasks write archives of their own names; only those that the committed
    manifest lists count, so a task that ran twice leaves no record twice.
    """
    text_batches(pages.sparkSession)
    html = F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    top = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n"))
    top = saved(top.where("n > 1").select("sha1", "top"), "revisited")
    marked = rows.join(checked_broadcast(top), "sha1", "left").withColumn("refers_to", F.when(F.col("page_id") < F.col("top"), F.col("top")))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        out, listed, size, n = None, [], 0, 0
        for frame in frames:
            for page, url, payload, refers in zip(frame["page_id"], frame["url"], frame["payload"], frame["refers_to"], strict=True):
                if out is None:
                    own = f"{uuid.uuid4().hex}.warc.gz"
                    name, out, size, n = f"{folder.rstrip('/')}/{own}", store.open_output_stream(f"{root.rstrip('/')}/{own}", compression=None), 0, 0
                payload = bytes(payload)
                raw = record(None if pd.isna(page) else int(page), url, payload, base32_sha1(payload), None if pd.isna(refers) else int(refers))
                out.write(raw)
                size, n = size + len(raw), n + 1
                if size >= archive_bytes:
                    out.close()
                    listed, out = [*listed, (name, size, n)], None
        if out is not None:
            out.close()
            listed.append((name, size, n))
        yield pd.DataFrame(listed, columns=["path", "bytes", "records"])

    # ids as text keep their nulls and all their digits in pandas
    packed = marked.select(F.col("page_id").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return saved(packed.mapInPandas(write, "path string, bytes long, records long"), "manifest")


def parse(raw: bytes) -> tuple:
    """(page_id, url, type, payload, payload_bytes, digest, refers_to) of a decoded record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: int(x[len("<urn:page:") : -1]) if len(x or "") > len("<urn:page:>") else None
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        size = len(payload)
        if (found := base32_sha1(payload)) != digest:
            raise ValueError(f"payload digest {found} is not {digest}")
    else:
        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
    return number(fields["warc-record-id"]), fields.get("warc-target-uri"), kind, payload if kind == "response" else None, size, digest, number(fields.get("warc-refers-to"))


def records_in(file, start: int, end: int) -> Iterator[bytes]:
    """Decoded records whose gzip member starts in [start, end) of a seekable file.

    From ``start`` on, each gzip magic is a candidate; it is a member if what it
    decodes to begins a WARC header. Members then follow one another; the last
    may reach beyond ``end``.
    """
    at, synced = start, False
    held = b""  # the file's bytes from ``at`` on, as far as read
    file.seek(at)
    while at < end:
        if not synced:
            found = held.find(MAGIC)
            while found < 0:
                keep = len(MAGIC) - 1
                at += max(0, len(held) - keep)
                held = held[-keep:] if len(held) > keep else held
                more = file.read(READ_BYTES)
                if not more or at >= end:
                    return
                held += more
                found = held.find(MAGIC)
            at, held = at + found, held[found:]
            if at >= end:
                return
        unpack, parts, fed, good = zlib.decompressobj(31), [], 0, True
        decoded = b""
        while not unpack.eof:
            if fed == len(held):
                more = file.read(READ_BYTES)
                if not more:
                    good = False
                    break
                held += more
            try:
                parts.append(unpack.decompress(held[fed:]))
            except zlib.error:
                good = False
                break
            fed = len(held)
            if not synced and len(decoded) < 5:
                decoded = b"".join(parts)
                if len(decoded) >= 5 and not decoded.startswith(b"WARC/"):
                    good = False
                    break
        whole = b"".join(parts) if good else b""
        if good and whole.startswith(b"WARC/"):
            yield whole
            used = len(held) - len(unpack.unused_data)
            at, held, synced = at + used, held[used:], True
            if not held:
                held = file.read(READ_BYTES)
                if not held:
                    return
        else:
            at, held, synced = at + 1, held[1:], False


def read_archives(spark: SparkSession, manifest: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records of the archives in ``manifest`` (path, bytes), each read by the task that owns its start.

    Columns: page_id, url, record_type, payload, payload_bytes, payload_digest,
    refers_to; payload is null for revisits.
    """
    splits = manifest.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("long"))).alias("start"))
    schema = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def frame_of(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"], dtype=object)
            return out.assign(page_id=out["page_id"].astype("Int64"), refers_to=out["refers_to"].astype("Int64"), payload_bytes=out["payload_bytes"].astype("int64"))

        for frame in frames:
            for path, start in zip(frame["path"], frame["start"], strict=True):
                store, name = file_system(path)
                with store.open_input_file(name) as file:
                    rows, held = [], 0
                    for raw in records_in(file, start, start + split_bytes):
                        rows.append(parse(raw))
                        held += len(raw)
                        if held > 8 << 20:
                            yield frame_of(rows)
                            rows, held = [], 0
                    yield frame_of(rows)

    # a stated number, as rows are too small for adaptive execution to keep them apart
    n = manifest.agg(F.sum(F.ceil(F.greatest(F.col("bytes"), F.lit(1)) / split_bytes))).first()[0] or 1
    return splits.repartition(min(int(n), MOST_TASKS)).mapInPandas(read, schema)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    manifest = write_archives(pages, fresh_path(spark, "warc"))
    return read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (
  SELECT *, list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST((((CAST(('0x' || substr(hex || '00', CAST(1 + (5 * i) // 4 AS INTEGER), 2)) AS BIGINT)) >> CAST(3 - (5 * i) % 4 AS INTEGER)) & 31) AS INTEGER), 1)) AS c
  FROM p),
g AS (SELECT hex, max(page_id) AS top FROM p GROUP BY hex)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, array_to_string(c, '') AS payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < top THEN top END AS refers_to
FROM bits JOIN g USING (hex)
"""
