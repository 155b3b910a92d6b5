"""WARC archives as a chunked record table.

Writing: records go through Spark as rows of (record, chunk number), a chunk being at most
`CHUNK_BYTES` of payload, so no Python worker ever holds a whole record. Each task streams its rows
into gzip members, one per record, and reports its archives in a manifest; only archives in the stored
manifest count, so a repeated task leaves at most files that nobody reads.

Reading: each archive is streamed; a record's payload comes out as chunk rows that carry the bytes
and the SHA-1 of the payload so far, so the last chunk has the digest of the whole.

Archives are opened through `pyarrow.fs`, which knows local, HDFS and object store addresses.

Of records with equal payloads of at least `MIN_REVISIT_BYTES`, the one with the largest record key is
the response and the others revisit it.

Defined results: a NULL html is an empty payload; a NULL url is left out; rows with a NULL key are
never revisited unless all equal rows have none, when all are responses; rows that share the largest
key are all responses; empty input gives no archives and no rows.
"""

import gzip
import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notecode.sources.shared_folder import new_path, stored

CHUNK_BYTES = 1 << 18
ARCHIVE_BYTES = 1 << 28
MIN_REVISIT_BYTES = 1000
FOLD_BYTES = 1 << 22
MOST_TASKS = 100_000

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"

MANIFEST = "archive string, records long, payload_bytes long"
CHUNKS = (
    "archive string, record_id string, refers_to string, record_type string, url string, "
    "chunk_no int, last boolean, chunk binary, payload_bytes long, payload_digest string, digest_ok boolean"
)


def revisits(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """`key`, `url`, `payload`, `payload_bytes`, `digest` (hex SHA-1) and `refers_to` per page.

    Only digests are grouped. The groups are stored first, so that pages and groups are joined from
    two plain shuffles, in which Spark can split the rows of a frequent payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(key).alias("rank"), "url", payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    groups = (
        rows.filter(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.max("rank").alias("kept"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(F.col("digest").alias("of"), "kept")
    )
    groups = stored(groups, "warc-groups")
    # Short payloads have a join key of their own each, as no group holds them.
    own = F.concat(F.lit("short"), F.coalesce("key", F.lit("")))
    joined = F.when(F.col("payload_bytes") >= MIN_REVISIT_BYTES, F.col("digest")).otherwise(own)
    refers = F.when(~F.col("rank").eqNullSafe(F.col("kept")), F.col("kept")).cast("string")
    return (
        rows.withColumn("join_key", joined)
        .join(groups, F.col("join_key") == F.col("of"), "left")
        .select("key", "url", "payload", "payload_bytes", "digest", refers.alias("refers_to"))
    )


def chunk_rows(records: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per record and chunk; revisits and empty payloads have one row without bytes."""
    whole = F.when(F.col("refers_to").isNull(), F.col("payload_bytes")).otherwise(0)
    last = F.greatest(F.ceil(whole / chunk_bytes).cast("int") - 1, F.lit(0))
    rows = records.select("*", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"), last.alias("last_no"))
    begin = F.col("chunk_no") * chunk_bytes + 1
    chunk = F.when(F.col("refers_to").isNull(), F.substring("payload", begin, F.lit(chunk_bytes)))
    return rows.select("key", "url", "payload_bytes", "digest", "refers_to", "chunk_no", "last_no", chunk.alias("chunk"))


def _record_head(row: dict) -> bytes:
    """The WARC header and the HTTP header of a record."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_bytes']}\r\n\r\n"
    ).encode()
    refers = row["refers_to"]
    body = 0 if refers is not None else row["payload_bytes"]
    lines = [
        VERSION,
        f"WARC-Type: {'response' if refers is None else 'revisit'}",
        f"WARC-Record-ID: {_identifier(row['key'])}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{b32encode(bytes.fromhex(row['digest'])).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + body}",
    ]
    if row["url"] is not None:
        lines.append(f"WARC-Target-URI: {quote(row['url'], safe=_URL_SAFE)}")
    if refers is not None:
        lines += [f"WARC-Refers-To: {_identifier(refers)}", f"WARC-Profile: {PROFILE}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + http


_URL_SAFE = "%:/?#[]@!$&'()*+,;=~"


def _identifier(key: str | None) -> str:
    return "<urn:record:>" if key is None else f"<urn:record:k{quote(key, safe='')}>"


def _key(identifier: str) -> str | None:
    from urllib.parse import unquote

    inner = identifier.removeprefix("<urn:record:").removesuffix(">")
    return unquote(inner[1:]) if inner else None


def _open(path: str, mode: str) -> BinaryIO:
    from pyarrow.fs import FileSystem

    system, inner = FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    if mode == "r":
        return system.open_input_stream(inner, compression=None, buffer_size=1 << 20)
    system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)


def write_archives(chunks: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the chunk rows as archives below the folder; returns the stored manifest.

    The rows of a record follow each other in their partition, as `chunk_rows` makes them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = path = member = None
        records = total = 0

        def report() -> pa.RecordBatch:
            sink.close()
            return pa.RecordBatch.from_pydict(
                {"archive": [path], "records": [records], "payload_bytes": [total]},
                pa.schema([("archive", pa.string()), ("records", pa.int64()), ("payload_bytes", pa.int64())]),
            )

        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("key", "url", "payload_bytes", "digest", "refers_to", "chunk_no", "last_no")}
                if row["chunk_no"] == 0:
                    if sink is not None and sink.tell() >= archive_bytes:
                        yield report()
                        sink = None
                    if sink is None:
                        path, records, total = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        sink = _open(path, "w")
                    member = gzip.GzipFile(fileobj=sink, mode="wb", mtime=0, compresslevel=4)
                    member.write(_record_head(row))
                    records += 1
                    total += row["payload_bytes"]
                chunk = batch.column("chunk")[i]
                if chunk.is_valid:
                    member.write(chunk.as_buffer())
                if row["chunk_no"] == row["last_no"]:
                    member.write(b"\r\n\r\n")
                    member.close()
        if sink is not None:
            yield report()

    return stored(chunks.mapInArrow(run, MANIFEST), "warc-manifest")


def _headers(source: BinaryIO) -> tuple[dict[str, str], int]:
    """The header lines up to the empty one, and how many bytes they take."""
    found, size = {}, 0
    while True:
        line = source.readline()
        size += len(line)
        if not line.strip():
            return found, size
        name, _, value = line.decode().partition(":")
        found[name.strip().lower()] = value.strip()


def _records(source: BinaryIO, chunk_bytes: int) -> Iterator[dict]:
    """The chunk rows of an archive, read as a stream."""
    while first := source.readline():
        if not first.strip():
            continue
        if first.strip().decode() != VERSION:
            raise ValueError(f"not the beginning of a record: {first[:40]!r}")
        warc, _ = _headers(source)
        source.readline()  # the status line
        http, size = _headers(source)
        left = int(warc["content-length"]) - size - len(b"HTTP/1.1 200 OK\r\n")
        declared = warc["warc-payload-digest"].removeprefix("sha1:")
        row = {
            "record_id": _key(warc["warc-record-id"]),
            "refers_to": _key(warc["warc-refers-to"]) if "warc-refers-to" in warc else None,
            "record_type": warc["warc-type"],
            "url": warc.get("warc-target-uri"),
        }
        if row["record_type"] == "revisit":
            from base64 import b32decode

            digest = b32decode(declared).hex()
            yield row | {"chunk_no": 0, "last": True, "chunk": None, "payload_bytes": int(http["content-length"]), "payload_digest": digest, "digest_ok": None}
            continue
        sha, done, number = hashlib.sha1(), 0, 0
        while True:
            data = source.read(min(chunk_bytes, left))
            if left and not data:
                raise ValueError(f"archive ends inside record {row['record_id']}")
            left -= len(data)
            done += len(data)
            sha.update(data)
            yield row | {
                "chunk_no": number,
                "last": left == 0,
                "chunk": data,
                "payload_bytes": done,
                "payload_digest": sha.hexdigest(),
                "digest_ok": b32encode(sha.digest()).decode() == declared if left == 0 else None,
            }
            number += 1
            if left == 0:
                break


def read_archives(
    manifest: DataFrame, chunk_bytes: int = CHUNK_BYTES, with_chunks: bool = True
) -> DataFrame:
    """Chunk rows (`CHUNKS`) of the archives; `payload_bytes` and `payload_digest` are so far.

    Without the bytes, only the last row of each record is returned.
    """
    schema = pa.schema(
        [
            ("archive", pa.string()),
            ("record_id", pa.string()),
            ("refers_to", pa.string()),
            ("record_type", pa.string()),
            ("url", pa.string()),
            ("chunk_no", pa.int32()),
            ("last", pa.bool_()),
            ("chunk", pa.binary()),
            ("payload_bytes", pa.int64()),
            ("payload_digest", pa.string()),
            ("digest_ok", pa.bool_()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                rows, held = [], 0
                with _open(path, "r") as raw, gzip.GzipFile(fileobj=raw) as source:
                    for row in _records(source, chunk_bytes):
                        if not with_chunks:
                            if not row["last"]:
                                continue
                            row["chunk"] = None
                        rows.append(row | {"archive": path})
                        held += 200 + len(row["chunk"] or b"")
                        if held >= FOLD_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    # One archive per partition: the rows are tiny, so Spark must not merge their partitions.
    spread = manifest.select("archive").repartition(max(1, min(manifest.count(), MOST_TASKS)), "archive")
    return spread.mapInArrow(run, CHUNKS)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write the pages as archives, read them back and report each record."""
    records = chunk_rows(revisits(pages.select("page_id", "url", "html")))
    manifest = write_archives(records, new_path(spark, "warc"))
    read = read_archives(manifest, with_chunks=False)
    kind = pages.schema["page_id"].dataType

    def as_id(c: str) -> Column:
        return F.col(c).cast(kind)

    return read.filter("last").select(
        as_id("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        as_id("refers_to").alias("refers_to"),
        "digest_ok",
    )
