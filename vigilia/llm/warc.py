"""WARC archives: a writer with revisit records and a splittable reader.

Writer: each task streams its rows into one archive, a gzip member per record.
Of records with equal payloads that with the largest id is a `response`; the
others are `revisit` records which name it.

Reader: files are cut into byte ranges without looking inside. A task scans its
range for gzip magic, takes a place as a record's start when the bytes inflate
to a WARC header, and owns the records that start inside its range; the last of
them may end beyond it. A lost task is simply run again on its range.

A payload may itself hold an archive's bytes, and a range may begin amid them.
So a first pass tells of each range where its last member ends, and a range is
read from where the members of all ranges before it end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from vigilia.llm.common import arrow_map, cut, shared_dir

#: Fixed values of the formats: the start of a gzip member with deflate, a WARC version line, the digest-revisit profile.
GZIP_MAGIC = b"\x1f\x8b\x08"
WARC_VERSION = b"WARC/1."
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SPLIT_BYTES = 8 << 20
CHUNK = 1 << 18
MANIFEST = "path string, bytes long, records long"
RECORD = "path string, start long, record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary, digest_ok boolean"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def encode_record(record_id: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One gzip member. A revisit holds the HTTP head alone, whose Content-Length is that of the full payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {' '.join(url.split())}")
    if refers_to:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    deflate = zlib.compressobj(5, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + deflate.flush()


def write_warc(rows: DataFrame, directory: str) -> DataFrame:
    """Write (record_id, url, payload, digest, refers_to) and return the manifest (path, bytes, records).

    Every attempt of a task writes a file of its own name, and the manifest
    names those of the attempts that ended well; the reader opens no others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(directory if "://" in directory else f"file://{directory}")
        store.create_dir(root, recursive=True)
        name, out, written, records = f"part-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for row in range(batch.num_rows):
                record = [batch.column(i)[row].as_py() for i in range(5)]
                if out is None:
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                member = encode_record(*record)
                out.write(member)
                written += len(member)
                records += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [f"{directory.rstrip('/')}/{name}"], "bytes": [written], "records": [records]})

    return cut(arrow_map(rows.select("record_id", "url", "payload", "digest", "refers_to"), run, MANIFEST))


def _inflate(source, at: int, most: int) -> tuple[bytes, int] | None:
    """The first `most` bytes of the gzip member at `at`, and where it ends (-1 if it goes on beyond them); None if it is none."""
    inflater, parts, size, place = zlib.decompressobj(31), [], 0, at
    source.seek(at)
    while True:
        raw = source.read(CHUNK if most > CHUNK else 4096)
        try:
            part = inflater.decompress(raw, max(0, most - size))
        except zlib.error:
            return None
        parts.append(part)
        size += len(part)
        place += len(raw)
        if inflater.eof:
            return b"".join(parts), place - len(inflater.unused_data)
        if size >= most:
            return b"".join(parts), -1
        if not raw:
            return None


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}


def _members(source, start: int, end: int) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(start, end, header fields, block) of the sound members that start in [start, end), the search going on after each.

    Sound: a WARC header, a right CRC and as many bytes as Content-Length says.
    """
    at = start
    while at < end:
        source.seek(at)
        window = source.read(min(CHUNK, end - at) + len(GZIP_MAGIC) - 1)
        found = window.find(GZIP_MAGIC)
        if found < 0:
            at += max(1, len(window) - len(GZIP_MAGIC) + 1)
            continue
        at += found
        if at >= end:
            return
        head = _inflate(source, at, 1024)
        whole = _inflate(source, at, 1 << 62) if head and head[0].startswith(WARC_VERSION) else None
        if whole is None:
            at += 1
            continue
        text, _, block = whole[0].partition(b"\r\n\r\n")
        fields = _fields(text)
        length = fields.get("content-length", str(len(block)))
        if not length.isdecimal() or int(length) > len(block):
            at += 1
            continue
        yield at, whole[1], fields, block[: int(length)]
        at = whole[1]


def last_end(source, start: int, end: int) -> int:
    """Where the last sound member that starts in the range ends; the range's start if there is none."""
    return max((after for _, after, _, _ in _members(source, start, end)), default=start)


def read_range(source, start: int, end: int) -> Iterator[dict]:
    """The records whose members start in [start, end); `start` must not lie inside a member."""
    for at, _, fields, block in _members(source, start, end):
        yield {"start": at} | _record(fields, block)


def _record(fields: dict[str, str], block: bytes) -> dict:
    kind, digest = fields.get("warc-type"), fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    payload, length, fine = None, None, None
    if fields.get("content-type", "").startswith("application/http"):
        http, _, rest = block.partition(b"\r\n\r\n")
        length = _fields(http).get("content-length")
        length = int(length) if length and length.isdigit() else None
        if kind == "response":
            payload, length, fine = rest, len(rest), digest is None or base32_sha1(rest) == digest
            digest = digest or base32_sha1(rest)
    inner = lambda name: (fields.get(name) or "").strip("<>") or None
    return {
        "record_id": inner("warc-record-id"), "record_type": kind, "target_uri": fields.get("warc-target-uri"), "refers_to": inner("warc-refers-to"),
        "payload_digest": digest, "payload_bytes": length, "payload": payload, "digest_ok": fine,
    }


def _opened(path: str):
    store, place = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return store.open_input_file(place)


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """All records of the archives in `files` (path, bytes), one task's work being `split_bytes` of one file.

    One gzip member is one record. Bytes between members and after the last one
    and damaged members (cut short, a wrong CRC, fewer bytes than Content-Length)
    are passed over; members inside another one's bytes are part of it, unless
    that one is damaged. A response with a digest that its payload does not have
    gets digest_ok = false. A file that is named twice is read twice.
    """
    wanted = RECORD if payload else RECORD.replace("payload binary, ", "")
    ranges = files.where("bytes > 0").withColumn("file", F.monotonically_increasing_id()).select(
        "file", "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    n = max(1, int(files.agg(F.coalesce(F.sum(F.ceil(F.col("bytes") / split_bytes)), F.lit(0))).first()[0]))
    width = max(n, 2)  # one number would be taken as a target for all rows together

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = []
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                with _opened(path) as source:
                    last.append(last_end(source, start, min(size, start + split_bytes)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(last, pa.int64())], names=[*batch.schema.names, "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight = [], 0
        for batch in batches:
            for path, size, start, begin in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start", "begin"))):
                with _opened(path) as source:
                    for record in read_range(source, begin, min(size, start + split_bytes)):
                        weight += len(record["payload"] or b"") + 500
                        if not payload:
                            del record["payload"]
                        held.append({"path": path} | record)
                        if weight > 4 << 20 or len(held) >= 2000:
                            yield _batch(held, wanted)
                            held, weight = [], 0
        if held:
            yield _batch(held, wanted)

    told = cut(arrow_map(ranges.repartition(width, "path", "start"), ends, "file long, path string, bytes long, start long, last long"))  # a row a range
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    begun = told.withColumn("begin", F.greatest("start", F.max("last").over(before)))  # ranges of a file, not records
    return arrow_map(begun.repartition(width, "path", "start"), run, wanted)


_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], _ARROW[t]) for n, t in fields], names=[n for n, _ in fields])


def with_revisits(pages: DataFrame, key: str, url: str, body: str) -> DataFrame:
    """(record_id, url, payload, digest, refers_to) of every row; a null body is empty.

    Only digests that occur more than once are joined back, so pages of which
    there is one copy meet no partner; a digest which holds a large part of all
    rows is pre-aggregated, and its rows are split by adaptive execution. Of
    equal ids with equal payloads all but one would refer to themselves: rows
    that repeat wholly are all responses. A null id stands below all others.
    """
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    rows = pages.select(
        F.col(key).alias("k"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(body), F.lit("")).cast("binary").alias("payload")
    ).withColumn("sha", F.sha1("payload"))
    first = rows.groupBy("sha").agg(F.max("k").alias("keep"), F.count("*").alias("n")).where("n > 1").select("sha", "keep")
    return rows.join(first, "sha", "left").select(
        name(F.col("k")).alias("record_id"), "url", "payload", _base32(F.col("sha")).alias("digest"),
        F.when(F.col("keep").isNotNull() & ~F.col("k").eqNullSafe(F.col("keep")), name(F.col("keep"))).alias("refers_to"),
    )


def _base32(sha: F.Column) -> F.Column:
    """Base32 of a hexadecimal SHA-1: eight 20-bit words of five hexadecimal digits give four letters each."""
    alphabet = F.array(*(F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
    parts = []
    for i in range(8):
        word = F.conv(F.substring(sha, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.element_at(alphabet, F.shiftright(word, 15 - 5 * j).bitwiseAND(31) + 1) for j in range(4)]
    return F.concat(*parts)


def archive(pages: DataFrame, key: str, url: str, body: str, directory: str | None = None, payload: bool = True) -> DataFrame:
    """Write every row as a WARC record and read the archives back; see read_warc for the columns."""
    spark: SparkSession = pages.sparkSession
    return read_warc(write_warc(with_revisits(pages, key, url, body), directory or shared_dir(spark)), payload=payload)


def page_ids(records: DataFrame, key: str) -> DataFrame:
    """The digest columns of records that `archive` wrote."""
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as long)")
    return records.select(number("record_id").alias(key), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "digest_ok")
