"""WARC archives: a writer with one gzip member per record, and a reader that salvages damaged files."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcast.llm.common import per_batch, pick, utf8

REVISIT_BYTES = 1000
#: A payload is common if more than one in COMMON rows has it; at most COMMON payloads are.
COMMON = 1000
DATE = "2020-01-01T00:00:00Z"
#: Bytes of an archive that are decompressed at a time.
PIECE = 16 << 10
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/[0-9]+\.[0-9]+\r?\n")
_START = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]+\.[0-9]+\r?\n")


# ---------------------------------------------------------------- records


def record(kind: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    head = [("WARC-Type", kind), *fields, ("Content-Length", str(len(body)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + body + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member that ends with a zero byte: its last byte is the high byte of the length, so only a
    record of 16 MiB or more needs an empty member behind it."""
    out = gzip.compress(data, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", mtime=0)


def sha1_32(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def page_record(page: int | None, url: str | None, html: bytes) -> bytes:
    target = url and "".join(c for c in url if c not in "\r\n")
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html
    fields = _fields(page, target, len(html), hashlib.sha1(html).hexdigest())
    fields += [("WARC-Block-Digest", sha1_32(body)), ("Content-Type", "application/http;msgtype=response")]
    return member(record("response", fields, body))


def revisit_record(page: int | None, url: str | None, size: int, digest: str, refers_to: int) -> bytes:
    target = url and "".join(c for c in url if c not in "\r\n")
    fields = _fields(page, target, size, digest)
    fields += [
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", f"<urn:page:{refers_to}>"),
        ("WARC-Block-Digest", sha1_32(b"")),
    ]
    return member(record("revisit", fields, b""))


def _fields(page, target, size, digest):
    fields = [("WARC-Record-ID", f"<urn:page:{'' if page is None else page}>"), ("WARC-Date", DATE)]
    if target:
        fields.append(("WARC-Target-URI", target))
    return [*fields, ("WARC-Payload-Digest", f"sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"), ("WARC-Payload-Length", str(size))]


# ---------------------------------------------------------------- salvage reader


def salvage(data: bytes) -> Iterator[tuple[str, int, int, dict[str, str] | str, bytes]]:
    """Records and gaps of an archive, compressed by record or plain, in order:
    ("record", start, end, headers, body) or ("gap", start, end, reason, b"").

    A record counts if its version line, headers, length and block digest hold and, when compressed,
    its member's checksum. After a failure the next gzip member or version line from which a valid
    record can be read is searched for; the bytes passed over are one gap with the first failure's reason.
    """
    at, bad, why = 0, None, ""
    while at < len(data):
        try:
            end, found = _record_at(data, at)
        except ValueError as e:
            if bad is None:
                bad, why = at, str(e)
            nxt = _START.search(data, at + 1)
            at = nxt.start() if nxt else len(data)
            continue
        if bad is not None:
            yield "gap", bad, at, why, b""
            bad = None
        if found is not None:
            yield "record", at, end, found[0], found[1]
        at = end
    if bad is not None:
        yield "gap", bad, len(data), why, b""


def _record_at(data: bytes, at: int) -> tuple[int, tuple[dict[str, str], bytes] | None]:
    if data.startswith(_MAGIC, at):
        unzip = zlib.decompressobj(wbits=31)
        parts, end = [], at
        try:
            # Piece by piece: what lies behind a member is copied, so it must not be the rest of the archive.
            while not unzip.eof and end < len(data):
                piece = data[end : end + PIECE]
                parts.append(unzip.decompress(piece))
                end += len(piece)
        except zlib.error as e:
            raise ValueError(f"gzip: {e}") from None
        if not unzip.eof:
            raise ValueError("gzip: member is cut off")
        end -= len(unzip.unused_data)
        plain = b"".join(parts)
        if not plain:
            return end, None
        size, found = _plain_record(plain, 0)
        if size != len(plain):
            raise ValueError("member holds more than a record")
        return end, found
    return _plain_record(data, at)


def _plain_record(data: bytes, at: int) -> tuple[int, tuple[dict[str, str], bytes]]:
    line = _VERSION.match(data, at)
    if not line:
        raise ValueError("no version line")
    head_end = data.find(b"\r\n\r\n", line.end() - 2)
    if head_end < 0:
        raise ValueError("headers do not end")
    headers = {}
    for raw in data[line.end() : head_end].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            raise ValueError("header without colon")
        headers[name.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    if not headers.get("content-length", "").isdigit():
        raise ValueError("no length")
    start = head_end + 4
    end = start + int(headers["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    body = data[start:end]
    if headers.get("warc-block-digest", "").startswith("sha1:") and headers["warc-block-digest"] != sha1_32(body):
        raise ValueError("block digest differs")
    return end + 4, (headers, body)


# ---------------------------------------------------------------- Spark


def write_pages(pages: DataFrame, path: str) -> None:
    """Write one record per row of pages (page_id, url, html) into archives below path.

    Of rows with equal payloads (html in UTF-8, null: empty) of at least REVISIT_BYTES bytes, those with
    the largest page_id are responses, the others revisit it; all smaller payloads, and payloads without
    any id, are responses. Null urls are left out, repeated rows are written repeatedly, an empty table
    gives an empty archive; other columns are not looked at.

    Payloads are compressed into records before the shuffle that decides about revisits. Payloads that
    more than one in COMMON rows share (a bounded list) are decided by broadcast, so no payload's rows
    meet in one task.
    """
    rows = pick(pages, "page_id", "url", "html").select("page_id", "url", utf8("html").alias("html"))
    key = [F.sha1("html").alias("digest"), F.octet_length("html").cast("bigint").alias("size")]
    shown = rows.select("page_id", *key).where(F.col("size") >= REVISIT_BYTES)
    groups = shown.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    groups = groups.where("n > 1 and keeper is not null")
    least = -(-shown.count() // COMMON)
    common = F.broadcast(groups.where(F.col("n") > least).select("digest", "size", F.col("keeper").alias("common")))

    def make(batch: pa.RecordBatch):
        held, bytes_ = [], 0
        columns = [c.to_pylist() for c in batch.columns]
        for page, url, html, digest, size in zip(*columns, strict=True):
            held.append((page, url, digest, size, page_record(page, url, html)))
            bytes_ += len(held[-1][-1])
            if bytes_ > 8 << 20:
                yield _built(held, batch.schema)
                held, bytes_ = [], 0
        if held:
            yield _built(held, batch.schema)

    kinds = "page_id bigint, url string, digest string, size bigint, made binary"
    made = per_batch(rows.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html", *key), kinds, make)
    made = made.join(common, ["digest", "size"], "left")
    own = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    lookup = F.when(F.col("common").isNull(), F.col("digest")).otherwise(F.concat(F.lit("#"), own)).alias("lookup")
    rest = groups.where(F.col("n") <= least).select(F.col("digest").alias("lookup"), "size", F.col("keeper").alias("single"))
    made = made.withColumn("lookup", lookup).join(rest, ["lookup", "size"], "left")
    keeper = F.coalesce("common", "single")
    refers = F.when(~F.col("page_id").eqNullSafe(keeper), keeper)

    chosen = made.select("page_id", "url", "digest", "size", refers.alias("refers"), "made")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        *facts, done = (c.to_pylist() for c in batch.columns)
        out = [m if f[4] is None else revisit_record(f[0], f[1], f[3], f[2], f[4]) for m, f in zip(done, zip(*facts, strict=True), strict=True)]
        # The text writer ends each line with its separator: here the zero byte that ends every member.
        return pa.RecordBatch.from_arrays([pa.array([m[:-1] for m in out], pa.binary())], names=["data"])

    lines = per_batch(chosen, "data binary", finish).select(F.col("data").cast("string").alias("value"))
    lines.write.option("lineSep", "\x00").text(path)


def _built(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "digest", "size", "made"])


READ = "file string, what string, from_byte bigint, to_byte bigint, reason string, record_type string, headers map<string, string>, body binary"


def read_archives(spark: SparkSession, path: str, bodies: bool = True) -> DataFrame:
    """Records (what = 'record': record_type, headers with lower-case names, body) and quarantined gaps
    (what = 'gap': reason) of all archives below path, each with its byte span [from_byte, to_byte).
    bodies=False leaves the bodies out and adds payload size and SHA-1 to the headers instead."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held, size = [], 0
                for row in _rows(name, content.as_py(), bodies):
                    held.append(row)
                    size += len(row[-1] or b"") + 500
                    if size > 8 << 20:
                        yield _found(held)
                        held, size = [], 0
                if held:
                    yield _found(held)

    return files.mapInArrow(run, READ)


def _rows(name: str, data: bytes, bodies: bool):
    for what, a, b, found, body in salvage(data):
        if what == "gap":
            yield name, what, a, b, found, None, None, None
            continue
        headers = dict(found)
        if headers.get("warc-payload-digest", "").startswith("sha1:"):
            headers["payload-sha1-told"] = base64.b32decode(headers["warc-payload-digest"][5:]).hex()
        if not bodies:
            payload = body.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else body
            headers |= {"payload-bytes-read": str(len(payload)), "payload-sha1-read": hashlib.sha1(payload).hexdigest()}
        yield name, what, a, b, None, headers.get("warc-type"), headers, body if bodies else None


def _found(held: list[tuple]) -> pa.RecordBatch:
    text, long = pa.string(), pa.int64()
    kinds = [text, text, long, long, text, text, pa.map_(text, text), pa.binary()]
    columns = list(zip(*held, strict=True))
    columns[6] = [h and list(h.items()) for h in columns[6]]
    names = ["file", "what", "from_byte", "to_byte", "reason", "record_type", "headers", "body"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def page_of(header: str) -> Column:
    """The page id in a record id header."""
    return F.nullif(F.regexp_extract(F.col("headers")[header], r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("bigint")


def pages_of(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest (hex SHA-1), record_type, refers_to of read records.
    Payload facts of a response are those of the bytes read, those of a revisit are its headers'."""
    h = F.col("headers")
    read = F.col("record_type") == "response"
    return records.where("what = 'record'").select(
        page_of("warc-record-id").alias("page_id"),
        F.when(read, h["payload-bytes-read"]).otherwise(h["warc-payload-length"]).cast("bigint").alias("payload_bytes"),
        F.when(read, h["payload-sha1-read"]).otherwise(h["payload-sha1-told"]).alias("payload_digest"),
        "record_type",
        page_of("warc-refers-to").alias("refers_to"),
    )
