"""Web archives: a writer with payload deduplication, and a reader that salvages damaged archives.

Writer: one record per page, an HTTP response with the page as payload, or a revisit record (headers only) where a page with
a smaller id has the same payload; each record is a gzip member of its own (or plain bytes). An archive is a row
(archive, content) of at most about ``archive_bytes``, so that Spark stores archives in any file system; ``export`` puts them
into files on a mounted path, and ``spark.read.format("binaryFile")`` reads such files for ``read_archives``.

Equal payloads are grouped by digest on (digest, length, smallest id) alone, pre-aggregated before the shuffle; the smallest
id is joined back under a salt, so that a payload in a third of all pages is spread over ``SALTS`` groups.

Reader: every record is checked (member checksum, version line, headers, length, block and payload digests). After a failed
check the reader looks for the next gzip member that begins with a version line, or the next version line of plain
archives, logs the bytes between as a gap with the reason, and goes on with the records behind it.

Defined results: null html is an empty payload; among equal payloads every row with the smallest id is a response (rows may
repeat), the others are revisits; a null id counts as larger than all; damaged records are gaps and never rows of records.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, stored, table

ARCHIVE_BYTES = 4 << 20
SALTS = 16
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MAGIC = b"\x1f\x8b\x08"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _safe(value: str) -> str:
    """A header value on one line."""
    return re.sub(r"[\x00-\x1F\x7F]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, revisit: bool = False, payload_digest: str | None = None) -> bytes:
    """One uncompressed record."""
    sha = payload_digest or digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _safe(url or "")),
        ("WARC-Payload-Digest", f"sha1:{sha}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        head[1:1] = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Damaged(Exception):
    pass


def _parse(raw: bytes, at: int) -> tuple[dict, int]:
    """(record, end) of the uncompressed record at ``at``; raises Damaged with the failed check."""
    m = _VERSION.match(raw, at)
    if not m:
        raise Damaged("version line")
    head, stop = {}, m.end()
    while not raw.startswith(b"\r\n", stop):  # line by line, of any length, to the first that is none of a header's
        end = raw.find(b"\r\n", stop)
        k, sep, v = raw[stop:end].partition(b":")
        if end < 0 or not sep:
            raise Damaged("headers")
        head[k.strip().lower().decode("latin-1")] = v.strip().decode("utf-8", "replace")
        stop = end + 2
    size = head.get("content-length", "")
    if not size.isdigit():
        raise Damaged("length")
    begin, end = stop + 2, stop + 2 + int(size)
    if raw[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length")
    block = raw[begin:end]
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise Damaged("block digest")
    http, sep, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?i)^content-length:\s*(\d+)\s*$", http.replace(b"\r\n", b"\n"), re.M)
    kind, sha = head.get("warc-type", ""), head.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and sep and sha and digest(payload) != sha:
        raise Damaged("payload digest")
    ident = lambda k: re.fullmatch(r"<urn:page:(-?\d+)>", head.get(k, ""))
    page, other = ident("warc-record-id"), ident("warc-refers-to")
    return {
        "record_type": kind, "page_id": int(page[1]) if page else None, "refers_to": int(other[1]) if other else None, "url": head.get("warc-target-uri"), "payload_digest": sha,
        "payload_bytes": len(payload) if kind == "response" else int(length[1]) if length else None, "payload": payload if kind == "response" else None,
    }, end + 4


def _member(content: bytes, at: int) -> tuple[bytes, int]:
    """(uncompressed bytes, end) of the gzip member at ``at``."""
    un, parts, end = zlib.decompressobj(31), [], at
    try:
        while not un.eof and end < len(content):
            piece = content[end : end + 65536]
            parts.append(un.decompress(piece))
            end += len(piece)
    except zlib.error as e:
        raise Damaged("member checksum" if "check" in str(e) else "member") from None
    if not un.eof:
        raise Damaged("member cut short")
    return b"".join(parts), end - len(un.unused_data)


def _opens(content: bytes, at: int) -> bool:
    """Whether a member at ``at`` begins with a version line."""
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(content[at : at + 4096], 64)))
    except zlib.error:
        return False


def _next(content: bytes, at: int) -> int:
    """The next place at or behind ``at`` where a record may begin."""
    plain = _VERSION.search(content, at)
    best = plain.start() if plain else len(content)
    packed = content.find(_MAGIC, at, best)
    while 0 <= packed < best:
        if _opens(content, packed):
            return packed
        packed = content.find(_MAGIC, packed + 1, best)
    return best


def salvage(content: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, fields) and ("gap", start, end, reason) of an archive, in order; together they cover it."""
    at, gap, reason = 0, None, ""
    while at < len(content):
        try:
            if content.startswith(_MAGIC, at):
                raw, end = _member(content, at)
                found, used = _parse(raw, 0)
                if used != len(raw):
                    raise Damaged("member length")
            else:
                found, end = _parse(content, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            at = _next(content, at + 1)
            continue
        if gap is not None:
            yield "gap", gap, at, reason
            gap = None
        yield "record", at, end, found
        at = end
    if gap is not None:
        yield "gap", gap, len(content), reason


def with_revisits(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, sha: hex, first: the smallest id with that payload)."""
    p = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    p = p.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    many = p.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    many = many.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return p.join(many, ["sha", "salt"], "left").drop("salt")


def write_archives(pages: DataFrame, *, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES, **cols) -> DataFrame:
    """(archive, content): archives of all pages."""

    def run(batches):
        part, done = TaskContext.get().partitionId(), 0

        def pack(parts):
            nonlocal done
            content, done = b"".join(parts), done + 1
            name = f"{part:06d}-{done:05d}-{hashlib.sha1(content).hexdigest()[:12]}.warc{'.gz' * compress}"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

        parts, size = [], 0
        for batch in batches:
            for page, url, html, sha, first in zip(*batch.columns, strict=True):
                payload, page_id, other = html.as_buffer().to_pybytes() if html.is_valid else b"", page.as_py(), first.as_py()
                raw = record(page_id, url.as_py(), payload, other, other is not None and page_id != other, base64.b32encode(bytes.fromhex(sha.as_py())).decode())
                parts.append(member(raw) if compress else raw)
                size += len(parts[-1])
                if size >= archive_bytes:
                    yield pack(parts)
                    parts, size = [], 0
        if parts:
            yield pack(parts)

    return with_revisits(pages, **cols).select("page_id", "url", "html", "sha", "first").mapInArrow(lean(run), "archive string, content binary")


_READ = "archive string, kind string, start bigint, end bigint, reason string, page_id bigint, record_type string, refers_to bigint, url string, payload_bytes bigint, payload_digest string"


def read_archives(archives: DataFrame, *, name_col: str = "archive", content_col: str = "content", payload: bool = False) -> DataFrame:
    """Records and gaps (``kind``) of archives with their byte ranges; with ``payload`` also the payloads of responses."""
    fields = [x.split() for x in _READ.split(", ")]
    kinds = {"string": pa.string(), "bigint": pa.int64()}

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, size = [], 0
                for kind, start, end, found in salvage(content.as_buffer().to_pybytes() if content.is_valid else b""):
                    row = {"archive": name.as_py(), "kind": kind, "start": start, "end": end} | ({"reason": found} if kind == "gap" else found)
                    rows.append(row)
                    size += len(row.get("payload") or b"") if payload else 64
                    if size >= 8 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    def batch_of(rows):
        cols = [pa.array([r.get(f) for r in rows], kinds[t]) for f, t in fields]
        return pa.RecordBatch.from_arrays(cols + ([pa.array([r.get("payload") for r in rows], pa.binary())] if payload else []), names=[f for f, _ in fields] + ["payload"] * payload)

    return archives.select(name_col, content_col).mapInArrow(lean(run), _READ + ", payload binary" * payload)


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files of a folder that all executors have mounted; (archive, path, bytes)."""

    def run(batches):
        for batch in batches:
            names, sizes = batch.column(0).to_pylist(), []
            os.makedirs(folder, exist_ok=True)
            for name, content in zip(names, batch.column(1).to_pylist(), strict=True):
                part = f"{folder}/.{name}.{os.getpid()}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, f"{folder}/{name}")
                sizes.append(len(content))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f"{folder}/{n}" for n in names]), pa.array(sizes, pa.int64())], names=["archive", "path", "bytes"])

    return archives.select("archive", "content").mapInArrow(lean(run), "archive string, path string, bytes bigint")


def op4_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = stored(write_archives(table(spark, sf_dir, "pages")), "archives")
    return read_archives(archives).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages
), s AS (SELECT page_id, octet_length(b) AS n, unhex(sha1(b)) AS h FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM s
), bits AS (SELECT *, replace(CAST(CAST(h AS BIT) AS VARCHAR), ' ', '') AS z FROM f)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(CAST(('000' || substr(z, 5 * i + 1, 5)) AS BIT) AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NOT DISTINCT FROM first THEN NULL ELSE first END AS refers_to
FROM bits
"""
