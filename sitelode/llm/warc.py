"""WARC archives: a writer that leaves out repeated payloads, and a reader that salvages damaged files.

Writer: a record per page, an HTTP response whose body is the html in UTF-8. Of
pages with equal payloads of at least ``revisit_from`` bytes the one with the
smallest page_id is the response; the others are revisits that refer to it and
keep its HTTP header, so its length and digest are known from them too. Records
are text made by column expressions, each compressed as a gzip member of its
own, so that reading can go on behind a damaged one. A file's members are put
together in the executor and written by Spark's own writer, so any shared store
works and lost executors do no harm.

Reader: records are checked (version line, header, length, end, block and payload digests). Where a
check fails, the next place that begins a valid record, be it a version line or
a gzip member, is looked for; what lies between is logged as a gap with its
offset, length and reason. Plain files and those of gzip members, of one record or several each, can be read; of a
damaged member the records before the damage are recovered.

A null html is an empty payload. A page without an id is always a response.
Rows that repeat the smallest id of a payload are responses each. A null url is
written as an empty one; other columns are ignored, whatever their names. Long
payloads are one record each, however long; an empty table gives no archives and
no rows. Numbers that fit no field (lengths, ids) make a record invalid or null,
never an error. Copies of one payload meet in a join by its digest; payloads that
very many pages share are joined by broadcast.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelode.llm.common import materialize, new_folder

_ID = "urn:sitelode:page:"
_END = b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_CANDIDATE = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hex digits at a time are four base32 ones."""
    digits = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.lpad(F.conv(F.substr(hex_digest, i * 5 + 1, F.lit(5)), 16, 32), 4, "0"),
    )
    return F.translate(F.upper(F.array_join(digits, "")), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _with_first(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """rows plus first_id, that of the first page with the payload. Only payloads that come again are joined; those of more than a
    thousandth of their pages, a thousand payloads at most, by broadcast, so that no task gets all copies of one."""
    again = materialize(copies.where("n > 1"), "payloads")
    total = again.agg(F.sum("n")).first()[0]
    if not total:
        return rows.withColumn("first_id", F.lit(None).cast(copies.schema["first_id"].dataType))
    hot = F.col("n") * 1000 > total
    frequent, other = again.where(hot).drop("n"), again.where(~hot).drop("n")
    rest = rows.join(F.broadcast(frequent.select("sha1")), "sha1", "left_anti").join(other, "sha1", "left")
    return rows.join(F.broadcast(frequent), "sha1").unionByName(rest)


def records(pages: DataFrame, revisit_from: int = 0, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """record: the text of each page's WARC record, without the two empty lines that end it."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    rows = _with_first(rows, rows.where(F.col("bytes") >= revisit_from).groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")))
    revisit = F.coalesce(F.col("page_id") > F.col("first_id"), F.lit(False))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"), line("Content-Length", F.col("bytes").cast("string")), F.lit("\r\n"))
    rows = rows.withColumn("revisit", revisit).withColumn("block", F.when(F.col("revisit"), http).otherwise(F.concat(http, "html")))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " ")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), base32(F.sha1(F.col("block").cast("binary"))))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", uri(F.col("first_id"))))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"),
        line("Content-Length", F.octet_length("block").cast("string")),
        F.lit("\r\n"),
    )
    return rows.select(F.concat(header, "block").alias("record"))


def _members(batches: Iterator[pa.RecordBatch], records_per_file: int, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """A row per file: its gzip members, one of each record, and no more than so many records or bytes but for a single one.
    The last byte, which the text writer adds as its separator, is left out: it is zero for members of less than 16 MB, and
    an empty member follows where it isn't."""
    parts: list[bytes] = []
    size = 0

    def file() -> pa.RecordBatch:
        last = [] if parts[-1].endswith(b"\0") else [gzip.compress(b"", mtime=0)]
        return pa.RecordBatch.from_arrays([pa.array([b"".join(parts + last)[:-1]], pa.binary())], ["value"])

    for b in batches:
        for record in b.column(0).cast(pa.binary()):
            member = gzip.compress(record.as_py() + _END, 6, mtime=0)
            if parts and (len(parts) == records_per_file or size + len(member) > most_bytes):
                yield file()
                parts, size = [], 0
            parts.append(member)
            size += len(member)
    if parts:
        yield file()


def write(pages: DataFrame, path: str | None = None, records_per_file: int = 2000, compression: str = "gzip", most_bytes: int = 1 << 25, **options) -> str:
    """Writes the archives and returns their folder. With gzip each record is a member of its own; other compressions, or none,
    are those of Spark's text writer."""
    path = path or new_folder(pages.sparkSession, "warc")
    rows = records(pages, **options)
    if compression != "gzip":
        rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path, compression=compression)
        return path
    files = rows.mapInArrow(lambda it: _members(it, records_per_file, most_bytes), "value binary")
    # the text writer takes strings as they are, whatever their bytes; a file is one row, and its separator the last byte
    files.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path, compression="none")
    return path


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    block: bytes


@dataclass
class Gap:
    offset: int
    length: int
    reason: str


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _payload(block: bytes) -> bytes:
    return block.partition(_END)[2]


def parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int] | str:
    """Header, block and end of the plain record at an offset, or why there is none."""
    m = _VERSION.match(data, at)
    if not m:
        return "no version line"
    end = data.find(_END, m.end() - 2)
    if end < 0:
        return "header without an end"
    headers = {}
    for raw in data[m.end() : end].split(b"\r\n"):
        name, colon, value = raw.partition(b":")
        if not colon:
            return "bad header line"
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", size):
        return "bad length"
    start = end + 4
    stop = start + int(size)
    if data[stop : stop + 4] != _END:
        return "length does not meet the end"
    block = data[start:stop]
    if (named := headers.get("warc-block-digest", "")).startswith("sha1:") and named[5:] != _digest(block):
        return "block digest differs"
    named = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and named.startswith("sha1:") and named[5:] != _digest(_payload(block)):
        return "payload digest differs"
    return headers, block, stop + 4


def _inflate(data: bytes, at: int) -> tuple[bytes, int | None, str]:
    """What the gzip member at an offset holds, its end, or None and why it has none."""
    unzip, out = zlib.decompressobj(31), []
    for lo in range(at, len(data), 1 << 16):
        part = data[lo : lo + (1 << 16)]
        before = unzip.copy()
        try:
            out.append(unzip.decompress(part))
        except zlib.error as e:  # what the call has inflated is lost: again, byte by byte up to the damage
            try:
                for i in range(len(part)):
                    out.append(before.decompress(part[i : i + 1]))
            except zlib.error:
                pass
            return b"".join(out), None, f"bad gzip member: {e}"
        if unzip.eof:
            return b"".join(out), lo + len(part) - len(unzip.unused_data), ""
    return b"".join(out), None, "gzip member without an end"


def _read_at(data: bytes, at: int) -> tuple[list[Record | Gap], int | None, str]:
    """What begins at an offset and where it ends; without an end, what was recovered nevertheless and the reason.
    Records of a gzip member have the member's offset and length."""
    if data[at : at + 2] != b"\x1f\x8b":
        got = parse(data, at)
        return ([], None, got) if isinstance(got, str) else ([Record(at, got[2] - at, got[0], got[1])], got[2], "")
    plain, end, reason = _inflate(data, at)
    if end is not None and not plain:
        return [], end, ""
    inner = list(salvage(plain))
    if not any(isinstance(r, Record) for r in inner):
        return [], None, reason or inner[0].reason if inner else reason or "empty gzip member"
    if end is None:
        return [Record(at, 0, r.headers, r.block) for r in inner if isinstance(r, Record)], None, reason
    size = end - at
    return [Record(at, size, r.headers, r.block) if isinstance(r, Record) else Gap(at, size, f"in a gzip member: {r.reason}") for r in inner], end, ""


def salvage(data: bytes) -> Iterator[Record | Gap]:
    """The valid records of an archive in order, and the byte gaps between them."""
    at = 0
    while at < len(data):
        found, end, reason = _read_at(data, at)
        yield from found
        if end is None:
            end = next((m.start() for m in _CANDIDATE.finditer(data, at + 1) if _read_at(data, m.start())[0]), len(data))
            yield Gap(at, end - at, reason)
        at = end


def _page_id(uri: str | None) -> int | None:
    tail = (uri or "").strip("<>").removeprefix(_ID)
    return int(tail) if re.fullmatch(r"-?[0-9]{1,18}|-?[1-8][0-9]{18}", tail) else None


_SCHEMA = (
    "path string, offset long, length long, gap string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
)


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _SCHEMA.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64() if f.endswith("long") else pa.string() for f in _SCHEMA.split(", ")] + [pa.binary()] * with_payload
    for b in batches:
        for path, content in zip(b.column(0), b.column(1), strict=True):
            out = []
            for r in salvage(content.as_py()):
                row: tuple = (path.as_py(), r.offset, r.length)
                if isinstance(r, Gap):
                    out.append(row + (r.reason,) + (None,) * (len(names) - 4))
                    continue
                h, kind = r.headers, r.headers.get("warc-type")
                size = re.search(rb"(?i)\r\ncontent-length:[ \t]*([0-9]{1,18})(?![0-9])", r.block.partition(_END)[0])
                payload = _payload(r.block)
                full = len(payload) if kind == "response" else int(size[1]) if size else None
                digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                row += (None, _page_id(h.get("warc-record-id")), h.get("warc-target-uri"), kind, digest, full, _page_id(h.get("warc-refers-to")))
                out.append(row + (payload,) * with_payload)
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """A row per record or gap (gap: the reason, null for records) of all archives in a folder."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(lambda it: _read(it, with_payload), _SCHEMA + ", payload binary" * with_payload)


#: What the query's digest columns are, in DuckDB's SQL: the archives themselves are tested by round trips.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM d GROUP BY h),
v AS (SELECT page_id, n, first_id, list_transform(range(8), lambda i: ('0x' || substr(h, (i * 5 + 1)::INT, 5))::INT) AS five FROM d JOIN f USING (h))
SELECT page_id, n::BIGINT AS payload_bytes,
       array_to_string(list_transform(five, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> b) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM v
"""
