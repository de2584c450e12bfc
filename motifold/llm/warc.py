"""Legacy ARC files to WARC/1.0: header lines by version, declared lengths, synthesised identifiers, times and digests.

Tasks join records to archives of bounded size, a row each, and Spark's text writer makes each row a file, so its committer
covers lost executors and any store that Spark writes will do; the bytes are a plain WARC file, compressed as a whole. They
are read back as binary files, record by record from declared lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from motifold.llm.shared import shared_folder, spread_join, tidied

#: Fixed values of the two formats.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
RECORD_END = "\r\n\r\n"

#: Bytes of records beyond which an archive file takes no more; one holds less than this and its last record.
ARCHIVE_BYTES = 8 << 20


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    block: bytes


class WarcRecord(NamedTuple):
    headers: dict[str, str]  #: by lower-case name
    block: bytes

    def payload(self) -> bytes:
        """What follows the HTTP header, or the whole block if there is none."""
        return split_http(self.block)[1]


def arc_records(content: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, without its version block. ValueError if a header line or length doesn't fit the version.

    The version block says which fields a header line has. An URL may hold spaces: the other fields count from the right.
    """
    content = _plain(content)
    at, fields = 0, len(ARC_FIELDS["1"].split())
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        end = content.find(b"\n", at)
        head = content[at : end if end >= 0 else len(content)].decode("utf-8", "replace").rstrip("\r")
        parts = head.rsplit(" ", (5 if head.startswith("filedesc:") else fields) - 1)
        if len(parts) < 5 or not parts[-1].isdecimal():
            raise ValueError(f"no ARC header line at byte {at}: {head[:80]!r}")
        length = int(parts[-1])
        block = content[end + 1 : end + 1 + length]
        if end < 0 or len(block) < length:
            raise ValueError(f"the record at byte {at} declares {length} bytes; {len(block)} are left")
        at = end + 1 + length
        if head.startswith("filedesc:"):
            version = block.split(maxsplit=1)[0].decode("ascii", "replace") if block.strip() else "1"
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version!r}")
            fields = len(ARC_FIELDS[version].split())
        else:
            yield ArcRecord(parts[0], parts[1], parts[2], parts[3], block)


def _plain(content: bytes) -> bytes:
    """Without compression, whether the file or each record is a gzip member."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its blank line, and payload; no header if the block isn't an HTTP message."""
    if block[:5] != b"HTTP/":
        return b"", block
    for gap in (b"\r\n\r\n", b"\n\n"):
        if (at := block.find(gap)) >= 0:
            return block[: at + len(gap)], block[at + len(gap) :]
    return block, b""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>"


def warc_date(date: str) -> str:
    """An ARC date of up to 14 digits; what it lacks is the earliest."""
    digits = (re.sub(r"\D", "", date) + "00010101000000"[len(re.sub(r"\D", "", date)) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:14]}Z"


def warc_record(arc: ArcRecord, key: str, refers_to: str | None = None) -> bytes:
    """The WARC record of an ARC record, without the record end. `key` makes its identifier; a revisit has the HTTP header only."""
    http, payload = split_http(arc.block)
    kind = "revisit" if refers_to is not None else "response" if http else "resource"
    block = http if kind == "revisit" else arc.block
    lines = [
        "WARC/1.0",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(key)}",
        f"WARC-Date: {warc_date(arc.date)}",
        f"WARC-Target-URI: {arc.url}",
        f"WARC-IP-Address: {arc.ip}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Key: {key}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Key: {refers_to}"]
    lines += [f"Content-Type: {'application/http; msgtype=response' if http else arc.mime}", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block


def warc_records(content: bytes) -> Iterator[WarcRecord]:
    """Records of a WARC file by declared lengths. ValueError if it isn't one."""
    content = _plain(content)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        lines = content[at : max(at, end)].decode("utf-8", "replace").split("\r\n")
        if end < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC header at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(headers["content-length"])
        block = content[end + 4 : end + 4 + length]
        at = end + 4 + length + len(RECORD_END)
        if len(block) < length or content[at - 4 : at] != RECORD_END.encode():
            raise ValueError(f"the record {headers.get('warc-record-id')} is cut short")
        yield WarcRecord(headers, block)


def arc_file(url: Column, html: Column, date: str = "20240101000000", version: str = "1") -> Column:
    """An ARC file with one HTTP record, as binary: for tables that hold pages and no archives."""
    address = F.when(F.length(F.trim(url)) > 0, F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")).otherwise("unknown:")
    body = F.coalesce(html, F.lit("")).cast("binary")
    about = f"{version} 0 pages\n{ARC_FIELDS[version]}\n".encode()
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), F.length(body).cast("string"), F.lit("\r\n\r\n"))
    more = {"1": "", "2": " 200 - - 0 pages.arc"}[version]
    line = F.concat(address, F.lit(f" 0.0.0.0 {date} text/html{more} "), (F.length(body) + F.length(head)).cast("string"), F.lit("\n"))
    first = f"filedesc://pages.arc 0.0.0.0 {date} text/plain {len(about)}\n".encode() + about + b"\n"
    return F.concat(F.lit(first), line.cast("binary"), head.cast("binary"), body, F.lit(b"\n"))


def _convert(most: int):
    schema = pa.schema([("archive", pa.binary())])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for key, refers, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                key, refers, content = key.as_py(), refers.as_py(), content.as_py()
                for i, arc in enumerate(arc_records(content or b"")):
                    held.append(warc_record(arc, f"{key}/{i}" if i else f"{key}", refers))
                    size += len(held[-1])
                    if size >= most:
                        yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(held)], pa.binary())], schema=schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([RECORD_END.encode().join(held)], pa.binary())], schema=schema)

    return run


def write_warc(arcs: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Convert ARC files and write WARC archives: arcs has key, refers_to (strings; null: no revisit) and content (null: empty).

    The n-th further record of one ARC file has the key `key/n`. An archive's last record end is the writer's line separator.
    """
    archives = arcs.select("key", "refers_to", "content").mapInArrow(tidied(_convert(archive_bytes)), "archive binary")
    writer = archives.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", RECORD_END)
    writer.option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _read(batches):
    names = ["key", "record_id", "target_uri", "date", "record_type", "refers_to", "payload_bytes", "payload_digest", "intact"]
    for batch in batches:
        for content in batch.column(0):
            rows = []
            for record in warc_records(content.as_py()):
                h = record.headers
                told = h.get("warc-payload-digest", "").removeprefix("sha1:")
                payload = record.payload()
                revisit = h["warc-type"] == "revisit"
                found, size = (told, int(h.get("x-payload-length", 0))) if revisit else (digest(payload), len(payload))
                rows.append((h.get("x-key"), h.get("warc-record-id"), h.get("warc-target-uri"), h.get("warc-date"), h["warc-type"], h.get("x-refers-to-key"), size, found, found == told))
            kinds = [pa.string()] * 6 + [pa.int64(), pa.string(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Per record: key, record_id, target_uri, date, record_type, refers_to (key), payload_bytes, payload_digest, intact.

    Lengths and digests of responses are counted from the payload; a revisit's are those its header tells.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(tidied(_read), "key string, record_id string, target_uri string, date string, record_type string, refers_to string, payload_bytes long, payload_digest string, intact boolean")


def archived_pages(pages: DataFrame, version: str = "1", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html) as WARC archives in the shared folder, through ARC; what is read back, per row.

    page_id, payload_bytes, payload_digest, record_type, refers_to. Of equal payloads the smallest page_id's is the
    response, the others are revisits of it; a null html is an empty payload; a null or blank url is `unknown:`. Rows that
    repeat the smallest page_id are responses too. A null page_id is never the smallest, and null in the result; payloads
    of null page_ids alone are responses. An empty table gives no rows.
    """
    spark = pages.sparkSession
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    marked = source.withColumn("mark", F.sha1(F.col("html").cast("binary")))
    groups = marked.groupBy("mark").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    if not (total := source.count()):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    # A payload that many pages share is one join key, so its pages stay where they are; the others meet in a shuffle.
    told = spread_join(marked, groups.select("mark", F.when(F.col("copies") > 1, F.col("first")).alias("first"), F.col("copies").alias("_n")), ["mark"], total, few=0)
    refers = F.when(F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id")), F.col("first").cast("string"))
    arcs = told.select(F.coalesce(F.col("page_id").cast("string"), F.lit("null")).alias("key"), refers.alias("refers_to"), arc_file(F.col("url"), F.col("html"), version=version).alias("content"))
    path = shared_folder(spark)
    write_warc(arcs, path, archive_bytes)
    back = read_warc(spark, path)
    return back.select(F.expr("try_cast(key as long)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))
