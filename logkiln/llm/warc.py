"""Legacy archives (ARC) to WARC.

An ARC file starts with a version block: a ``filedesc://`` record whose body names the version
and the fields of the header lines that follow. A version 1 line has five fields, a version 2
line ten; the last one is the length of the content, and contents are cut out by that length
alone. The converter makes the WARC fields that ARC lacks: an identifier from file and offset, the
instant from the 14 digits, the type from scheme and content, and digests of block and payload.

Files are written by Spark's text sink, a record a row, so a lost task is written again by the
usual commit protocol on any file system. Files hold at most ``FILE_ROWS`` records.

Defined results: a null payload is empty; a null url is ``urn:unknown``, spaces in one become
``%20``; a null key stays null; rows with the same key are records of their own; an empty table
gives an archive folder without records. A broken archive gives a row with ``error`` set, and
what stands before the break is kept.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logkiln.llm.common import bound_batches

#: Records of a file: at some KB a page, some MB.
FILE_ROWS = 2000
GZIP = {"compression": "gzip", "zlib.compress.level": "FOUR"}
#: Fixed values of the two ARC versions.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
RECORD = "archive string, offset bigint, version int, url string, ip string, archive_date string, content_type string, result_code string, checksum string, location string, content binary, error string"
WARC = "warc_type string, record_id string, warc_date string, target_uri string, refers_to string, headers map<string,string>, http map<string,string>, block binary, error string"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


# --- writing ARC ----------------------------------------------------------------------------


def arc_line(version: int, url: str, ip: str, date14: str, mime: str, length: int, digest: str = "-", offset: int = 0, name: str = "-") -> bytes:
    if version == 1:
        fields = (url, ip, date14, mime, length)
    else:
        fields = (url, ip, date14, mime, 200, digest, "-", offset, name, length)
    return " ".join(map(str, fields)).encode()


def version_block(version: int, name: str, date14: str) -> bytes:
    body = f"{version} 0 logkiln\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = arc_line(version, f"filedesc://{name}", "0.0.0.0", date14, "text/plain", len(body))
    return head + b"\n" + body


def write_arc(contents: DataFrame, path: str, version: int) -> None:
    """Rows (url, content, archive_date of 14 digits) as ARC files of one version.

    The sink begins a file every ``FILE_ROWS`` rows, and so often a version block is written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, schema, written = TaskContext.get().partitionId(), pa.schema([("value", pa.binary())]), 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                name = f"part-{part}-{written // FILE_ROWS}.arc"
                if written % FILE_ROWS == 0:
                    out.append((version_block(version, name, "20240101000000"),))
                    written += 1
                content = row["content"] or b""
                url = "%20".join((row["url"] or "").split()) or "urn:unknown"
                line = arc_line(version, url, "0.0.0.0", row["archive_date"] or "19700101000000", "text/html", len(content), hashlib.md5(content).hexdigest(), 0, name)
                out.append((line + b"\n" + content,))
                written += 1
            yield _table(out, schema)

    lines = contents.select("url", "content", "archive_date").mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\n").option("maxRecordsPerFile", FILE_ROWS).options(**GZIP).text(path)


# --- reading ARC ----------------------------------------------------------------------------


def _gunzip(data: bytes) -> tuple[bytes, str | None]:
    """All members of a gzip file, or plain bytes as they are."""
    if data[:2] != b"\x1f\x8b":
        return data, None
    try:
        return gzip.decompress(data), None
    except (OSError, EOFError, zlib.error):
        whole, kept = zlib.decompressobj(31), b""
        try:
            kept = whole.decompress(data)
        except zlib.error:
            pass
        return kept, "bad_gzip"


def _number(text: str, signed: bool = False) -> int | None:
    """A whole number in ASCII digits that fits a long, else null."""
    found = int(text) if re.fullmatch("-?[0-9]{1,19}" if signed else "[0-9]{1,19}", text) else None
    return found if found is not None and -(1 << 63) <= found < 1 << 63 else None


def parse_arc(data: bytes, archive: str = "") -> Iterator[tuple]:
    """Records of one archive as tuples of ``RECORD``; a break ends it with a row that has ``error``."""
    data, error = _gunzip(data)
    at, fields, version = 0, ARC_FIELDS[1], 1
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        parts = line.split(" ")
        # A content type may hold blanks: the fields before and after it are counted from both ends.
        after = len(fields) - 4
        if end < 0 or len(parts) < len(fields) or _number(parts[-1]) is None:
            yield (archive, at, version, None, None, None, None, None, None, None, None, "bad_header")
            return
        url, ip, date, mime = parts[0], parts[1], parts[2], " ".join(parts[3 : len(parts) - after])
        rest = dict(zip(fields[4:], parts[len(parts) - after :]))
        length = _number(parts[-1])
        content = data[end + 1 : end + 1 + length]
        if len(content) < length:
            yield (archive, at, version, url, ip, date, mime, None, None, None, content, error or "truncated")
            return
        if url.startswith("filedesc://"):
            head = content.split(b"\n", 2)
            number = head[0].split(b" ", 1)[0]
            version = int(number) if number in (b"1", b"2") else version
            named = tuple(head[1].decode("utf-8", "replace").split()) if len(head) > 1 else ()
            fields = named if len(named) >= 5 and named[:4] == ARC_FIELDS[1][:4] else ARC_FIELDS[version]
        yield (archive, at, version, url, ip, date, mime, rest.get("Result-code"), rest.get("Checksum"), rest.get("Location"), content, None)
        at = end + 1 + length
    if error:
        yield (archive, at, version, None, None, None, None, None, None, None, None, error)


def _parsed(spark: SparkSession, path: str, parse, schema: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                rows, size = [], 0
                for row in parse(data.as_py(), name.as_py()):
                    rows.append(row)
                    size += 200 + sum(len(x) for x in row if isinstance(x, bytes))
                    if size > 4 << 20:
                        yield _table(rows, arrow)
                        rows, size = [], 0
                yield _table(rows, arrow)

    bound_batches(spark)  # files of one scan task hold spark.sql.files.maxPartitionBytes together
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInArrow(run, schema)


_ARC_ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("version", pa.int32())] + [(c, pa.string()) for c in ("url", "ip", "archive_date", "content_type", "result_code", "checksum", "location")] + [("content", pa.binary()), ("error", pa.string())])


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, columns ``RECORD``."""
    return _parsed(spark, path, parse_arc, RECORD, _ARC_ARROW)


# --- converting -----------------------------------------------------------------------------


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """Head with its closing blank line, and payload; a content without a head is all payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content, b"") if end < 0 else (content[: end + 4], content[end + 4 :])


def http_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if ":" in x)}


def warc_date(date14: str | None) -> str:
    """The 14 digits of an ARC date as an instant; digits that are missing count as the earliest."""
    digits = (date14 or "").strip()
    digits = digits if re.fullmatch("[0-9]+", digits) else ""
    d = (digits + "19700101000000"[len(digits) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def warc_type(url: str, content: bytes) -> str:
    if url.startswith("filedesc://"):
        return "warcinfo"
    return "response" if content.startswith(b"HTTP/") else "resource"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


_FACTS = "archive string, offset bigint, url string, warc_type string, record_id string, warc_date string, mime string, key bigint, payload_digest string, payload_bytes bigint, content binary"


def convert_arc(records: DataFrame, least_bytes: int = 100, key_header: str = "x-record-key") -> DataFrame:
    """ARC records as WARC records: a row each with its bytes (``value``) and what is in them.

    Of responses with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    key (the number in the HTTP field ``key_header``, null last, then place) stays a response;
    others become revisits, without payload, that refer to it. Records of one key are equal in
    rank and stay responses. The first of each payload is found by an aggregate, so a payload
    that many pages share is combined before the shuffle; the join back is one that Spark may split.
    """
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64())] + [(c, pa.string()) for c in ("url", "warc_type", "record_id", "warc_date", "mime")] + [("key", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("content", pa.binary())])

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                content = r["content"] or b""
                head, payload = split_http(content)
                key = http_fields(head).get(key_header, "")
                out.append((r["archive"], r["offset"], r["url"], warc_type(r["url"], content), record_id(r["archive"], r["offset"]), warc_date(r["archive_date"]), r["content_type"], _number(key, signed=True), hashlib.sha256(payload).hexdigest(), len(payload), content))
            yield _table(out, schema)

    made = records.where("error IS NULL").mapInArrow(facts, _FACTS)
    order = F.struct(F.col("key").isNull().alias("none"), "key", "archive", "offset", "record_id")
    large = made.where((F.col("warc_type") == "response") & (F.col("payload_bytes") >= least_bytes))
    first = large.groupBy("payload_digest").agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    joined = made.join(first.withColumnRenamed("payload_digest", "d"), (F.col("payload_digest") == F.col("d")) & (F.col("warc_type") == "response") & (F.col("payload_bytes") >= least_bytes), "left")
    same = F.col("first.key").eqNullSafe(F.col("key")) & (F.col("key").isNotNull() | (F.col("first.record_id") == F.col("record_id")))
    revisit = F.col("first").isNotNull() & ~same
    kept = joined.select(
        *[c for c in made.columns if c != "warc_type"], F.when(revisit, "revisit").otherwise(F.col("warc_type")).alias("warc_type"),
        F.when(revisit, F.col("first.record_id")).alias("refers_id"), F.when(revisit, F.col("first.key")).alias("refers_key"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _table([(warc_record(r, key_header),) for r in batch.to_pylist()], pa.schema([("value", pa.binary())]))

    return kept.mapInArrow(build, "value binary")


def warc_record(r: dict, key_header: str = "x-record-key") -> bytes:
    """One record without the two line ends that close it."""
    head, payload = split_http(r["content"])
    block = head if r["warc_type"] == "revisit" else r["content"]
    fields = [
        ("WARC-Type", r["warc_type"]), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["warc_date"]),
        ("WARC-Target-URI", r["url"]),
        ("Content-Type", {"warcinfo": "application/warc-fields", "resource": r["mime"]}.get(r["warc_type"], "application/http; msgtype=response")),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
    ]
    if r["warc_type"] in ("response", "revisit"):
        fields += [("WARC-Payload-Digest", f"sha256:{r['payload_digest']}"), ("X-Payload-Length", r["payload_bytes"])]
    if r["key"] is not None:
        fields.append(("X-Record-Key", r["key"]))
    if r["warc_type"] == "revisit":
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", r["refers_id"]), ("X-Refers-To-Key", r["refers_key"])]
    fields.append(("Content-Length", len(block)))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n" + block


def write_warc(records: DataFrame, path: str) -> None:
    """Rows ``value`` as WARC files; the sink's line end is the blank lines that close a record."""
    lines = records.select(F.col("value").cast("string").alias("value"))
    lines.write.mode("overwrite").option("lineSep", "\r\n\r\n").options(**GZIP).option("maxRecordsPerFile", FILE_ROWS).text(path)


def parse_warc(data: bytes, archive: str = "") -> Iterator[tuple]:
    """Records of one file as tuples of ``WARC``, cut out by their declared lengths."""
    data, error = _gunzip(data)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        fields = http_fields(data[at:end]) if end >= 0 and data[at : at + 5] == b"WARC/" else {}
        length = _number(fields.get("content-length", ""))
        if length is None:
            yield (None, None, None, None, None, None, None, None, "bad_header")
            return
        block = data[end + 4 : end + 4 + length]
        problem = None if len(block) == length else "truncated"
        kind = fields.get("warc-type")
        http = http_fields(split_http(block)[0]) if kind in ("response", "revisit") else {}
        yield (kind, fields.get("warc-record-id"), fields.get("warc-date"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), list(fields.items()), list(http.items()), block, problem)
        if problem:
            return
        at = end + 4 + length
    if error:
        yield (None, None, None, None, None, None, None, None, error)


_WARC_ARROW = pa.schema([(c, pa.string()) for c in ("warc_type", "record_id", "warc_date", "target_uri", "refers_to")] + [("headers", pa.map_(pa.string(), pa.string())), ("http", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("error", pa.string())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, parse_warc, WARC, _WARC_ARROW)


# --- pages ----------------------------------------------------------------------------------


def page_contents(pages: DataFrame) -> DataFrame:
    """Pages as HTTP responses that carry their page_id in a field of their own."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    key = F.coalesce(F.concat(F.lit("X-Record-Key: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), key, F.lit("Content-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(
        "page_id", "url", F.concat(head.cast("binary"), payload).alias("content"), F.lit("20240101000000").alias("archive_date")
    )


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Pages into ARC files of both versions, those into WARC files, and these read back."""
    bound_batches(spark)
    contents = page_contents(pages)
    odd = F.coalesce(F.pmod("page_id", F.lit(2)), F.lit(0)) == 1
    write_arc(contents.where(~odd), f"{folder}/arc/v1", 1)
    write_arc(contents.where(odd), f"{folder}/arc/v2", 2)
    write_warc(convert_arc(read_arc(spark, f"{folder}/arc")), f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")
