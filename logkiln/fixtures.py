"""Datagrams made from the test tables, for queries, tests and benchmarks.

Every fixture is a projection of a whole table: known columns are encoded into payloads, so what
the decoders give back can be compared with the columns themselves.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logkiln import catalog as C
from logkiln.operators.normalize import normalize_syslog, valid_logs
from logkiln.operators.syslog import parse_syslog_table

_DATAGRAM = C.DATAGRAM.fieldNames()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with ``ts`` as a UTC instant in any session time zone."""
    # `ts` has no zone: count its microseconds from the epoch on its own clock.
    us = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").withColumn("wall", F.col("ts")).withColumn("ts", F.timestamp_micros(us))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with an instant each, 37 seconds apart."""
    us = F.col("doc_id") * 37_000_000 + F.lit(1_704_067_200_000_000)
    wall = F.expr("timestampadd(SECOND, doc_id * 37, timestamp_ntz'2024-01-01 00:00:00')")
    return table(spark, sf_dir, "documents").withColumns({"ts": F.timestamp_micros(us), "wall": wall})


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _bytes(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def _datagram(proto: str, ip: Column, payload: Column, delay_s: int = 2) -> list[Column]:
    recv = F.timestamp_micros(F.unix_micros("ts") + delay_s * 1_000_000)
    return [
        F.lit(proto).alias("proto"), ip.alias("src_ip"), F.lit(514).alias("src_port"), recv.alias("recv_ts"),
        payload.alias("payload"),
    ]


def _stamp() -> Column:
    month = F.substring(F.lit("JanFebMarAprMayJunJulAugSepOctNovDec"), 1, 36)
    name = F.substr(month, F.month("wall") * 3 - 2, F.lit(3))
    return _text(
        name, " ", F.lpad(F.day("wall").cast("string"), 2, " "), " ", F.substring(F.col("wall").cast("string"), 12, 8)
    )


def _source() -> Column:
    return _text("10.0.0.", F.col("user_id") % 5)


def cents() -> Column:
    return F.round(F.col("value") * 100).cast("bigint")


def syslog_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    host = F.when(e % 7 == 0, "").otherwise(_text("h", F.col("user_id") % 5, " "))
    line = _text(
        "<", (e % 24) * 8 + e % 8, ">", _stamp(), " ", host, F.col("event_type"), "[", e, "]: value=", cents()
    )
    return events(spark, sf_dir).select("event_id", *_datagram("syslog", _source(), _bytes(line)))


def syslog_pri(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, sf_dir).select(
        "event_id", *_datagram("syslog", _source(), _bytes(_text("<", e % 300, "> n=", e)))
    )


def syslog_quirks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve odd line forms in turn, each carrying its event number."""
    e = F.col("event_id")
    iso = F.regexp_replace(F.substring(F.col("wall").cast("string"), 1, 19), " ", "T")
    us = F.lpad((F.unix_micros("ts") % 1_000_000).cast("string"), 6, "0")
    lines = [
        _text("<7>register callback", e),
        _text("hello world ", e),
        _text("<34>1 ", iso, ".", us, "Z mymachine.example.com su - ID", e, " - failed"),
        _text("<34>1 - host app - - - ", e),
        _text("<13>Aug 2 09:00:00 host app: ", e),
        _text("<13>Feb 30 09:00:00 host app: ", e),
        _text("<13>Aug  2 09:00:00 my-host sshd[", e, "]: hi"),
        _text("<255>Aug 12 24:00:00 x: ", e),
        _text("<300>Aug  2 09:00:00 a b: ", e),
        _text("<13>Aug  2 09:00:00 h1 a[99999999999999999999]: ", e),
        F.lit(""),
        _text("<7> [0]DAA FXO: ", e),
    ]
    return events(spark, sf_dir).select(
        "event_id", *_datagram("syslog", _source(), _bytes(_pick(e % len(lines), lines)))
    )


def _pick(number: Column, choices: list[Column]) -> Column:
    out = F.when(number == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(number == i, c)
    return out


def syslog_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    line = _text("<14>", _stamp(), " ", F.col("lang"), " doc[", d, "]: ", F.col("text"))
    return documents(spark, sf_dir).select("doc_id", *_datagram("syslog", _text("10.0.1.", d % 7), _bytes(line)))


# Epoch seconds with six decimals.
_SECONDS = "(unix_micros(ts) div 1000000) || '.' || lpad(CAST(unix_micros(ts) % 1000000 AS string), 6, '0')"


def _quoted(sql: str) -> str:
    return f"""'"' || {sql} || '"'"""


def _gelf_json(**changes: str | None) -> Column:
    """A GELF message of an event; keyword arguments replace, add or (None) remove members.

    Values are SQL for the JSON text of a member.
    """
    members: dict[str, str | None] = {
        "version": _quoted("'1.1'"),
        "host": _quoted("'h' || (user_id % 5)"),
        "short_message": _quoted("event_type"),
        "timestamp": _SECONDS,
        "level": "(event_id % 8)",
        "_PID": f"if(event_id % 2 = 0, CAST(event_id AS string), {_quoted('event_id')})",
        "_CAP_EFFECTIVE": _quoted("lower(hex(event_id))"),
        "_SYSTEMD_UNIT": _quoted("'unit' || (user_id % 5) || '.service'"),
        "_x": "event_id",
    }
    members.update(changes)
    parts = [f"""'"{key}":' || {value}""" for key, value in members.items() if value is not None]
    return F.expr("'{' || " + " || ',' || ".join(parts) + " || '}'")


def gelf_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", *_datagram("gelf", _source(), _bytes(_gelf_json())))


def gelf_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that fill all 62 columns, by ``event_id % 3`` from all keys, from all but each column's first, or from its last alone.

    A value tells its column and its key. Required keys are always there. Numbers are JSON numbers or texts by turns; the stamp
    of a syslog line has one of three forms, by ``event_id div 3 % 3``.
    """
    us = "unix_micros(ts)"
    stamp = (
        "CASE event_id div 3 % 3 WHEN 0 THEN date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") "
        "WHEN 1 THEN date_format(ts, 'd MMM yyyy HH:mm:ss') || ' +0000' ELSE date_format(ts, 'MMM d HH:mm:ss') END"
    )
    members = ["""'"version":"1.1"'"""]
    for at, field in enumerate(C.FIELDS):
        for turn, source in enumerate(field.gelf):
            if source.conversion == "float_sec_to_usec":
                value = _SECONDS
            elif source.conversion == "hex_to_uint":
                value = _quoted(f"lower(hex(event_id * 10 + {turn}))")
            elif source.conversion == "syslog_timestamp":
                value = _quoted(stamp)
            elif field.storage in (C.STRING, C.TEXT):
                value = _quoted(f"'{field.name}.{turn} ' || event_id")
            else:
                number = f"({us} + {turn})" if field.storage in C.TIME_STORAGE else f"(event_id * 1000 + {at * 10 + turn})"
                number = f"(0 - {number})" if field.storage == C.I64 else number
                value = f"if(event_id % 2 = 0, CAST({number} AS string), {_quoted(number)})"
            member = f"""'"{source.key}":' || {value}"""
            last = turn + 1 == len(field.gelf)
            absent = [str(k) for k, gone in ((1, turn == 0 and not last), (2, not last)) if gone]
            if absent and source.key not in C.REQUIRED_GELF_KEYS:
                member = f"if(event_id % 3 IN ({', '.join(absent)}), null, {member})"
            members.append(member)
    payload = _bytes(F.expr("'{' || concat_ws(',', " + ", ".join(members) + ") || '}'"))
    return events(spark, sf_dir).select("event_id", *_datagram("gelf", _source(), payload))


#: What is wrong with each twelfth of ``gelf_bad``, by ``event_id % 12``, as stage and reason.
BAD_REASONS = (
    ("json", "required:host"),
    ("convert", "pid:_PID:not_u64"),
    ("convert", "priority:_PRIORITY:not_u64"),
    ("convert", "facility:facility:not_string"),
    ("convert", "uid:_UID:not_u64"),
    ("valid", "no_time"),
    ("valid", "no_message"),
    ("json", "bad_json"),
    ("json", "bad_utf8"),
    ("convert", "cap_effective:_CAP_EFFECTIVE:not_hex"),
    ("valid", "bad_time"),
    (None, None),
)


def gelf_bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    texts = [
        _gelf_json(host=None),
        _gelf_json(_PID="'null'"),
        _gelf_json(_PRIORITY=_quoted("'high'")),
        _gelf_json(facility="'3'"),
        _gelf_json(_UID="'12.0'"),
        _gelf_json(timestamp=None),
        _gelf_json(short_message=_quoted("''")),
        _text(_gelf_json(), " x"),
        _gelf_json(),
        _gelf_json(_CAP_EFFECTIVE=_quoted("'0x1f'")),
        _gelf_json(timestamp="'-1.5'"),
        _gelf_json(),
    ]
    payload = _bytes(_pick(e % 12, texts))
    payload = F.when(e % 12 == 8, F.concat(payload, F.lit(bytes([0xFF])))).otherwise(payload)
    return events(spark, sf_dir).select("event_id", *_datagram("gelf", _source(), payload))


def _document_json() -> Column:
    d = F.col("doc_id")
    return F.to_json(
        F.struct(
            F.lit("1.1").alias("version"), F.col("lang").alias("host"), _text("doc ", d).alias("short_message"),
            F.col("text").alias("full_message"), F.unix_seconds("ts").alias("timestamp"), d.alias("_PID"),
        )
    )


@F.pandas_udf(T.BinaryType())
def _pack(data: pd.Series, number: pd.Series) -> pd.Series:
    """gzip, zlib or as it is, by number % 3; each fiftieth packed one is cut short."""
    def one(body, n):
        if n % 3 == 2:
            return body
        packed = gzip.compress(body, 6, mtime=0) if n % 3 == 0 else zlib.compress(body)
        return packed[:-5] if n % 50 == 0 else packed

    return pd.Series([one(bytes(b), n) for b, n in zip(data, number)])


def gelf_compressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    payload = _pack(_bytes(_document_json()), F.col("doc_id"))
    return documents(spark, sf_dir).select(
        "doc_id", *_datagram("gelf", _text("10.0.1.", F.col("doc_id") % 7), payload)
    )


def chunk_count() -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(128), F.ceil(F.length("text") / 1000).cast("int")))


def _chunked(spark: SparkSession, sf_dir: str, payload: Column) -> DataFrame:
    """One row per piece: doc_id, ts, n pieces, piece number i, content."""
    whole = documents(spark, sf_dir).select("doc_id", "ts", chunk_count().alias("n"), payload.alias("whole"))
    size = F.ceil(F.octet_length("whole") / F.col("n")).cast("int")
    return (
        whole.withColumn("size", size)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .withColumn("content", F.substr("whole", F.col("i") * F.col("size") + 1, F.col("size")))
        .drop("whole", "size")
    )


def _chunk_datagram(i: Column, n: Column, content: Column, at_us: Column) -> list[Column]:
    def byte(number: Column) -> Column:
        return F.unhex(F.lpad(F.hex(number), 2, "0"))

    header = [F.unhex(F.lit("1E0F")), F.unhex(F.lpad(F.hex("doc_id"), 16, "0")), byte(i), byte(n)]
    return [
        F.col("doc_id"), F.lit("gelf").alias("proto"), _text("10.0.2.", i % 4).alias("src_ip"),
        F.lit(12201).alias("src_port"), F.timestamp_micros(F.unix_micros("ts") + at_us).alias("recv_ts"),
        F.concat(*header, content).alias("payload"),
    ]


def gelf_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunked message, one piece per millisecond.

    Odd ids arrive back to front. Some pieces come twice, the first time early and with other bytes; some chunks
    have a number past the count; some announce a single chunk.
    """
    d, i, n = F.col("doc_id"), F.col("i"), F.col("n")
    pieces = _chunked(spark, sf_dir, _pack(_bytes(_document_json()), d * 3 + F.when(d % 2 == 0, 2).otherwise(0)))
    order = F.when(d % 2 == 1, n - 1 - i).otherwise(i) * 1000 + 500
    first = i == F.when(d % 2 == 1, n - 1).otherwise(0)
    extra = F.when(first & (d % 5 == 0), "wrong").when(first & (d % 7 == 0), "past").when(first & (d % 11 == 0), "lone")
    copies = pieces.withColumn("as", F.explode(F.array_compact(F.array(F.lit("good"), extra))))
    kind = F.col("as")
    number = F.when(kind == "past", n + 1).otherwise(i)
    total = F.when(kind == "lone", 1).otherwise(n)
    content = F.when(kind == "good", F.col("content")).otherwise(_bytes(kind))
    at = F.when(kind == "good", order).otherwise(100)
    return copies.select(*_chunk_datagram(number, total, content, at))


def gelf_chunks_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ``doc_id % 5``: 0 the last piece is missing, 1 it is 6 s late, 2 it is 4.9 s late, others are whole."""
    d, i, n = F.col("doc_id"), F.col("i"), F.col("n")
    pieces = _chunked(spark, sf_dir, _bytes(_document_json()))
    last = i == n - 1
    at = F.when(last & (d % 5 == 1), 6_000_000).when(last & (d % 5 == 2), 4_900_000).otherwise(i * 1000)
    return pieces.where(~(last & (d % 5 == 0))).select(*_chunk_datagram(i, n, F.col("content"), at))


def gelf_chunks_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a chunked message, all under one id. For each third document the last piece comes twice at one instant."""
    d, i, n = F.col("number"), F.col("i"), F.col("n")
    pieces = _chunked(spark, sf_dir, _bytes(_document_json())).withColumnRenamed("doc_id", "number").withColumn("doc_id", F.lit(7).cast("bigint"))
    twice = F.when((i == n - 1) & (d % 3 == 0), F.array(F.lit(12201), F.lit(12202))).otherwise(F.array(F.lit(12201)))
    sent = pieces.withColumn("port", F.explode(twice))
    return sent.select(*_chunk_datagram(i, n, F.col("content"), i * 1000), F.col("port")).withColumn("src_port", F.col("port")).drop("port")


NESTED_LEVELS = 4


def gelf_chunks_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in two pieces: the first plain, the datagram of the second cut in two pieces again, and so on."""
    rows = documents(spark, sf_dir).select("doc_id", "ts", _bytes(_document_json()).alias("rest"))
    sent = []
    for level in range(NESTED_LEVELS):
        half = F.ceil(F.octet_length("rest") / 2).cast("int")
        number = F.col("doc_id") + level * (1 << 40)
        header = [F.unhex(F.lit("1E0F")), F.unhex(F.lpad(F.hex(number), 16, "0"))]
        first = F.concat(*header, F.unhex(F.lit("0002")), F.substr("rest", F.lit(1), half))
        second = F.concat(*header, F.unhex(F.lit("0102")), F.substr("rest", half + 1, F.octet_length("rest")))
        rows = rows.withColumns({f"sent{level}": first, "rest": second})
        sent.append(f"sent{level}")
    pieces = rows.select("doc_id", "ts", F.posexplode(F.array(*sent, "rest")).alias("i", "payload"))
    return pieces.select(
        "doc_id", F.lit("gelf").alias("proto"), _text("10.0.2.", F.col("i")).alias("src_ip"), F.lit(12201).alias("src_port"),
        F.timestamp_micros(F.unix_micros("ts") + F.col("i") * 1000).alias("recv_ts"), "payload",
    )


#: Chunks that are refused, by ``event_id % 4``: milliseconds after the event, number, count, a mark, and the reason, if it is
#: not displaced by a later chunk.
REFUSED_PIECES = (
    (0, 0, 0, 3, "a", "expired"), (0, 1, 1, 3, "b", "expired"),
    (1, 0, 0, 2, "a", "expired"), (1, 1, 7, 2, "past", "chunk_seqno"),
    (2, 0, 0, 1, "lone", "chunk_count"),
    (3, 0, 1, 3, "old", None), (3, 1, 1, 3, "new", "expired"), (3, 2, 2, 3, "c", "expired"),
)


def gelf_chunks_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every event that never become a message."""
    kinds = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(("k", "ms", "i", "n", "mark"), p)]) for p in REFUSED_PIECES])
    rows = events(spark, sf_dir).withColumn("doc_id", F.col("event_id")).select("doc_id", "ts", F.inline(kinds)).where(F.col("doc_id") % 4 == F.col("k"))
    return rows.select(*_chunk_datagram(F.col("i"), F.col("n"), _bytes(_text(F.col("mark"), F.col("doc_id"))), F.col("ms") * 1000))


def hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses named after suppliers; 10.0.0.4 is not known."""
    return table(spark, sf_dir, "supplier").where(F.col("s_suppkey") != 4).select(
        _text("10.0.0.", F.col("s_suppkey")).alias("ip"), F.col("s_name").alias("name")
    )


def datagrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of datagrams in one table."""
    parts = [
        f(spark, sf_dir).select(*_DATAGRAM)
        for f in (syslog_from_events, gelf_bad, gelf_compressed, gelf_chunks)
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PARTS = 4


def datagrams_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of datagrams with the ``part`` in which they are read: each part spans all times, and a third of the
    chunked messages begins in one part and ends in the next."""
    number = {"syslog_from_events": "event_id", "gelf_bad": "event_id", "gelf_compressed": "doc_id", "gelf_chunks": "doc_id"}
    out = None
    for f in (syslog_from_events, gelf_bad, gelf_compressed, gelf_chunks):
        part = F.col(number[f.__name__]) % (PARTS - 1)
        if f is gelf_chunks:
            late = F.unix_micros("recv_ts") - F.col("doc_id") * 37_000_000 - 1_704_067_200_000_000 > 1500
            part = F.when((part == PARTS - 2) & late, PARTS - 1).otherwise(part)
        rows = f(spark, sf_dir).select(*_DATAGRAM, part.cast("int").alias("part"))
        out = rows if out is None else out.unionByName(rows)
    return out


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of the events, through the syslog decoder."""
    lines = syslog_from_events(spark, sf_dir)
    return valid_logs(normalize_syslog(parse_syslog_table(lines))).select(*C.FIELD_NAMES)


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records with the documents as messages."""
    lines = syslog_from_documents(spark, sf_dir)
    return valid_logs(normalize_syslog(parse_syslog_table(lines))).select(*C.FIELD_NAMES)
