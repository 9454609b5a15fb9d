"""From datagrams to records and refused rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.functions.columns import settle
from logkiln.operators import chunks as K
from logkiln.operators import nested as N
from logkiln.operators.enrich import HostTable, merge_logs, resolve_hostnames
from logkiln.operators.gelf import decode_gelf_packets
from logkiln.operators.normalize import invalid_reason, normalize_gelf, normalize_syslog
from logkiln.operators.packets import CHUNK, classify_packets
from logkiln.operators.search import event_date
from logkiln.operators.syslog import parse_syslog_table
from logkiln.sources.ingest_table import commit_run
from logkiln.sources.log_table import write_ingested
from logkiln.sources.ndjson import json_line
from logkiln.staging import stage

#: What the decoders take: datagrams, and what is already known to be wrong with them.
PACKET = [*C.DATAGRAM.fieldNames(), "chunk_reason"]
#: What is known of a reassembled group.
K_COLUMNS = ("status", "src_ip", "src_port", "recv_ts", "payload", "pieces")


def _packets(df: DataFrame, chunk_reason: Column | None = None) -> DataFrame:
    reason = F.lit(None).cast("string") if chunk_reason is None else chunk_reason
    return df.select(*C.DATAGRAM.fieldNames(), reason.alias("chunk_reason"))


def group_packets(groups: DataFrame) -> DataFrame:
    """Reassembled groups as packets: messages, and for what never became one each chunk that came, with the reason."""
    reason = F.when(F.col("status") == K.EXPIRED, "expired").when(F.col("status") == K.IGNORED, "chunk_seqno")
    message = F.array(F.struct("src_ip", "src_port", "recv_ts", "payload")).cast(f"array<{K.PIECE}>")
    # A group that no chunk filled a slot of only had ignored ones, which have rows of their own.
    came = groups.select("status", F.explode(F.when(reason.isNull(), message).otherwise(F.col("pieces"))).alias("one"))
    return _packets(came.select(F.lit("gelf").alias("proto"), "one.*", reason.alias("r")), F.col("r"))


def whole_packets(classified: DataFrame) -> DataFrame:
    """Classified datagrams that need no reassembly; chunks that announce too few are refused here."""
    lone = (F.col("kind") == CHUNK) & (F.col("count") < K.MIN_COUNT)
    return _packets(classified.where((F.col("kind") != CHUNK) | lone), F.when(lone, "chunk_count"))


def chunk_rows(classified: DataFrame, *more: str) -> DataFrame:
    return classified.where((F.col("kind") == CHUNK) & (F.col("count") >= K.MIN_COUNT)).select(
        "src_ip", "src_port", "recv_ts", "chunk_id", "seqno", "count", "content", *more
    )


def _content(inner: DataFrame | None) -> tuple:
    """Two equal results for equal sets of inner chunks, whatever their order."""
    return (0, None) if inner is None else tuple(inner.agg(F.count("*"), F.sum(F.xxhash64(*N.ARRIVAL).cast("decimal(38,0)"))).first())


def reassemble_nested(chunks: DataFrame, key: tuple[str, ...] = ("chunk_id",), **options) -> DataFrame:
    """``reassemble_chunks`` where messages may be chunks again, to any depth; those have no row of their own then.

    Such a message takes part like a datagram that came when its last chunk did, beside the plain chunks of its id. Which messages
    come out may change which others do, so this goes on, for the ids concerned only, until the inner chunks are
    the same twice. Each is 12 bytes shorter than what it came in and never comes before it, so what
    is settled up to some instant and depth stays so, and rounds end. Rounds go over arrival facts; contents are staged with the chunks
    and joined once, to the pieces of the groups that come out, which are staged. Of inner chunks that are equal but for their content the hashes of
    the pieces that they are made of give the order.
    """
    chunks = stage(N.with_facts(chunks, key))
    if chunks.isEmpty():
        return chunks.sparkSession.createDataFrame([], K.GROUP)
    facts, contents = chunks.select(*N.FACTS), chunks.select(*N.ARRIVAL, "content")
    first = pieces = stage(K.assign_arrivals(facts, **options))
    own = inner = N.inner_chunks(first, facts, key, contents)
    before: DataFrame | None = None
    while _content(inner) != _content(before):
        ids = stage(inner.select("k").distinct())
        touched = stage(facts.join(ids, "k", "left_semi").unionByName(inner.select(*N.FACTS)))
        again = stage(K.assign_arrivals(touched, **options))
        pieces = first.join(ids, "k", "left_anti").unionByName(again)
        before, below = inner, N.inner_chunks(again, touched, key, contents, inner)
        inner = own.join(ids.withColumnRenamed("k", "of"), "of", "left_anti").select(*own.columns)
        inner = stage(inner if below is None else inner.unionByName(below))
    if inner is not None:
        nested = inner.select(F.col("of").alias("k"), "scope", "n", F.lit(K.COMPLETE).alias("status"))
        pieces = pieces.join(nested, ["k", "scope", "n", "status"], "left_anti").select(*first.columns)
        facts = facts.unionByName(inner.select(*N.FACTS))
    rows = K.winners(pieces, facts, K.hot_ids(facts, options.get("hot_rows", K.HOT_ROWS)))
    return stage(K.assembled(rows if inner is None else N.unfolded_rows(rows, inner), contents))


def assemble(gelf: DataFrame, **options) -> DataFrame:
    """GELF datagrams to packets; messages that are chunks again are joined too, to any depth."""
    classified = classify_packets(gelf)
    groups = classify_packets(reassemble_nested(chunk_rows(classified), **options))
    # A message that announces itself as one chunk of one or none is refused like such a datagram.
    lone = (F.col("status") == K.COMPLETE) & (F.col("kind") == CHUNK) & (F.col("count") < K.MIN_COUNT)
    groups = groups.select(*K_COLUMNS, F.coalesce(lone, F.lit(False)).alias("lone"))
    refused = _packets(groups.where("lone").select(F.lit("gelf").alias("proto"), "src_ip", "src_port", "recv_ts", "payload"), F.lit("chunk_count"))
    return whole_packets(classified).unionByName(group_packets(groups.where("not lone"))).unionByName(refused)


_KEEP = ("src_ip", "recv_ts", "payload")


def decode_gelf(packets: DataFrame) -> DataFrame:
    """GELF packets to log columns with ``stage`` and ``reason``."""
    bodies = decode_gelf_packets(classify_packets(packets))
    nested = F.when(F.col("kind") == CHUNK, "nested_chunk")
    packet_reason = F.coalesce("packet_reason", nested)
    checks = {
        "_stage1": F.when(F.col("chunk_reason").isNotNull(), "chunk")
        .when(packet_reason.isNotNull(), "packet")
        .when(F.col("inflate_reason").isNotNull(), "inflate")
        .when(F.col("json_reason").isNotNull(), "json"),
        "_reason1": F.coalesce("chunk_reason", packet_reason, "inflate_reason", "json_reason"),
    }
    return with_reasons(normalize_gelf(bodies.withColumns(checks), (*_KEEP, "_stage1", "_reason1")))


def decode_syslog(packets: DataFrame, zone: str = "UTC") -> DataFrame:
    """Syslog packets to log columns with ``stage`` and ``reason``."""
    parsed = parse_syslog_table(packets.select(*_KEEP), zone)
    none = F.lit(None).cast("string")
    return with_reasons(
        normalize_syslog(parsed.withColumns({"_stage1": none, "_reason1": none}), (*_KEEP, "_stage1", "_reason1"))
    )


def with_reasons(df: DataFrame) -> DataFrame:
    """The first reason a row is refused for, and the stage that found it."""
    invalid = invalid_reason()
    found = (
        F.when(F.col("_stage1").isNotNull(), F.col("_stage1"))
        .when(F.col("convert_reason").isNotNull(), "convert")
        .when(invalid.isNotNull(), "valid")
    )
    marked = df.withColumns(
        {"stage": found, "reason": F.coalesce("_reason1", "convert_reason", invalid)}
    ).drop("_stage1", "_reason1", "convert_reason")
    return settle(marked, "stage", "reason")


def _finished(rows: DataFrame, hosts: DataFrame | HostTable | None) -> DataFrame:
    if hosts is not None:
        rows = resolve_hostnames(rows, hosts)
    else:
        rows = rows.withColumn("hostname", F.coalesce("hostname", "src_ip"))
    refused = F.col("reason").isNotNull()
    return rows.withColumns(
        {
            "payload": F.when(refused, F.col("payload")),
            C.DATE_FIELD: F.when(refused, event_date("recv_ts")).otherwise(event_date()),
        }
    )


def decode_packets(packets: DataFrame, hosts: DataFrame | HostTable | None = None, zone: str = "UTC") -> DataFrame:
    """Packets of both kinds to log columns, ``src_ip``, ``recv_ts``, ``payload``, ``stage``,
    ``reason`` (null for records) and ``event_date``. Only refused rows keep their payload."""
    gelf = decode_gelf(packets.where(F.col("proto") == "gelf"))
    syslog = decode_syslog(packets.where(F.col("proto") == "syslog"), zone)
    return _finished(merge_logs(gelf, syslog), hosts)


def decode_datagrams(datagrams: DataFrame, hosts: DataFrame | HostTable | None = None, zone: str = "UTC", **options) -> DataFrame:
    """A datagram table to the columns of ``decode_packets``. Syslog is read once; GELF twice,
    for chunks and for the rest."""
    gelf = decode_gelf(assemble(datagrams.where(F.col("proto") == "gelf"), **options))
    syslog = decode_syslog(datagrams.where(F.col("proto") == "syslog"), zone)
    return _finished(merge_logs(gelf, syslog), hosts)


def accepted(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("reason").isNull()).select(*C.FIELD_NAMES, C.DATE_FIELD)


def quarantine(decoded: DataFrame) -> DataFrame:
    """The rows that were refused, with the stage and the reason."""
    return decoded.where(F.col("reason").isNotNull()).select(*C.QUARANTINE_COLUMNS)


def batch_stats(decoded: DataFrame) -> DataFrame:
    """One row: messages received, records written, their JSON bytes, and bytes per message received."""
    return decoded.agg(*_stats())


def _stats() -> list[Column]:
    size = F.when(F.col("reason").isNull(), F.octet_length(json_line()) + 1)
    written = F.coalesce(F.sum(size), F.lit(0)).cast("bigint")
    return [
        F.count("*").alias("messages"),
        F.count(F.when(F.col("reason").isNull(), 1)).alias("records"),
        written.alias("bytes_written"),
        F.floor(written / F.greatest(F.count("*"), F.lit(1))).cast("bigint").alias("bytes_per_message"),
    ]


def ingest(datagrams: DataFrame, path: str, hosts: DataFrame | HostTable | None = None, run: str | None = None, **options) -> None:
    """Decode a datagram table and write records and refused rows in one pass.

    Every call adds to the path; one with the name of an earlier ``run`` replaces what that wrote.
    """
    write_ingested(decode_datagrams(datagrams, hosts, **options), path, run or uuid.uuid4().hex)


def ingest_into_table(datagrams: DataFrame, table: str, hosts: DataFrame | HostTable | None = None, run: str | None = None, **options) -> bool:
    """The same into a catalog table made by ``ensure_ingest_table``; a run that is there already is left out, with False."""
    return commit_run(decode_datagrams(datagrams, hosts, **options), table, run or uuid.uuid4().hex)
