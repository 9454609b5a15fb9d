"""Registered queries, and for each the SQL that gives the same rows from the original columns.

The queries encode whole test tables into datagrams and run the jobs on those; the SQL never
parses a datagram but starts from the columns that went in.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln import fixtures as X
from logkiln.deploy import ship_package
from logkiln.functions import text as P
from logkiln.operators import search as S
from logkiln.operators.chunks import expired_chunks, reassemble_chunks
from logkiln.operators.enrich import merge_logs, resolve_hostnames
from logkiln.operators.gelf import decode_gelf_json, decode_gelf_packets, gelf_messages
from logkiln.operators.normalize import normalize_gelf, normalize_syslog, valid_logs
from logkiln.operators.packets import classify_packets, inflate
from logkiln.operators.syslog import parse_syslog_table
from logkiln.plans.ingest import batch_stats, chunk_rows, decode_datagrams, decode_gelf, decode_packets, ingest_into_table, quarantine, whole_packets
from logkiln.sources import ingest_table as T
from logkiln.sources.log_table import apply_retention
from logkiln.sources.ndjson import from_ndjson, to_ndjson
from logkiln.staging import shared_folder, stage
from logkiln.streaming.ingest import start_ingest

# The corpus operators and their pipeline may be left out of an installation.
try:
    import corpus_pipeline
    from logkiln.llm import queries as corpus
except ModuleNotFoundError as e:
    if e.name not in ("corpus_pipeline", "logkiln.llm", "logkiln.llm.queries"):
        raise
    corpus = corpus_pipeline = None

NOW = datetime(2024, 1, 31, tzinfo=timezone.utc)
DAY10, DAY12 = 1_704_844_800, 1_705_017_600  # 2024-01-10 and 2024-01-12


def _us(name: str = "source_timestamp"):
    return F.unix_micros(name).alias(f"{name}_us")


def _chunk_number():
    return F.conv(F.hex("chunk_id"), 16, 10).cast("bigint").alias("doc_id")


# --- decoding ---------------------------------------------------------------------------


def syslog_normalize(spark, d):
    return X.event_logs(spark, d).select(
        _us(), "hostname", "message", "priority", "full_message", "facility", "syslog_identifier", "syslog_pid"
    )


def syslog_pri_decode(spark, d):
    return parse_syslog_table(X.syslog_pri(spark, d)).select("event_id", "priority", "facility", "message")


def syslog_quirks(spark, d):
    return parse_syslog_table(X.syslog_quirks(spark, d)).select(
        "event_id", "priority", "facility", _us(), "hostname", "identifier", "message"
    )


def classify(spark, d):
    rows = X.datagrams(spark, d).where(F.col("proto") == "gelf")
    return classify_packets(rows).groupBy("kind").agg(F.count("*").alias("n"))


def _normalized(df: DataFrame) -> DataFrame:
    """Records that are not refused for their text or the form of their values."""
    bodies = decode_gelf_packets(classify_packets(df))
    return normalize_gelf(bodies.where(F.col("json_reason").isNull())).where(F.col("convert_reason").isNull())


def gelf_normalize(spark, d):
    return valid_logs(_normalized(X.gelf_from_events(spark, d))).select(
        _us(), "hostname", "message", "priority", "pid", F.col("cap_effective").cast("bigint").alias("cap_effective"),
        "systemd_unit", "full_message", "convert_reason",
    )


def gelf_all_columns(spark, d):
    """All 62 columns, each from the first key that is there."""
    bodies = decode_gelf_packets(classify_packets(X.gelf_full(spark, d)))
    columns = [_us(f.name) if f.storage in C.TIME_STORAGE else F.col(f.name).cast("bigint").alias(f.name) if f.name == "cap_effective" else F.col(f.name) for f in C.FIELDS]
    return normalize_gelf(bodies, ("event_id", "recv_ts", "json_reason")).select("event_id", "json_reason", "convert_reason", *columns)


def gelf_general_form(spark, d):
    bodies = decode_gelf_json(inflate(classify_packets(X.gelf_from_events(spark, d))))
    m = F.col("message")
    return gelf_messages(bodies.where(F.col("json_reason").isNull())).select(
        "event_id", m.version.alias("version"), m.host.alias("host"), m.short_message.alias("short_message"),
        F.size(m.other).cast("bigint").alias("n_other"), m.other["_x"].cast("bigint").alias("x"),
    )


def gelf_inflate(spark, d):
    good = _normalized(X.gelf_compressed(spark, d)).where(F.col("message").isNotNull())
    return good.select("pid", "hostname", F.md5("full_message").alias("text_md5"), F.length("full_message").cast("bigint").alias("n"))


def gelf_inflate_errors(spark, d):
    opened = inflate(classify_packets(X.gelf_compressed(spark, d)))
    return opened.where(F.col("inflate_reason").isNotNull()).select("doc_id", F.col("inflate_reason").alias("reason"))


def gelf_chunks(spark, d):
    groups = reassemble_chunks(chunk_rows(classify_packets(X.gelf_chunks(spark, d))))
    whole = groups.where(F.col("status") == "complete").withColumn("doc_id", _chunk_number())
    messages = decode_gelf_packets(classify_packets(whole))
    return normalize_gelf(messages, ("doc_id", "size", "src_ip", "recv_ts")).select(
        "doc_id", F.col("size").cast("bigint").alias("size"), "src_ip", "hostname", _us(), _us("recv_ts"),
        F.md5("full_message").alias("text_md5"),
    )


def gelf_chunks_hot(spark, d):
    """One id with all pieces of all documents, cut into blocks."""
    groups = stage(reassemble_chunks(stage(chunk_rows(classify_packets(X.gelf_chunks_hot(spark, d)))), hot_rows=0))
    text = F.get_json_object(F.col("payload").cast("string"), "$.full_message")
    return groups.select(
        "status", _us("opened_ts"), F.col("size").cast("bigint").alias("size"), F.col("present").cast("bigint").alias("present"), "src_ip",
        F.col("src_port").cast("bigint").alias("src_port"), _us("recv_ts"), F.md5(text).alias("text_md5"),
        F.transform("pieces", lambda p: p["src_port"])[0].cast("bigint").alias("piece_port"),
    )


def gelf_chunks_nested(spark, d):
    rows = decode_datagrams(X.gelf_chunks_nested(spark, d))
    return rows.select(
        F.col("pid").alias("doc_id"), "src_ip", _us("recv_ts"), "hostname", _us(), F.md5("full_message").alias("text_md5"), "reason"
    )


def quarantine_rows(spark, d):
    refused = quarantine(decode_datagrams(X.gelf_chunks_refused(spark, d)))
    return refused.select("src_ip", _us("recv_ts"), "stage", "reason", F.md5(F.hex("payload").cast("binary")).alias("payload_md5"))


def gelf_chunks_expired(spark, d):
    groups = reassemble_chunks(chunk_rows(classify_packets(X.gelf_chunks_late(spark, d))))
    return groups.select(
        _chunk_number(), "status", F.col("size").cast("bigint").alias("size"),
        F.col("present").cast("bigint").alias("present"),
    )


def gelf_chunks_expired_only(spark, d):
    groups = reassemble_chunks(chunk_rows(classify_packets(X.gelf_chunks_late(spark, d))))
    return expired_chunks(groups).groupBy("size").agg(F.count("*").alias("n"), F.sum("present").alias("present")).select(
        F.col("size").cast("bigint").alias("size"), "n", "present"
    )


def gelf_reject_reasons(spark, d):
    refused = quarantine(decode_gelf(whole_packets(classify_packets(X.gelf_bad(spark, d)))))
    return refused.groupBy("stage", "reason").agg(
        F.count("*").alias("n"), F.countDistinct("src_ip").alias("n_sources"), F.count("payload").alias("n_payloads")
    )


# --- checking, enriching, merging ---------------------------------------------------------


def valid_logs_query(spark, d):
    bodies = decode_gelf_packets(classify_packets(X.gelf_bad(spark, d)))
    good = bodies.where(F.col("json_reason").isNull())
    return valid_logs(normalize_gelf(good).where(F.col("convert_reason").isNull())).select(_us(), "hostname", "message", "pid")


def _with_source(spark, d):
    return valid_logs(normalize_syslog(parse_syslog_table(X.syslog_from_events(spark, d))))


def resolve(spark, d):
    return resolve_hostnames(_with_source(spark, d), X.hosts(spark, d)).select("syslog_pid", "hostname")


def merge(spark, d):
    gelf = valid_logs(_normalized(X.gelf_from_events(spark, d)))
    return merge_logs(gelf, _with_source(spark, d)).select(
        _us(), "hostname", "message", "priority", F.coalesce("pid", "syslog_pid").alias("any_pid")
    )


def ingest_outcomes(spark, d):
    rows = decode_datagrams(X.datagrams(spark, d), X.hosts(spark, d))
    return rows.groupBy("stage", "reason").agg(F.count("*").alias("n"))


def ingest_by_host(spark, d):
    rows = decode_datagrams(X.datagrams(spark, d), X.hosts(spark, d)).where(F.col("reason").isNull())
    return rows.groupBy("hostname").agg(
        F.count("*").alias("n"), F.sum(F.unix_micros("source_timestamp") % 1_000_000_007).alias("time_sum"),
        F.sum(F.length("message")).alias("message_chars"), F.count("full_message").alias("n_full"),
    )


def stream_ingest_outcomes(spark, d):
    """The datagrams as a stream that reads them out of the order of time, into a table."""
    name = f"stream_{uuid.uuid4().hex}"
    folder = f"{shared_folder(spark)}/{name}"
    T.ensure_ingest_table(spark, name, f"{folder}/table")
    # The part is known before a row is encoded, so each row is made for its part only, and written once.
    rows, files = X.datagrams_in_parts(spark, d), max(8, spark.sparkContext.defaultParallelism)
    for part in range(X.PARTS):
        own = rows.where(F.col("part") == part).drop("part")
        # A micro-batch is to take in one part, so each has the same number of files. Only small inputs have to be dealt out for that.
        whole = own.coalesce(files)
        full = whole.select(F.spark_partition_id().alias("p")).distinct().count() == files
        (whole if full else own.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    start_ingest(spark, f"{folder}/in", None, f"{folder}/checkpoint", X.hosts(spark, d), interval=None, max_files=files, table=name).awaitTermination()
    return spark.table(name).groupBy("stage", "reason").agg(F.count("*").alias("n"))


# --- searching ----------------------------------------------------------------------------


def _hits(df: DataFrame) -> DataFrame:
    return df.select(_us(), "hostname", "priority", "syslog_identifier", "syslog_pid", F.md5("message").alias("message_md5"))


def search_time_range(spark, d):
    return _hits(S.search(X.event_logs(spark, d), None, DAY10, DAY12))


def search_relative(spark, d):
    return _hits(S.search(X.event_logs(spark, d), None, *S.relative_range(NOW, 1440)))


def search_term(spark, d):
    return _hits(S.search(X.document_logs(spark, d), P.term("Que")))


def search_phrase(spark, d):
    return _hits(S.search(X.document_logs(spark, d), P.phrase("of the")))


def search_field_eq(spark, d):
    return _hits(S.search(X.event_logs(spark, d), P.all_of(P.field_eq("hostname", "h3"), P.field_eq("syslog_identifier", "error"))))


def search_field_range(spark, d):
    test = P.all_of(P.field_range("priority", 2, 4), P.field_range("source_timestamp", datetime(2024, 1, 5), datetime(2024, 1, 20, 12)))
    return _hits(S.search(X.event_logs(spark, d), test))


def _bool_test():
    either = P.any_of(P.term("error"), P.field_eq("priority", 2))
    return P.all_of(either, P.none_of(P.field_eq("hostname", "h1"), P.field_eq("facility", "cron")))


def search_bool(spark, d):
    return _hits(S.search(X.event_logs(spark, d), _bool_test()))


def search_summary(spark, d):
    return S.search_summary(X.event_logs(spark, d), _bool_test(), DAY10).select(
        "num_hits", F.col("hits_returned").cast("bigint").alias("hits_returned")
    )


def token_lists(spark, d):
    words = P.tokens(F.col("text"))
    return X.documents(spark, d).select(
        "doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("tokens_md5")
    )


def discover_columns(spark, d):
    return S.discover_columns(S.search(X.event_logs(spark, d), None, DAY10, DAY12))


def field_list(spark, d):
    return S.field_list(S.search(X.event_logs(spark, d), None, DAY10, DAY12))


def display_rows(spark, d):
    logs = valid_logs(_normalized(X.gelf_from_events(spark, d)))
    return S.hits_to_display(logs).select("source_timestamp", "hostname", "message", "priority", "pid", "cap_effective", "full_message")


def select_view(spark, d):
    return S.select_view(S.search(X.event_logs(spark, d), P.field_eq("hostname", "h2")))


# --- tables -------------------------------------------------------------------------------


def ndjson_roundtrip(spark, d):
    logs = valid_logs(_normalized(X.gelf_from_events(spark, d)))
    return from_ndjson(to_ndjson(logs)).select(
        _us(), "hostname", "message", "priority", "pid", F.col("cap_effective").cast("bigint").alias("cap_effective"), "systemd_unit"
    )


def ndjson_lines(spark, d):
    return to_ndjson(X.event_logs(spark, d))


def retention(spark, d):
    return apply_retention(X.event_logs(spark, d), NOW, 10).select(_us(), "syslog_pid")


def batch_stats_query(spark, d):
    packets = X.syslog_from_events(spark, d).withColumn("chunk_reason", F.lit(None).cast("string"))
    return batch_stats(decode_packets(packets, X.hosts(spark, d)))


def _ingested(spark, d, **options) -> str:
    """A table that the event lines were written to in three runs, one of them twice."""
    name = f"log_table_{uuid.uuid4().hex}"
    T.ensure_ingest_table(spark, name, f"{shared_folder(spark)}/{name}", **options)
    lines = X.syslog_from_events(spark, d)
    for k in (0, 1, 2, 1):
        ingest_into_table(lines.where(F.col("event_id") % 3 == k), name, run=f"part-{k}")
    return name


def log_table_search(spark, d):
    return _hits(S.search(T.records(spark, _ingested(spark, d)), P.term("error"), *S.relative_range(NOW, 1440)))


def newest_errors_wide(spark, d):
    """The newest 1000 error lines of all time, from a table by days."""
    return _hits(T.search_newest(spark, _ingested(spark, d), P.term("error")))


def search_page(spark, d):
    page = S.search_page(X.event_logs(spark, d), _bool_test(), DAY10)
    return _hits(page.hits).withColumns({"num_hits": F.lit(page.num_hits).cast("bigint"), "columns": F.lit(",".join(page.columns))})


def retention_drop(spark, d):
    name = _ingested(spark, d, retention_days=10)
    T.drop_expired(spark, name, NOW)
    return T.records(spark, name).select(_us(), "syslog_pid")


def compact_day(spark, d):
    name = _ingested(spark, d)
    T.compact_finished_days(spark, name, NOW)
    rows = spark.table(name).select(F.col("event_date").cast("string").alias("day"), "syslog_pid", _us(), F.col("_metadata.file_path").alias("file"))
    return rows.groupBy("day").agg(
        F.count("*").alias("n"), F.countDistinct("file").alias("n_files"), F.sum("syslog_pid").alias("pid_sum"),
        F.sum(F.col("source_timestamp_us") % 1_000_000_007).alias("time_sum"),
    )


def newest_errors(spark, d):
    """The newest 1000 error lines of the last day of data."""
    return _hits(S.search(X.event_logs(spark, d), P.term("error"), *S.relative_range(NOW, 1440)))


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The newest 1000 error lines of the last day of data, from raw lines."""
    ship_package(spark)
    return newest_errors(spark, sf_dir)


def _shipping(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = {
        "syslog_normalize": syslog_normalize,
        "syslog_pri_decode": syslog_pri_decode,
        "syslog_quirks": syslog_quirks,
        "classify_packets": classify,
        "gelf_normalize": gelf_normalize,
        "gelf_all_columns": gelf_all_columns,
        "gelf_general_form": gelf_general_form,
        "gelf_inflate": gelf_inflate,
        "gelf_inflate_errors": gelf_inflate_errors,
        "gelf_chunks": gelf_chunks,
        "gelf_chunks_hot": gelf_chunks_hot,
        "gelf_chunks_nested": gelf_chunks_nested,
        "quarantine_rows": quarantine_rows,
        "gelf_chunks_expired": gelf_chunks_expired,
        "gelf_chunks_expired_only": gelf_chunks_expired_only,
        "gelf_reject_reasons": gelf_reject_reasons,
        "valid_logs": valid_logs_query,
        "resolve_hostnames": resolve,
        "merge_logs": merge,
        "ingest_outcomes": ingest_outcomes,
        "ingest_by_host": ingest_by_host,
        "stream_ingest_outcomes": stream_ingest_outcomes,
        "log_table_search": log_table_search,
        "newest_errors_wide": newest_errors_wide,
        "search_page": search_page,
        "retention_drop": retention_drop,
        "compact_day": compact_day,
        "newest_errors": newest_errors,
        "search_time_range": search_time_range,
        "search_relative": search_relative,
        "search_term": search_term,
        "search_phrase": search_phrase,
        "search_field_eq": search_field_eq,
        "search_field_range": search_field_range,
        "search_bool": search_bool,
        "search_summary": search_summary,
        "token_lists": token_lists,
        "discover_columns": discover_columns,
        "field_list": field_list,
        "display_rows": display_rows,
        "select_view": select_view,
        "ndjson_roundtrip": ndjson_roundtrip,
        "ndjson_lines": ndjson_lines,
        "retention": retention,
        "batch_stats": batch_stats_query,
    }
    if corpus is not None:
        named |= corpus.QUERIES | {"pipeline": corpus_pipeline.run}
    return {name: _shipping(query) for name, query in named.items()}


# --- the same in SQL ------------------------------------------------------------------------

_FACILITY = (
    "CASE WHEN {n} < 16 THEN ['kern','user','mail','daemon','auth','syslog','lpr','news','uucp','cron',"
    "'authpriv','ftp','ntp','audit','alert','clock'][{n} + 1] ELSE 'local' || ({n} - 16) END"
)
_STAMP = "strftime({t}, '%b') || ' ' || lpad(CAST(day({t}) AS VARCHAR), 2, ' ') || ' ' || strftime({t}, '%H:%M:%S')"
_CENTS = "CAST(round(value * 100) AS BIGINT)"

# The records the syslog decoder makes of the events.
_EVENT_LOGS = f"""
SELECT event_id, user_id, event_type,
  epoch_us(date_trunc('second', ts)) AS source_timestamp_us,
  CASE WHEN event_id % 7 <> 0 THEN 'h' || (user_id % 5) END AS hostname,
  'value=' || {_CENTS} AS message,
  CAST(event_id % 8 AS BIGINT) AS priority,
  '<' || ((event_id % 24) * 8 + event_id % 8) || '>' || {_STAMP.format(t='ts')} || ' ' ||
    CASE WHEN event_id % 7 = 0 THEN '' ELSE 'h' || (user_id % 5) || ' ' END ||
    event_type || '[' || event_id || ']: value=' || {_CENTS} AS full_message,
  {_FACILITY.format(n='(event_id % 24)')} AS facility,
  event_type AS syslog_identifier, event_id AS syslog_pid
FROM events
"""
_DOC_LOGS = f"""
SELECT doc_id, t, epoch_us(t) AS source_timestamp_us, lang AS hostname, text AS message,
  CAST(6 AS BIGINT) AS priority,
  '<14>' || {_STAMP.format(t='t')} || ' ' || lang || ' doc[' || doc_id || ']: ' || text AS full_message,
  'doc' AS syslog_identifier, doc_id AS syslog_pid
FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37) AS t FROM documents)
"""
# The instant of a GELF event: its seconds pass through a double.
_GELF_US = (
    "CAST(trunc(CAST((epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0')"
    " AS DOUBLE) * 1000000) AS BIGINT)"
)
def _full_column(at: int, field: C.Field) -> str:
    """What ``gelf_full`` puts into a column: the value of the key that wins by ``event_id % 3``."""
    keys, last = field.gelf, len(field.gelf) - 1
    always = keys[0].key in C.REQUIRED_GELF_KEYS
    turn = "0" if always or not last else f"(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE {last} END)"
    if field.name == C.TIME_FIELD:
        return f"CASE WHEN event_id % 3 = 0 THEN {_GELF_US} ELSE epoch_us(ts) + {turn} END AS {field.name}_us"
    if keys[0].conversion == "syslog_timestamp":
        return f"(epoch_us(ts) // 1000000) * 1000000 AS {field.name}_us"
    if field.storage in C.TIME_STORAGE:
        return f"epoch_us(ts) + {turn} AS {field.name}_us"
    if keys[0].conversion == "hex_to_uint":
        return f"CAST(event_id * 10 + {turn} AS BIGINT) AS {field.name}"
    if field.storage in (C.STRING, C.TEXT):
        return f"'{field.name}.' || {turn} || ' ' || event_id AS {field.name}"
    sign = "-" if field.storage == C.I64 else ""
    return f"CAST({sign}(event_id * 1000 + {at * 10} + {turn}) AS BIGINT) AS {field.name}"


_GELF_LOGS = f"""
SELECT event_id, {_GELF_US} AS source_timestamp_us, 'h' || (user_id % 5) AS hostname, event_type AS message,
  CAST(event_id % 8 AS BIGINT) AS priority, event_id AS pid, event_id AS cap_effective,
  'unit' || (user_id % 5) || '.service' AS systemd_unit
FROM events
"""
_HIT = "source_timestamp_us, hostname, priority, syslog_identifier, syslog_pid, md5(message) AS message_md5"
_NEWEST = (
    "ORDER BY source_timestamp_us DESC, hostname NULLS FIRST, message, full_message, syslog_identifier, syslog_pid LIMIT 1000"
)
_TOKENS = r"list_filter(string_split_regex(lower({c}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_FULL_TOKENS = _TOKENS.format(c="full_message")
_DAY10_12 = f"source_timestamp_us >= {DAY10}000000 AND source_timestamp_us < {DAY12}000000"
_LAST_DAY = "source_timestamp_us >= epoch_us(TIMESTAMP '2024-01-30 00:00:00')"
_BOOL_SQL = (
    "(event_type = 'error' OR priority = 2) AND NOT coalesce(hostname = 'h1', false) AND NOT facility = 'cron'"
)
_N_CHUNKS = "CAST(greatest(2, least(128, (length(text) + 999) // 1000)) AS BIGINT)"
_DOC_US = "epoch_us(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id * 37))"
_BAD = ", ".join(
    f"({i}, {'NULL' if s is None else repr(s)}, {'NULL' if r is None else repr(r)})" for i, (s, r) in enumerate(X.BAD_REASONS)
)
_BAD_TABLE = f"(VALUES {_BAD}) b(k, stage, reason)"


def _search(source: str, where: str) -> str:
    return f"SELECT {_HIT} FROM (SELECT * FROM ({source}) WHERE {where} {_NEWEST})"


_LINE = (
    "'{\"source_timestamp\":' || source_timestamp_us || ',\"hostname\":' || "
    "CASE WHEN {host} IS NULL THEN 'null' ELSE '\"' || {host} || '\"' END || ',\"message\":\"' || message || "
    "'\",\"priority\":' || priority || ',\"full_message\":\"' || full_message || '\",\"facility\":\"' || facility || "
    "'\",\"syslog_identifier\":\"' || syslog_identifier || '\",\"syslog_pid\":' || syslog_pid || '}'"
)
_RESOLVED = f"""
SELECT l.* EXCLUDE (hostname), coalesce(l.hostname, s.s_name, '10.0.0.' || (l.user_id % 5)) AS hostname
FROM ({_EVENT_LOGS}) l LEFT JOIN supplier s ON s.s_suppkey = l.user_id % 5 AND s.s_suppkey <> 4
"""
_TIME_LABEL = (
    "strftime(make_timestamp({us}), '%Y-%m-%d %H:%M:%S') || CASE WHEN {us} % 1000000 = 0 THEN '' "
    "WHEN {us} % 1000 = 0 THEN '.' || lpad(CAST({us} % 1000000 // 1000 AS VARCHAR), 3, '0') "
    "ELSE '.' || lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0') END || ' UTC'"
)
_PRIORITY_LABEL = (
    "priority || ' (' || ['Emergency','Alert','Critical','Error','Warning','Notice','Informational','Debug'][priority + 1] || ')'"
)
_RANGE_HITS = f"SELECT * FROM ({_EVENT_LOGS}) WHERE {_DAY10_12} {_NEWEST}"


def _counts(fields: tuple[str, ...]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{f}' AS field, count({f + '_us' if f == 'source_timestamp' else f}) AS n_non_null FROM hits" for f in fields
    )
    return f"WITH hits AS ({_RANGE_HITS}) SELECT * FROM ({parts}) WHERE n_non_null > 0"


_SYSLOG_FIELDS = (
    "source_timestamp", "hostname", "message", "priority", "full_message", "facility", "syslog_identifier", "syslog_pid"
)
_LATE = f"SELECT doc_id, {_N_CHUNKS} AS size FROM documents"
_LATE_GROUPS = f"""
SELECT doc_id, 'complete' AS status, size, size AS present FROM ({_LATE}) WHERE doc_id % 5 NOT IN (0, 1)
UNION ALL SELECT doc_id, 'expired', size, size - 1 FROM ({_LATE}) WHERE doc_id % 5 IN (0, 1)
UNION ALL SELECT doc_id, 'expired', size, 1 FROM ({_LATE}) WHERE doc_id % 5 = 1
"""
_CUT = "(doc_id % 50 = 0 AND doc_id % 3 <> 2)"
_EXTRA = (
    "CASE WHEN doc_id % 5 = 0 THEN 'wrong' WHEN doc_id % 7 = 0 THEN 'past' WHEN doc_id % 11 = 0 THEN 'lone' END"
)

_OUTCOMES = f"""
            WITH rows AS (
              SELECT CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS VARCHAR) AS reason FROM events
              UNION ALL SELECT stage, reason FROM events JOIN {_BAD_TABLE} ON event_id % 12 = k
              UNION ALL SELECT CASE WHEN {_CUT} THEN 'inflate' END, CASE WHEN {_CUT} THEN ['bad_gzip','bad_zlib'][doc_id % 3 + 1] END FROM documents
              UNION ALL SELECT NULL, NULL FROM documents
              UNION ALL SELECT 'chunk', CASE {_EXTRA} WHEN 'past' THEN 'chunk_seqno' ELSE 'chunk_count' END FROM documents WHERE {_EXTRA} IN ('past', 'lone'))
            SELECT stage, reason, count(*) AS n FROM rows GROUP BY stage, reason"""
_PIECES = "(VALUES " + ", ".join(
    f"({k}, {ms}, {i}, {n}, '{mark}', {'NULL' if reason is None else repr(reason)})" for k, ms, i, n, mark, reason in X.REFUSED_PIECES
) + ") p(k, ms, i, n, mark, reason)"
# Without a host table, a record without a name has its sender's address.
_NAMED_LOGS = f"SELECT * REPLACE (coalesce(hostname, '10.0.0.' || (user_id % 5)) AS hostname) FROM ({_EVENT_LOGS})"


def oracle_sql() -> dict[str, str]:
    found = {
        "syslog_normalize": f"SELECT source_timestamp_us, hostname, message, priority, full_message, facility, syslog_identifier, syslog_pid FROM ({_EVENT_LOGS})",
        "syslog_pri_decode": f"""
            SELECT event_id,
              CASE WHEN p > 255 THEN 5 ELSE CAST(p % 8 AS INTEGER) END AS priority,
              CASE WHEN p > 255 THEN 'user' ELSE {_FACILITY.format(n='(p // 8)')} END AS facility,
              CASE WHEN p > 255 THEN '<' || p || '> n=' || event_id ELSE 'n=' || event_id END AS message
            FROM (SELECT event_id, event_id % 300 AS p FROM events)""",
        "syslog_quirks": """
            SELECT event_id,
              CAST([7,5,2,2,5,5,5,7,5,5,5,7][k + 1] AS INTEGER) AS priority,
              ['kern','user','auth','auth','user','user','user','local15','user','user','user','kern'][k + 1] AS facility,
              CASE WHEN k = 2 THEN epoch_us(ts) WHEN k IN (6, 9) THEN epoch_us(TIMESTAMP '2024-08-02 09:00:00')
                ELSE epoch_us(ts) + 2000000 END AS source_timestamp_us,
              ['register','hello',NULL,'1','Aug','Feb',NULL,'Aug',NULL,'h1',NULL,NULL][k + 1] AS hostname,
              CAST(NULL AS VARCHAR) AS identifier,
              CASE k WHEN 0 THEN 'callback' || event_id WHEN 1 THEN 'world ' || event_id
                WHEN 2 THEN ' mymachine.example.com su - ID' || event_id || ' - failed'
                WHEN 3 THEN '- host app - - - ' || event_id WHEN 4 THEN '2 09:00:00 host app: ' || event_id
                WHEN 5 THEN '30 09:00:00 host app: ' || event_id WHEN 6 THEN 'my-host sshd[' || event_id || ']: hi'
                WHEN 7 THEN '12 24:00:00 x: ' || event_id WHEN 8 THEN '<300>Aug  2 09:00:00 a b: ' || event_id
                WHEN 9 THEN 'a[99999999999999999999]: ' || event_id WHEN 10 THEN ''
                WHEN 11 THEN '[0]DAA FXO: ' || event_id END AS message
            FROM (SELECT event_id, ts, event_id % 12 AS k FROM events)""",
        "classify_packets": f"""
            WITH kinds AS (
              SELECT 'plain' AS kind, count(*) AS n FROM events
              UNION ALL SELECT ['gzip','zlib','plain'][doc_id % 3 + 1], count(*) FROM documents GROUP BY 1
              UNION ALL SELECT 'chunk', CAST(sum({_N_CHUNKS}) + count({_EXTRA}) AS BIGINT) FROM documents)
            SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM kinds GROUP BY kind""",
        "gelf_normalize": f"SELECT source_timestamp_us, hostname, message, priority, pid, cap_effective, systemd_unit, CAST(NULL AS VARCHAR) AS full_message, CAST(NULL AS VARCHAR) AS convert_reason FROM ({_GELF_LOGS})",
        "gelf_general_form": "SELECT event_id, '1.1' AS version, 'h' || (user_id % 5) AS host, event_type AS short_message, CAST(6 AS BIGINT) AS n_other, event_id AS x FROM events",
        "gelf_all_columns": "SELECT event_id, CAST(NULL AS VARCHAR) AS json_reason, CAST(NULL AS VARCHAR) AS convert_reason, "
        + ", ".join(_full_column(i, f) for i, f in enumerate(C.FIELDS)) + " FROM events",
        "gelf_inflate": f"SELECT doc_id AS pid, lang AS hostname, md5(text) AS text_md5, length(text) AS n FROM documents WHERE NOT {_CUT}",
        "gelf_inflate_errors": f"SELECT doc_id, ['bad_gzip','bad_zlib'][doc_id % 3 + 1] AS reason FROM documents WHERE {_CUT}",
        "gelf_chunks": f"""
            SELECT doc_id, n AS size, '10.0.2.' || (CASE WHEN doc_id % 2 = 1 THEN 0 ELSE (n - 1) % 4 END) AS src_ip,
              lang AS hostname, {_DOC_US} AS source_timestamp_us, {_DOC_US} + (n - 1) * 1000 + 500 AS recv_ts_us,
              md5(text) AS text_md5
            FROM (SELECT *, {_N_CHUNKS} AS n FROM documents)""",
        "gelf_chunks_hot": f"""
            WITH d AS (SELECT doc_id, md5(text) AS text_md5, {_N_CHUNKS} AS n, {_DOC_US} AS t FROM documents)
            SELECT 'complete' AS status, t AS opened_ts_us, n AS size, n AS present, '10.0.2.' || ((n - 1) % 4) AS src_ip,
              CAST(12201 AS BIGINT) AS src_port, t + (n - 1) * 1000 AS recv_ts_us, text_md5, CAST(NULL AS BIGINT) AS piece_port
            FROM d
            UNION ALL SELECT 'expired', t + (n - 1) * 1000, n, 1, NULL, NULL, NULL, NULL, 12202 FROM d WHERE doc_id % 3 = 0""",
        "gelf_chunks_nested": f"""
            SELECT doc_id, '10.0.2.{X.NESTED_LEVELS}' AS src_ip, {_DOC_US} + {X.NESTED_LEVELS * 1000} AS recv_ts_us, lang AS hostname,
              {_DOC_US} AS source_timestamp_us, md5(text) AS text_md5, CAST(NULL AS VARCHAR) AS reason
            FROM documents""",
        "quarantine_rows": f"""
            SELECT '10.0.2.' || (i % 4) AS src_ip, epoch_us(ts) + ms * 1000 AS recv_ts_us, 'chunk' AS stage, reason,
              md5('1E0F' || lpad(to_hex(event_id), 16, '0') || lpad(to_hex(i), 2, '0') || lpad(to_hex(n), 2, '0') || hex(mark || event_id)) AS payload_md5
            FROM events JOIN {_PIECES} ON event_id % 4 = k WHERE reason IS NOT NULL""",
        "gelf_chunks_expired": _LATE_GROUPS,
        "gelf_chunks_expired_only": f"SELECT size, count(*) AS n, CAST(sum(present) AS BIGINT) AS present FROM ({_LATE_GROUPS}) WHERE status = 'expired' GROUP BY size",
        "gelf_reject_reasons": f"""
            SELECT stage, reason, count(*) AS n, count(DISTINCT user_id % 5) AS n_sources, count(*) AS n_payloads
            FROM events JOIN {_BAD_TABLE} ON event_id % 12 = k WHERE reason IS NOT NULL GROUP BY stage, reason""",
        "valid_logs": f"SELECT source_timestamp_us, hostname, message, pid FROM ({_GELF_LOGS}) WHERE event_id % 12 = 11",
        "resolve_hostnames": f"SELECT syslog_pid, hostname FROM ({_RESOLVED})",
        "merge_logs": f"""
            SELECT source_timestamp_us, hostname, message, priority, pid AS any_pid FROM ({_GELF_LOGS})
            UNION ALL SELECT source_timestamp_us, hostname, message, priority, syslog_pid FROM ({_EVENT_LOGS})""",
        "ingest_outcomes": _OUTCOMES,
        "ingest_by_host": f"""
            WITH rows AS (
              SELECT hostname, source_timestamp_us, length(message) AS chars, 1 AS has_full FROM ({_RESOLVED})
              UNION ALL SELECT hostname, source_timestamp_us, length(message), 0 FROM ({_GELF_LOGS}) WHERE event_id % 12 = 11
              UNION ALL SELECT lang, {_DOC_US}, length('doc ' || doc_id), 1 FROM documents WHERE NOT {_CUT}
              UNION ALL SELECT lang, {_DOC_US}, length('doc ' || doc_id), 1 FROM documents)
            SELECT hostname, count(*) AS n, CAST(sum(source_timestamp_us % 1000000007) AS BIGINT) AS time_sum,
              CAST(sum(chars) AS BIGINT) AS message_chars, CAST(sum(has_full) AS BIGINT) AS n_full
            FROM rows GROUP BY hostname""",
        "stream_ingest_outcomes": _OUTCOMES,
        "log_table_search": f"SELECT {_HIT} FROM (SELECT * FROM ({_NAMED_LOGS}) WHERE event_type = 'error' AND {_LAST_DAY} {_NEWEST})",
        "newest_errors_wide": f"SELECT {_HIT} FROM (SELECT * FROM ({_NAMED_LOGS}) WHERE event_type = 'error' {_NEWEST})",
        "search_page": f"""
            WITH matches AS (SELECT * FROM ({_EVENT_LOGS}) WHERE {_BOOL_SQL} AND source_timestamp_us >= {DAY10}000000)
            SELECT {_HIT}, (SELECT count(*) FROM matches) AS num_hits,
              'source_timestamp,facility,full_message,hostname,message,priority,syslog_identifier,syslog_pid' AS columns
            FROM (SELECT * FROM matches {_NEWEST})""",
        "retention_drop": f"SELECT source_timestamp_us, syslog_pid FROM ({_EVENT_LOGS}) WHERE source_timestamp_us >= epoch_us(TIMESTAMP '2024-01-21 00:00:00')",
        "compact_day": f"""
            SELECT strftime(make_timestamp(source_timestamp_us), '%Y-%m-%d') AS day, count(*) AS n, CAST(1 AS BIGINT) AS n_files,
              CAST(sum(event_id) AS BIGINT) AS pid_sum, CAST(sum(source_timestamp_us % 1000000007) AS BIGINT) AS time_sum
            FROM ({_EVENT_LOGS}) GROUP BY day""",
        "newest_errors": _search(_EVENT_LOGS, f"event_type = 'error' AND {_LAST_DAY}"),
        "search_time_range": _search(_EVENT_LOGS, _DAY10_12),
        "search_relative": _search(_EVENT_LOGS, _LAST_DAY),
        "search_term": _search(_DOC_LOGS, f"list_contains({_FULL_TOKENS}, 'que')"),
        "search_phrase": _search(_DOC_LOGS, f"contains(' ' || array_to_string({_FULL_TOKENS}, ' ') || ' ', ' of the ')"),
        "search_field_eq": _search(_EVENT_LOGS, "hostname = 'h3' AND event_type = 'error'"),
        "search_field_range": _search(
            _EVENT_LOGS,
            "priority BETWEEN 2 AND 4 AND source_timestamp_us BETWEEN epoch_us(TIMESTAMP '2024-01-05') AND epoch_us(TIMESTAMP '2024-01-20 12:00:00')",
        ),
        "search_bool": _search(_EVENT_LOGS, _BOOL_SQL),
        "search_summary": f"SELECT count(*) AS num_hits, CAST(least(count(*), 1000) AS BIGINT) AS hits_returned FROM ({_EVENT_LOGS}) WHERE {_BOOL_SQL} AND source_timestamp_us >= {DAY10}000000",
        "token_lists": f"SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_TOKENS.format(c='text')} AS w FROM documents)",
        "discover_columns": _counts(_SYSLOG_FIELDS),
        "field_list": _counts(tuple(f for f in _SYSLOG_FIELDS if "message" not in f)),
        "display_rows": f"""
            SELECT {_TIME_LABEL.format(us='source_timestamp_us')} AS source_timestamp, hostname, message,
              {_PRIORITY_LABEL} AS priority, CAST(pid AS VARCHAR) AS pid,
              '0x' || lower(to_hex(cap_effective)) AS cap_effective, CAST(NULL AS VARCHAR) AS full_message
            FROM ({_GELF_LOGS})""",
        "select_view": f"""
            SELECT {_TIME_LABEL.format(us='source_timestamp_us')} AS source_timestamp, hostname, {_PRIORITY_LABEL} AS priority, message
            FROM (SELECT * FROM ({_EVENT_LOGS}) WHERE hostname = 'h2' {_NEWEST})""",
        "ndjson_roundtrip": f"SELECT source_timestamp_us, hostname, message, priority, pid, cap_effective, systemd_unit FROM ({_GELF_LOGS})",
        "ndjson_lines": f"SELECT {_LINE.replace('{host}', 'hostname')} AS value FROM ({_EVENT_LOGS})",
        "retention": f"SELECT source_timestamp_us, syslog_pid FROM ({_EVENT_LOGS}) WHERE source_timestamp_us >= epoch_us(TIMESTAMP '2024-01-21 00:00:00')",
        "batch_stats": f"""
            SELECT count(*) AS messages, count(*) AS records, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes_written,
              CAST(sum(strlen(line) + 1) // count(*) AS BIGINT) AS bytes_per_message
            FROM (SELECT {_LINE.replace('{host}', 'hostname')} AS line FROM ({_RESOLVED}))""",
    }
    if corpus is not None:
        found |= corpus.ORACLE_SQL
        if corpus_pipeline.ORACLE_SQL is not None:
            found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
