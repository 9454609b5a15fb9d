"""Continuous ingest: datagram stream to log and quarantine tables."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logkiln.operators.enrich import HostTable
from logkiln.operators.packets import classify_packets
from logkiln.plans.ingest import _packets, _stats, chunk_rows, decode_packets, group_packets, whole_packets
from logkiln.sources.datagrams import stream_datagrams
from logkiln.sources.ingest_table import commit_run, forget_runs
from logkiln.sources.log_table import write_ingested
from logkiln.streaming.chunks import reassemble_chunks_stream, with_clock


def stream_packets(datagrams: DataFrame, delay: str = "1 second", **options) -> DataFrame:
    """Both inputs merged, chunked messages joined.

    All GELF traffic moves the clock that open groups expire by, not chunks alone; nothing is too late.
    """
    raw = datagrams.where(F.col("proto") == "gelf")
    gelf = classify_packets(raw)
    chunks = chunk_rows(with_clock(gelf, delay, ("kind", "count")), "clock")
    joined = group_packets(reassemble_chunks_stream(chunks, delay=None, **options))
    syslog = _packets(datagrams.where(F.col("proto") == "syslog"))
    return whole_packets(gelf).unionByName(joined).unionByName(syslog)


#: Figures that are observed of an empty batch must stay in its plan.
_ADAPTIVE = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.optimizer.excludedRules": "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"}


@contextmanager
def _adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution for what is written of a micro-batch, so that files are few; the state before it keeps its fixed partitions."""
    before = {key: spark.conf.get(key, None) for key in _ADAPTIVE}
    for key, value in _ADAPTIVE.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def start_ingest(
    spark: SparkSession,
    src: str,
    dst: str | None,
    checkpoint: str,
    hosts: DataFrame | HostTable | None = None,
    zone: str = "UTC",
    interval: str | None = "10 seconds",
    max_files: int = 100,
    max_bytes: int | None = None,
    on_stats: Callable[[int, dict], None] | None = None,
    table: str | None = None,
    **options,
) -> StreamingQuery:
    """Start the stream; ``interval`` None takes in what is there and stops.

    Every micro-batch is decoded once and written once, records and refused rows together; a
    bad row never stops the stream, and a batch that is replayed replaces what it wrote.
    A micro-batch takes in ``max_files``, or what fits ``max_bytes`` if that is given. A ``HostTable`` with a version is read
    again when that changes. ``on_stats`` gets the size figures of each batch, observed while it is written. Rows go to the folder ``dst``,
    or to the catalog table ``table``, made by ``ensure_ingest_table``.
    """
    # Read once, not in every micro-batch.
    hosts = HostTable(hosts) if isinstance(hosts, DataFrame) else hosts
    # The id of the query is kept in its checkpoint: streams with other checkpoints write beside this one.
    query_id: list[str] = []
    started = threading.Event()

    def write(batch: DataFrame, batch_id: int) -> None:
        # Both decoders read the batch: kept, so that the chunk state is not worked through twice, and made first, as else
        # the tasks of one would hold cores to wait for those of the other.
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            batch.count()
            decoded = decode_packets(batch, hosts, zone)
            seen = Observation(f"batch-{batch_id}")
            if on_stats is not None:
                decoded = decoded.observe(seen, *_stats())
            started.wait()
            run = f"{query_id[0]}-{batch_id}"
            with _adaptive(batch.sparkSession):
                if table is None:
                    write_ingested(decoded, dst, run)
                else:
                    commit_run(decoded, table, run)
            if table is not None:
                # Only the last batch of a stream is ever repeated.
                forget_runs(spark, table, [f"{query_id[0]}-{batch_id - 1}"])
        finally:
            batch.unpersist()
        if on_stats is not None:
            on_stats(batch_id, seen.get)

    packets = stream_packets(stream_datagrams(spark, src, max_files, max_bytes), **options)
    writer = packets.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    query = writer.trigger(**trigger).start()
    query_id.append(str(query.id))
    started.set()
    return query
