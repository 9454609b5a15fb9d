"""What kind of packet a GELF datagram is, and the JSON body it carries."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN, CHUNK, GZIP, ZLIB, ERROR = "plain", "chunk", "gzip", "zlib", "error"

# The first bytes that tell packets apart, and the chunk header length.
CHUNK_MAGIC = bytes([0x1E, 0x0F])
GZIP_MAGIC = bytes([0x1F, 0x8B])
ZLIB_MAGICS = [bytes([0x78, b]) for b in (0x01, 0x5E, 0x9C, 0xDA, 0x20, 0x7D, 0xBB, 0xF9)]
HEADER_BYTES = 12
#: The longest body that is taken, in bytes, and bytes of bodies after which a batch of them goes on.
MAX_BODY, BATCH_BYTES = 64 << 20, 4 << 20
#: Rows of an Arrow batch: Spark's 10,000 packets with their texts by key take some hundred MB in every Python worker.
BATCH_ROWS = 512


def byte_at(payload: Column, pos: int) -> Column:
    return F.conv(F.hex(F.substring(payload, pos, 1)), 16, 10).cast("int")


def classify_packets(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``kind``, ``packet_reason`` and, for chunks, ``chunk_id``, ``seqno``, ``count`` and ``content``."""
    data = F.col(payload)
    size = F.octet_length(data)
    magic = F.substring(data, 1, 2)
    chunked = magic == F.lit(CHUNK_MAGIC)
    reason = F.when(F.coalesce(size, F.lit(0)) < 2, "too_small").when(
        chunked & (size < HEADER_BYTES), "short_chunk"
    )
    kind = (
        F.when(reason.isNotNull(), ERROR)
        .when(chunked, CHUNK)
        .when(magic == F.lit(GZIP_MAGIC), GZIP)
        .when(magic.isin(*[F.lit(m) for m in ZLIB_MAGICS]), ZLIB)
        .otherwise(PLAIN)
    )
    header = chunked & (size >= HEADER_BYTES)
    return df.withColumns(
        {
            "kind": kind,
            "packet_reason": reason,
            "chunk_id": F.when(header, F.substring(data, 3, 8)),
            "seqno": F.when(header, byte_at(data, 11)),
            "count": F.when(header, byte_at(data, 12)),
            "content": F.when(header, F.substring(data, HEADER_BYTES + 1, 2**31 - 1)),
        }
    )


def open_body(kind: str, data: bytes | None, max_bytes: int = MAX_BODY) -> tuple[bytes | None, str | None]:
    """The body of one packet, or why it has none; errors and chunks have neither.

    A truncated or corrupt stream gives no body; what follows the first member is ignored. Decompression stops as soon as
    a body is longer than ``max_bytes``, which is refused as ``too_large``, whatever follows.
    """
    if kind == PLAIN:
        return data, None
    if kind not in (GZIP, ZLIB) or data is None:
        return None, None
    # 31: gzip wrapper, first member only; 15: zlib wrapper. Both check their checksum.
    stream = zlib.decompressobj(31 if kind == GZIP else 15)
    try:
        # One byte more than allowed tells a body of just that size from a longer one.
        out = stream.decompress(data, max_bytes + 1)
    except zlib.error:
        return None, f"bad_{kind}"
    if len(out) > max_bytes:
        return None, "too_large"
    return (out, None) if stream.eof else (None, f"bad_{kind}")


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows in this session, fewer if it says so itself."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = int(spark.conf.get(key))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_bodies(df: DataFrame, made: T.StructType, columns, payload: str, max_bytes: int) -> DataFrame:
    """``df`` and the columns ``made``, which ``columns`` (lists of bodies and reasons to arrays) makes of the opened packets.

    One step in Arrow batches; a batch goes out as soon as its bodies have ``BATCH_BYTES`` bytes, so a task holds one such
    batch and one body more.
    """
    kept = [c for c in df.columns if c not in made.names]
    at, kind_at = kept.index(payload), kept.index("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, size, bodies, reasons = 0, 0, [], []
            for i, kind in enumerate(b.column(kind_at).to_pylist()):
                body, reason = open_body(kind, b.column(at)[i].as_py(), max_bytes)
                bodies.append(body), reasons.append(reason)
                size += len(body or b"")
                if size >= BATCH_BYTES or i + 1 == b.num_rows:
                    part = b.slice(done, i + 1 - done)
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns(bodies, reasons)], [*kept, *made.names])
                    done, size, bodies, reasons = i + 1, 0, [], []

    return df.select(*kept).mapInArrow(run, T.StructType([*[df.schema[c] for c in kept], *made]))


_OPENED = T.StructType([T.StructField("body", T.BinaryType()), T.StructField("inflate_reason", T.StringType())])


def inflate(df: DataFrame, payload: str = "payload", max_bytes: int = MAX_BODY) -> DataFrame:
    """Add ``body``, the payload, decompressed where ``kind`` says so, and ``inflate_reason``, as ``open_body`` has them."""
    def columns(bodies: list, reasons: list) -> list[pa.Array]:
        return [pa.array(bodies, pa.binary()), pa.array(reasons, pa.string())]

    bound_batches(df.sparkSession)
    return map_bodies(df, _OPENED, columns, payload, max_bytes)
