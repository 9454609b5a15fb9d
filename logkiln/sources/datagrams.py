"""Raw datagrams as tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from logkiln import catalog as C


def read_datagrams(spark: SparkSession, path: str) -> DataFrame:
    """A datagram table; partitioned by ``proto``, each branch of a job reads only its own half."""
    return spark.read.schema(C.DATAGRAM).parquet(path).select(*C.DATAGRAM.fieldNames())


def write_datagrams(df: DataFrame, path: str) -> None:
    df.select(*C.DATAGRAM.fieldNames()).write.mode("append").partitionBy("proto").parquet(path)


def stream_datagrams(spark: SparkSession, path: str, max_files: int = 100, max_bytes: int | None = None) -> DataFrame:
    """The same as a stream; ``max_files`` bounds what one micro-batch takes in, or ``max_bytes`` the bytes of its files.

    A file is never split over micro-batches: one that is larger than ``max_bytes`` makes one by itself.
    """
    limit = {"maxFilesPerTrigger": max_files} if max_bytes is None else {"maxBytesPerTrigger": max_bytes}
    return spark.readStream.schema(C.DATAGRAM).options(**limit).parquet(path).select(*C.DATAGRAM.fieldNames())
