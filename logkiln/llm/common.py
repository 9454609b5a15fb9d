"""What several of the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts reach 100 KB and more, so a batch stays within some tens of MB.
BATCH_ROWS = 512
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches hold at most ``BATCH_ROWS`` rows in this session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, str(BATCH_ROWS))


def utf8(column: str = "text") -> Column:
    """The bytes of a text; a null text is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def lower_words(data: bytes) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII spaces (0x20 and 0x09 to 0x0D)."""
    return data.translate(_LOWER).split()


def crc_mod(n: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
