"""Projections of decoded messages to the 62 log columns, with the reasons for refusal."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.functions.convert import convert


def conversion_errors() -> Column:
    """``column:key:reason`` of the first refused value, null if none.

    Every listed key counts, also one that a key before it would win over.
    """
    checks = ["type_reason"]
    for field in C.FIELDS:
        for source in field.gelf:
            _, reason = convert(f"gelf.`{source.key}`", field, source)
            if reason is not None:
                checks.append(f"'{field.name}:{source.key}:' || ({reason})")
    return F.expr(f"coalesce({', '.join(checks)})")


def gelf_column(field: C.Field) -> Column:
    """First present key of a column, converted."""
    values = [convert(f"gelf.`{s.key}`", field, s)[0] for s in field.gelf]
    return F.expr(f"CAST(coalesce({', '.join(values)}) AS {field.spark_type.simpleString()})").alias(field.name)


def _compiled_in_parts(spark: SparkSession) -> None:
    """Let Spark generate the conversions as many methods instead of one.

    All conversions of a record in one generated method are more than the Java compiler takes (8000 bytes), so
    they would be interpreted, at less than half the speed. A limit that the session sets itself is left as it is.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, "8000")


def normalize_gelf(df: DataFrame, keep: tuple[str, ...] = ("src_ip", "recv_ts")) -> DataFrame:
    """Decoded GELF rows to log columns, plus ``keep`` and ``convert_reason``."""
    _compiled_in_parts(df.sparkSession)
    return df.select(
        *keep, *[gelf_column(f) for f in C.FIELDS], conversion_errors().alias("convert_reason")
    )


def normalize_syslog(df: DataFrame, keep: tuple[str, ...] = ("src_ip", "recv_ts")) -> DataFrame:
    """Parsed syslog rows to log columns, plus ``keep`` and ``convert_reason``.

    Columns without a syslog source are null. A pid beyond a signed long, or a stamp before
    1970, is refused.
    """
    def column(field: C.Field) -> Column:
        if field.syslog is None:
            return F.expr(f"CAST(null AS {field.spark_type.simpleString()})").alias(field.name)
        return F.col(field.syslog).try_cast(field.spark_type).alias(field.name)

    reason = F.when(F.col("pid") > Decimal(2**63 - 1), "syslog_pid:pid:over_long").when(
        F.unix_micros("source_timestamp") < 0, "source_timestamp:source_timestamp:negative_time"
    )
    return df.select(*keep, *[column(f) for f in C.FIELDS], reason.alias("convert_reason"))


def is_valid_log() -> Column:
    """A record needs an instant after the epoch and a non-empty message."""
    return F.coalesce((F.unix_micros(C.TIME_FIELD) > 0) & (F.length("message") > 0), F.lit(False))


def valid_logs(df: DataFrame) -> DataFrame:
    return df.where(is_valid_log())


def invalid_reason() -> Column:
    """Why a normalised record is not a log record; null if it is one."""
    return (
        F.when(F.col(C.TIME_FIELD).isNull(), "no_time")
        .when(F.unix_micros(C.TIME_FIELD) <= 0, "bad_time")
        .when(F.coalesce(F.length("message"), F.lit(0)) == 0, "no_message")
    )
