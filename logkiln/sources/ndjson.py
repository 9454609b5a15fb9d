"""Log records as lines of JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logkiln import catalog as C


def json_line() -> Column:
    """One JSON object: instants as whole microseconds, nulls left out but for the columns always written."""
    def value(f: C.Field) -> Column:
        return (F.unix_micros(f.name) if f.storage in C.TIME_STORAGE else F.col(f.name)).alias(f.name)

    always = F.to_json(F.struct(*[value(f) for f in C.FIELDS if f.written_when_null]), {"ignoreNullFields": "false"})
    others = F.to_json(F.struct(*[value(f) for f in C.FIELDS if not f.written_when_null]))
    head = F.substr(always, F.lit(1), F.length(always) - 1)
    return F.when(others == "{}", always).otherwise(F.concat(head, F.lit(","), F.substr(others, F.lit(2))))


def to_ndjson(df: DataFrame) -> DataFrame:
    return df.select(json_line().alias("value"))


def write_ndjson(df: DataFrame, path: str) -> None:
    to_ndjson(df).write.mode("append").text(path)


def _stored_schema() -> T.StructType:
    def kind(f: C.Field) -> T.DataType:
        return T.LongType() if f.storage in C.TIME_STORAGE else f.spark_type

    return T.StructType([T.StructField(f.name, kind(f)) for f in C.FIELDS])


def _typed(f: C.Field) -> Column:
    return (F.timestamp_micros(f.name) if f.storage in C.TIME_STORAGE else F.col(f.name)).alias(f.name)


def read_ndjson(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_stored_schema()).json(path).select(*[_typed(f) for f in C.FIELDS])


def from_ndjson(lines: DataFrame, column: str = "value") -> DataFrame:
    """Records from a column of such lines."""
    return lines.select(F.from_json(column, _stored_schema()).alias("r")).select("r.*").select(
        *[_typed(f) for f in C.FIELDS]
    )
