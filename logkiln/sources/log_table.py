"""Day-partitioned log tables: writing, creating, reading and expiry."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.operators.search import event_date

LOG, QUARANTINE = "log", "quarantine"


def laid_out(df: DataFrame, *days: str) -> DataFrame:
    """Few files per day, large days split over tasks, each file in time order.

    A rebalance lets the optimiser merge small days and split large ones; sorted files give
    row groups with narrow time bounds for a search to skip. Spark leaves the rebalance out where adaptive execution is off
    (as in a stream, unless its batch turns it on): then every task writes a file for every day.
    """
    return df.hint("rebalance", *days).sortWithinPartitions(*days, C.TIME_FIELD)


def bloom_filters() -> dict[str, str]:
    """Writer options that give the exact-match columns Parquet bloom filters, sized to what a row group holds.

    Parquet leaves them out where a dictionary holds all values, which tells as much. It chooses among sizes of which each is half of
    the one before: by default five, the least of 64 KB for each column of a file of ten rows; sixteen go down to the 32 bytes of the smallest filter.
    """
    exact = [f.name for f in C.FIELDS if f.storage == C.STRING]
    each = {f"parquet.bloom.filter.{key}#{name}": value for name in exact for key, value in (("enabled", "true"), ("candidates.number", "16"))}
    return {"parquet.bloom.filter.adaptive.enabled": "true", **each}


def write_logs(df: DataFrame, path: str) -> None:
    """Append records to a table partitioned by their UTC day."""
    dated = df.select(*C.FIELD_NAMES, event_date().alias(C.DATE_FIELD))
    laid_out(dated, C.DATE_FIELD).write.mode("append").options(**bloom_filters()).partitionBy(C.DATE_FIELD).parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(C.log_schema().add(C.DATE_FIELD, "date")).parquet(path)


def write_ingested(df: DataFrame, path: str, run: str) -> None:
    """Write records and refused rows in one pass, apart by ``outcome``.

    The partitions of a run are replaced, not added to, so a run that is repeated after a
    failure leaves no second copy; other runs' partitions are not touched.
    """
    columns = [c for c in df.columns if c not in ("outcome", "run")]
    # Refused rows have their own day column, the day they came in.
    marked = df.select(
        *columns,
        F.when(F.col("reason").isNull(), LOG).otherwise(QUARANTINE).alias("outcome"),
        F.lit(run).alias("run"),
    )
    (
        laid_out(marked, "outcome", C.DATE_FIELD)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**bloom_filters())
        .partitionBy("outcome", C.DATE_FIELD, "run")
        .parquet(path)
    )


def _outcome(spark: SparkSession, path: str, outcome: str) -> DataFrame:
    schema = C.log_schema()
    for name, kind in (("src_ip", "string"), ("recv_ts", "timestamp"), ("payload", "binary"), ("stage", "string"), ("reason", "string"), ("outcome", "string"), (C.DATE_FIELD, "date"), ("run", "string")):
        schema = schema.add(name, kind)
    # With the schema given, an outcome that never came up is an empty table.
    return spark.read.schema(schema).parquet(path).where(F.col("outcome") == outcome)


def read_ingested_logs(spark: SparkSession, path: str) -> DataFrame:
    return _outcome(spark, path, LOG).select(*C.FIELD_NAMES, C.DATE_FIELD)


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return _outcome(spark, path, QUARANTINE).select(*C.QUARANTINE_COLUMNS)


def ensure_log_table(spark: SparkSession, name: str, location: str | None = None) -> None:
    """Create a catalog table for records unless it exists; an existing one is left as it is."""
    columns = ", ".join(f"`{f.name}` {f.spark_type.simpleString()}" for f in C.FIELDS)
    where = f" LOCATION '{location}'" if location else ""
    fields = ",".join(C.DEFAULT_SEARCH_FIELDS)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, `{C.DATE_FIELD}` date) USING parquet "
        f"PARTITIONED BY ({C.DATE_FIELD}){where} TBLPROPERTIES ("
        f"'log.retention.days'='{C.RETENTION_DAYS}', 'log.default.search.fields'='{fields}', "
        f"'log.timestamp.field'='{C.TIME_FIELD}')"
    )


def append_to_table(df: DataFrame, name: str) -> None:
    dated = df.select(*C.FIELD_NAMES, event_date().alias(C.DATE_FIELD))
    laid_out(dated, C.DATE_FIELD).write.insertInto(name)


def first_kept_day(now: datetime, days: int = C.RETENTION_DAYS) -> date:
    moment = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc).date() - timedelta(days=days)


def apply_retention(df: DataFrame, now: datetime, days: int = C.RETENTION_DAYS) -> DataFrame:
    """Records of the last ``days`` days; on a table this prunes whole partitions."""
    day = F.col(C.DATE_FIELD) if C.DATE_FIELD in df.columns else event_date()
    return df.where(day >= F.lit(first_kept_day(now, days)))


def table_retention(spark: SparkSession, name: str) -> int:
    """How many days a table itself says that records are kept."""
    found = {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {name}").collect()}
    return int(found.get("log.retention.days", C.RETENTION_DAYS))


def drop_expired_partitions(spark: SparkSession, name: str, now: datetime, days: int | None = None) -> list[str]:
    """Drop the day partitions before the first kept day, by default that of the table's own property; gives the days dropped."""
    first = first_kept_day(now, table_retention(spark, name) if days is None else days)
    listed = [r[0] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    found = sorted({p.split("=", 1)[1] for p in listed if p.startswith(f"{C.DATE_FIELD}=")})
    expired = [d for d in found if d != "__HIVE_DEFAULT_PARTITION__" and date.fromisoformat(d) < first]
    for day in expired:
        spark.sql(f"ALTER TABLE {name} DROP IF EXISTS PARTITION ({C.DATE_FIELD}='{day}')")
    return expired
