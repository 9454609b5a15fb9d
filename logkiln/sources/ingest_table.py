"""One catalog table that ingest writes, searches read, and expiry and compaction maintain.

Records and refused rows share the table, apart by the partition column ``outcome``, so that a batch is decoded and written once.
The other partition column is the UTC day. A batch appends to the folders of its days: their number grows with the
days and not with the batches.

* **Commits.** Each batch has a name, its run. A mark is set before it is written and another after. A run with both marks is not written
  again. A run with the first one only was interrupted: what it left (each file holds rows of one run) is deleted
  before it is written anew. So a repeated run leaves one copy, without a folder of its own.
* **Compaction.** The small files of a day are packed into few of a given size, each of its own span of time, in a
  folder of their own; then the partition is pointed there in the catalog. Files that came in between are appended again.
* **Expiry.** Days past the table's own ``log.retention.days`` are dropped with their files.
"""

from __future__ import annotations

import re
import uuid
from datetime import date, datetime

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.operators.search import MAX_HITS, newest_by_day
from logkiln.sources.log_table import LOG, QUARANTINE, bloom_filters, first_kept_day, laid_out, table_retention

#: Columns beside those of a record: what a refused row is known by, and the run that wrote a row.
_MORE = {"src_ip": "string", "recv_ts": "timestamp", "payload": "binary", "stage": "string", "reason": "string", "run": "string"}
#: Size that compaction aims at.
FILE_BYTES = 128 << 20


def ensure_ingest_table(spark: SparkSession, name: str, location: str | None = None, retention_days: int = C.RETENTION_DAYS) -> None:
    """Create the table unless it exists; an existing one is left as it is."""
    columns = ", ".join([f"`{f.name}` {f.spark_type.simpleString()}" for f in C.FIELDS] + [f"{n} {t}" for n, t in _MORE.items()])
    where = f" LOCATION '{location}'" if location else ""
    fields = ",".join(C.DEFAULT_SEARCH_FIELDS)
    blooms = ", ".join(f"'{k}'='{v}'" for k, v in bloom_filters().items())
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, outcome string, `{C.DATE_FIELD}` date) USING parquet OPTIONS ({blooms}) "
        f"PARTITIONED BY (outcome, {C.DATE_FIELD}){where} TBLPROPERTIES ("
        f"'log.retention.days'='{int(retention_days)}', 'log.default.search.fields'='{fields}', 'log.timestamp.field'='{C.TIME_FIELD}')"
    )


def records(spark: SparkSession, name: str) -> DataFrame:
    """Accepted records, for searches; only their partitions are read."""
    return spark.table(name).where(F.col("outcome") == LOG).select(*C.FIELD_NAMES, C.DATE_FIELD)


def record_days(spark: SparkSession, name: str) -> list[date]:
    """The days that have records, from the catalog alone."""
    return [date.fromisoformat(day) for outcome, day in partitions(spark, name) if outcome == LOG and day != "__HIVE_DEFAULT_PARTITION__"]


def search_newest(spark: SparkSession, name: str, predicate: Column | None = None, start=None, end=None, max_hits: int = MAX_HITS) -> DataFrame:
    """The newest hits in the table; days before those that give enough of them are not read."""
    return newest_by_day(records(spark, name), record_days(spark, name), predicate, start, end, max_hits)


def refused(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name).where(F.col("outcome") == QUARANTINE).select(*C.QUARANTINE_COLUMNS)


# --- files --------------------------------------------------------------------------------


def _path(spark: SparkSession, text: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path, and the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _exists(spark: SparkSession, text: str) -> bool:
    fs, path = _path(spark, text)
    return fs.exists(path)


def _delete(spark: SparkSession, text: str) -> None:
    fs, path = _path(spark, text)
    fs.delete(path, True)


def _sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """The data files of one partition with their sizes."""
    fs, path = _path(spark, folder)
    if not fs.exists(path):
        return {}
    listed = [s for s in fs.listStatus(path) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    return {s.getPath().toString(): s.getLen() for s in listed}


def _described(spark: SparkSession, name: str, part: str = "") -> str:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name} {part}").collect()
    return next(r.data_type for r in rows if r.col_name == "Location")


def _spec(outcome: str, day: str) -> str:
    return f"PARTITION (outcome='{outcome}', {C.DATE_FIELD}='{day}')"


def partitions(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """(outcome, day) of each partition; one row each, so some hundred."""
    listed = [dict(p.split("=", 1) for p in r[0].split("/")) for r in spark.sql(f"SHOW PARTITIONS {name}").collect()]
    return sorted((p["outcome"], p[C.DATE_FIELD]) for p in listed)


# --- commits ------------------------------------------------------------------------------


def _marks(spark: SparkSession, name: str, run: str) -> tuple[str, str]:
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"a run is named by letters, digits, points and dashes: {run!r}")
    folder = f"{_described(spark, name)}/_runs/{run}"
    return f"{folder}.begun", f"{folder}.done"


def _remove_run(spark: SparkSession, name: str, run: str) -> None:
    """Delete the files of an interrupted run. Other files are passed over by the bounds of their run column."""
    # The interrupted run may have made folders that the catalog has not heard of.
    spark.sql(f"MSCK REPAIR TABLE {name}")
    spark.catalog.refreshTable(name)
    left = spark.table(name).where(F.col("run") == run).select("_metadata.file_path").distinct().collect()
    for row in left:
        _delete(spark, row.file_path)
    spark.catalog.refreshTable(name)


def commit_run(decoded: DataFrame, name: str, run: str) -> bool:
    """Append decoded rows to the table under the name of a run; False if that run is there already."""
    spark = decoded.sparkSession
    begun, done = _marks(spark, name, run)
    if _exists(spark, done):
        return False
    if _exists(spark, begun):
        _remove_run(spark, name, run)
    else:
        fs, path = _path(spark, begun)
        fs.create(path, True).close()
    found = F.when(F.col("reason").isNull(), LOG).otherwise(QUARANTINE)
    rows = decoded.select(*C.FIELD_NAMES, *[c for c in _MORE if c != "run"], F.lit(run).alias("run"), found.alias("outcome"), C.DATE_FIELD)
    laid_out(rows, "outcome", C.DATE_FIELD).write.insertInto(name)
    fs, path = _path(spark, done)
    fs.create(path, True).close()
    return True


def forget_runs(spark: SparkSession, name: str, runs: list[str]) -> None:
    """Remove the marks of runs that can no longer be repeated."""
    for run in runs:
        for mark in _marks(spark, name, run):
            _delete(spark, mark)


# --- maintenance --------------------------------------------------------------------------


def drop_expired(spark: SparkSession, name: str, now: datetime) -> list[tuple[str, str]]:
    """Drop the partitions before the first day that the table keeps, with their files; gives what was dropped."""
    first = first_kept_day(now, table_retention(spark, name))
    dropped = []
    for outcome, day in partitions(spark, name):
        if day != "__HIVE_DEFAULT_PARTITION__" and date.fromisoformat(day) < first:
            folder = _described(spark, name, _spec(outcome, day))
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {_spec(outcome, day)}")
            # The catalog does not delete the files of a table with a location of its own, nor packed folders.
            _delete(spark, folder)
            dropped.append((outcome, day))
    return dropped


def compact_day(spark: SparkSession, name: str, outcome: str, day: str, file_bytes: int = FILE_BYTES) -> tuple[int, int]:
    """Pack the files of one partition; gives their number before and after.

    Nothing is done where there are no more files than their size asks for. Searches see the old
    files or the new ones, never both. Run it where no batch is being written, as between two micro-batches.
    """
    folder = _described(spark, name, _spec(outcome, day))
    before = _sizes(spark, folder)
    wanted = max(1, -(-sum(before.values()) // file_bytes))
    if len(before) <= wanted:
        return len(before), len(before)
    schema = spark.table(name).drop("outcome", C.DATE_FIELD).schema
    rows, time = spark.read.schema(schema).parquet(*before), C.TIME_FIELD if outcome == LOG else "recv_ts"
    # One span of time a file, so that a search passes over most files of a day by their bounds.
    dealt = rows.coalesce(1) if wanted == 1 else rows.repartitionByRange(wanted, time)
    packed = f"{_described(spark, name)}/_packed/{uuid.uuid4().hex}/outcome={outcome}/{C.DATE_FIELD}={day}"
    dealt.sortWithinPartitions(time).write.options(**bloom_filters()).parquet(packed)
    spark.sql(f"ALTER TABLE {name} {_spec(outcome, day)} SET LOCATION '{packed}'")
    spark.catalog.refreshTable(name)
    late = [f for f in _sizes(spark, folder) if f not in before]
    if late:
        same_day = [F.lit(outcome).alias("outcome"), F.lit(date.fromisoformat(day)).alias(C.DATE_FIELD)]
        spark.read.schema(schema).parquet(*late).select("*", *same_day).write.insertInto(name)
    _delete(spark, folder)
    return len(before), len(_sizes(spark, packed))


def compact_finished_days(spark: SparkSession, name: str, now: datetime, open_days: int = 1, file_bytes: int = FILE_BYTES) -> dict[tuple[str, str], tuple[int, int]]:
    """Pack every day but the last ``open_days``, whose batches still come in."""
    last = event_date_of(now)
    finished = [p for p in partitions(spark, name) if p[1] != "__HIVE_DEFAULT_PARTITION__" and (last - date.fromisoformat(p[1])).days >= open_days]
    return {p: compact_day(spark, name, *p, file_bytes) for p in finished}


def event_date_of(now: datetime) -> date:
    return first_kept_day(now, 0)

