"""One table for ingest, search, expiry and compaction."""

import datetime as dt
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.functions import text as P
from logkiln.operators import search as S
from logkiln.plans.ingest import decode_datagrams, ingest_into_table
from logkiln.sources import ingest_table as T
from logkiln.sources.datagrams import read_datagrams
from logkiln.streaming.ingest import start_ingest
from test_chunks import T0
from test_stream import FILES, both, plain

DAY = 86400


@pytest.fixture()
def table(spark):
    name = f"ingest_{uuid.uuid4().hex}"
    T.ensure_ingest_table(spark, name, tempfile.mkdtemp(prefix="run-table-") + "/t")
    yield name
    spark.sql(f"DROP TABLE {name}")


def datagrams(spark, rows):
    return spark.createDataFrame(rows, C.DATAGRAM)


def line(day, text, second=0):
    at = T0 + dt.timedelta(days=day, seconds=second)
    return ("syslog", "10.0.0.1", 1, at, bytearray(f"<13>{at:%b} {at.day:2d} {at:%H:%M:%S} h app: {text}".encode()))


def texts(spark, table):
    return sorted(r.message for r in T.records(spark, table).collect())


def folders(spark, table):
    return {r.f.rsplit("/", 1)[0] for r in spark.table(table).select(F.col("_metadata.file_path").alias("f")).distinct().collect()}


def test_a_run_is_there_once(spark, table):
    rows = datagrams(spark, [line(0, "a"), line(1, "b"), ("gelf", "10.0.0.1", 1, T0, bytearray(b""))])
    assert ingest_into_table(rows, table, run="one")
    assert not ingest_into_table(rows, table, run="one")
    assert texts(spark, table) == ["a", "b"] and T.refused(spark, table).count() == 1
    assert ingest_into_table(rows, table, run="two")
    assert texts(spark, table) == ["a", "a", "b", "b"]
    assert len(folders(spark, table)) == 3
    with pytest.raises(ValueError):
        ingest_into_table(rows, table, run="../x")


def test_an_interrupted_run_leaves_one_copy(spark, table):
    rows = datagrams(spark, [line(0, "a"), line(1, "b")])
    other = datagrams(spark, [line(0, "other"), line(1, "other")])
    ingest_into_table(other, table, run="other")
    ingest_into_table(rows, table, run="one")
    # As if the job had ended between its write and its mark, also with a folder that the catalog has not heard of.
    T._delete(spark, T._marks(spark, table, "one")[1])
    spark.sql(f"ALTER TABLE {table} DROP {T._spec('log', str((T0 + dt.timedelta(days=1)).date()))}")
    assert ingest_into_table(rows, table, run="one")
    assert texts(spark, table) == ["a", "b", "other", "other"]


def test_packed_days_and_late_rows(spark, table):
    for k in range(4):
        ingest_into_table(datagrams(spark, [line(0, f"m{k}", k), line(2, f"n{k}", k)]), table, run=f"r{k}")
    found = T.compact_finished_days(spark, table, T0 + dt.timedelta(days=2))
    assert found == {("log", str(T0.date())): (4, 1)}
    assert texts(spark, table) == [f"{c}{k}" for c in "mn" for k in range(4)]
    ingest_into_table(datagrams(spark, [line(0, "late")]), table, run="late")
    assert T.compact_day(spark, table, "log", str(T0.date())) == (2, 1)
    assert texts(spark, table) == ["late"] + [f"{c}{k}" for c in "mn" for k in range(4)]
    # Small files by a small size: several, each with its own span of time.
    ingest_into_table(datagrams(spark, [line(0, f"x{k}", 100 + k) for k in range(50)]), table, run="many")
    size = sum(T._sizes(spark, T._described(spark, table, T._spec("log", str(T0.date())))).values())
    assert T.compact_day(spark, table, "log", str(T0.date()), size) == (2, 1)
    ingest_into_table(datagrams(spark, [line(0, f"y{k}", 200 + k) for k in range(50)]), table, run="more")
    ingest_into_table(datagrams(spark, [line(0, f"z{k}", 300 + k) for k in range(50)]), table, run="most")
    T.compact_day(spark, table, "log", str(T0.date()), size)
    spans = spark.table(table).where(f"event_date = '{T0.date()}'").groupBy("_metadata.file_path").agg(F.min("source_timestamp").alias("a"), F.max("source_timestamp").alias("z"))
    spans = sorted((r.a, r.z) for r in spans.collect())
    assert len(spans) >= 2 and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))


def test_files_that_come_in_while_a_day_is_packed_are_kept(spark, table, monkeypatch):
    for k in range(2):
        ingest_into_table(datagrams(spark, [line(0, f"m{k}")]), table, run=f"r{k}")
    real, calls = T._sizes, []

    def sizes(s, folder):
        out = real(s, folder)
        if not calls:
            calls.append(folder)
            ingest_into_table(datagrams(spark, [line(0, "between")]), table, run="between")
        return out

    monkeypatch.setattr(T, "_sizes", sizes)
    T.compact_day(spark, table, "log", str(T0.date()))
    assert texts(spark, table) == ["between", "m0", "m1"]


def test_expiry_reads_the_tables_own_days(spark):
    name = f"ingest_{uuid.uuid4().hex}"
    T.ensure_ingest_table(spark, name, tempfile.mkdtemp(prefix="run-table-") + "/t", retention_days=2)
    rows = [line(0, "a"), line(1, "b"), line(3, "c"), ("gelf", "10.0.0.1", 1, T0, bytearray(b""))]
    ingest_into_table(datagrams(spark, rows), name, run="one")
    gone = T._described(spark, name, T._spec("log", str(T0.date())))
    assert T.drop_expired(spark, name, T0 + dt.timedelta(days=3)) == [("log", str(T0.date())), ("quarantine", str(T0.date()))]
    assert texts(spark, name) == ["b", "c"] and not T._exists(spark, gone)
    spark.sql(f"DROP TABLE {name}")


def test_stream_into_the_table_and_search(spark, table):
    folder = tempfile.mkdtemp(prefix="run-stream-")
    for rows in [*FILES, [plain(b"last", 2 * DAY)]]:
        spark.createDataFrame(rows, C.DATAGRAM).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    for _ in range(2):  # the second start finds nothing new
        query = start_ingest(spark, f"{folder}/in", None, f"{folder}/checkpoint", interval=None, max_files=1, table=table)
        query.awaitTermination(240)
        assert query.exception() is None
    data = read_datagrams(spark, f"{folder}/in")
    decoded = decode_datagrams(data)
    batch = decoded.where("reason is null"), decoded.where("reason is not null")
    assert both(T.records(spark, table), T.refused(spark, table)) == both(*batch)
    assert len(folders(spark, table)) == decoded.select("event_date", F.col("reason").isNull()).distinct().count()
    marks = T._path(spark, f"{T._described(spark, table)}/_runs")
    assert len(marks[0].listStatus(marks[1])) <= 2
    hits = S.search(T.records(spark, table), P.term("last"))
    assert [r.message for r in hits.collect()] == ["last"]


def test_newest_search_reads_no_more_days_than_it_takes(spark, table):
    for day in range(9):
        ingest_into_table(datagrams(spark, [line(day, f"d{day}-{k} {'odd' if k % 2 else 'even'}", k) for k in range(10)]), table, run=f"r{day}")
    # A file that is no table ends any job that reads it: the six oldest days.
    for day in range(6):
        for f in T._sizes(spark, T._described(spark, table, T._spec("log", str((T0 + dt.timedelta(days=day)).date())))):
            with open(f.removeprefix("file:"), "wb") as broken:
                broken.write(b"not a table" * 50)
            T._delete(spark, f[: f.rindex("/") + 1] + "." + f[f.rindex("/") + 1 :] + ".crc")
    got = T.search_newest(spark, table, P.term("odd"), max_hits=12)
    want = [f"d{day}-{k} odd" for day in (8, 7, 6) for k in (9, 7, 5, 3, 1)][:12]
    assert [r.message for r in got.collect()] == want
    assert T.search_newest(spark, table, P.term("odd"), start=int(T0.timestamp()) + 8 * DAY, max_hits=3).count() == 3
    with pytest.raises(Exception):
        T.search_newest(spark, table, P.term("odd"), max_hits=16).collect()


def test_newest_search_of_few_or_no_records(spark, table):
    assert T.search_newest(spark, table).collect() == []
    ingest_into_table(datagrams(spark, [line(0, "a"), line(5, "b")]), table, run="one")
    assert [r.message for r in T.search_newest(spark, table).collect()] == ["b", "a"]


def test_stream_reads_hosts_once_and_takes_in_bytes(spark):
    from logkiln.operators.enrich import HostTable

    folder = tempfile.mkdtemp(prefix="run-stream-")
    big = [line(0, "x" * 2000 + str(k), k) for k in range(400)]
    for k, rows in enumerate([[line(0, "a")], [line(0, "b")], big, [line(0, "c")], [line(0, "d")]]):
        spark.createDataFrame([(*r[:1], "10.0.0.1", *r[2:4], bytearray(bytes(r[4]).replace(b" h app:", b" app:"))) for r in rows], C.DATAGRAM).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    reads, version = [], [1]

    def hosts():
        reads.append(version[0])
        return spark.createDataFrame([("10.0.0.1", f"v{version[0]}")], "ip string, name string")

    table = HostTable(hosts, lambda: version[0])
    batches = []
    query = start_ingest(
        spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", table, interval=None, max_bytes=10_000,
        on_stats=lambda i, s: batches.append(s["messages"]),
    )
    query.awaitTermination(240)
    assert query.exception() is None and reads == [1]
    assert sum(batches) == 404 and 400 in batches and len(batches) >= 3
    version[0] = 2
    assert table.names()[0].first()._name == "v2" and reads == [1, 2]
