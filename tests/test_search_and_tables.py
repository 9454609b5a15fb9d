import datetime as dt
import json
import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.functions import text as P
from logkiln.functions.display import hex_label, priority_label, time_label
from logkiln.operators import search as S
from logkiln.operators.enrich import resolve_hostnames
from logkiln.sources import log_table as L
from logkiln.sources.ndjson import from_ndjson, read_ndjson, to_ndjson, write_ndjson

UTC = dt.timezone.utc
NOW = dt.datetime(2026, 4, 10, 12, tzinfo=UTC)


def logs(spark, rows):
    filled = [tuple(r.get(n) for n in C.FIELD_NAMES) for r in rows]
    return spark.createDataFrame(filled, C.log_schema())


def record(message, at, **more):
    return {"message": message, "source_timestamp": at, "hostname": "h", **more}


TEXTS = ["Error in my-host", "errors only", "no ERROR", "10.0.0.1 was, of the list", "of\nthe", "ofthe", "Élan vital", None, "a_b c"]


def plain_tokens(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def test_terms_and_phrases_like_token_lists(spark):
    df = logs(spark, [record(t, NOW, pid=i) for i, t in enumerate(TEXTS)])
    for words in ["error", "ERROR", "host", "of the", "élan", "10", "b c", "my-host", "of", "", "..."]:
        want = plain_tokens(words)
        got = {r.pid for r in df.where(P.phrase(words)).select("pid").collect()}
        hit = {
            i for i, t in enumerate(TEXTS)
            if want and any(plain_tokens(t)[j:j + len(want)] == want for j in range(len(plain_tokens(t))))
        }
        assert got == hit, words
    lists = df.select("pid", P.tokens(F.col("message")).alias("w")).collect()
    assert all((r.w or []) == plain_tokens(TEXTS[r.pid]) for r in lists)


def test_field_tests_and_missing_values(spark):
    df = logs(spark, [record("m", NOW, pid=1, facility="kern", priority=3, cap_effective=Decimal(2**64 - 1)), record("m", NOW, pid=2)])

    def pids(test):
        return [r.pid for r in df.where(test).orderBy("pid").collect()]

    assert pids(P.field_eq("facility", "kern")) == [1] and pids(P.field_eq("facility", "KERN")) == []
    assert pids(P.none_of(P.field_eq("facility", "kern"))) == [2]
    assert pids(P.field_range("priority", 3, 3)) == [1] and pids(P.field_range("priority", 4)) == []
    assert pids(P.field_eq("cap_effective", 2**64 - 1)) == [1]
    assert pids(P.field_range("source_timestamp", NOW, NOW)) == [1, 2]
    assert pids(P.match_all()) == [1, 2] and pids(P.any_of()) == []


def test_ranges(spark):
    assert S.relative_range(NOW, 0) == (None, None)
    assert S.relative_range(NOW, 180)[0] == int(NOW.timestamp()) - 10800
    assert S.RELATIVE_RANGES[180] == "3h" and S.RELATIVE_RANGES[720] == "12h"
    df = logs(spark, [record(str(i), NOW + dt.timedelta(seconds=i)) for i in range(5)])
    start = int(NOW.timestamp())
    assert [r.message for r in S.search(df, None, start + 1, start + 3).collect()] == ["2", "1"]
    assert [r.message for r in S.search(df, max_hits=2).collect()] == ["4", "3"]
    assert S.search_summary(df, max_hits=2).first() == (5, 2)


def test_shapes(spark):
    df = logs(spark, [record("a", NOW, priority=3, pid=5), record("b", NOW + dt.timedelta(microseconds=1500), full_message="x")])
    hits = S.search(df)
    assert S.discovered_names(hits) == ["source_timestamp", "full_message", "hostname", "message", "pid", "priority"]
    assert S.select_view(hits).columns == ["source_timestamp", "hostname", "priority", "message"]
    assert S.select_view(hits, ["pid", "comm", "full_message"]).columns == ["pid", "message"]
    assert {r.field for r in S.field_list(hits).collect()} == {"source_timestamp", "hostname", "pid", "priority"}
    assert [tuple(r) for r in S.search_table(hits).collect()] == [
        ("2026-04-10 12:00:00.001500 UTC", "x", "h", "b", None, None),
        ("2026-04-10 12:00:00 UTC", None, "h", "a", "5", "3 (Error)"),
    ]
    assert S.discovered_names(S.search(df.where("false"))) == []


def test_labels(spark):
    row = spark.range(1).select(
        priority_label(F.lit(0)).alias("a"), priority_label(F.lit(9)).alias("b"),
        hex_label(F.lit(Decimal(2**64 - 1)).cast("decimal(20,0)")).alias("c"), hex_label(F.lit(31)).alias("d"),
        time_label(F.timestamp_micros(F.lit(1_000))).alias("e"), time_label(F.timestamp_micros(F.lit(-1))).alias("f"),
        time_label(F.lit(None).cast("timestamp")).alias("g"),
    ).first()
    assert tuple(row) == (
        "0 (Emergency)", "9 (Unknown)", "0xffffffffffffffff", "0x1f", "1970-01-01 00:00:00.001 UTC",
        "1969-12-31 23:59:59.999999 UTC", None,
    )


def test_host_names_with_and_without_broadcast(spark):
    base = [("10.0.0.1", None), ("10.0.0.2", None), ("10.0.0.3", ""), ("10.0.0.1", "own"), (None, None)]
    df = logs(spark, [record("m", NOW, hostname=h, pid=i) for i, (_, h) in enumerate(base)])
    ips = spark.createDataFrame([(i, ip) for i, (ip, _) in enumerate(base)], "n int, src_ip string")
    df = df.join(ips, F.col("pid") == F.col("n")).drop("n")
    hosts = spark.createDataFrame([("10.0.0.1", "b"), ("10.0.0.1", "a"), ("10.0.0.3", "c"), (None, "z")], "ip string, name string")
    want = ["a", "10.0.0.2", "", "own", None]
    for limit in (100, 1):
        got = resolve_hostnames(df, hosts, max_broadcast_hosts=limit, salts=3).orderBy("pid").collect()
        assert [r.hostname for r in got] == want


def test_json_lines(spark):
    df = logs(spark, [record("a\"b", NOW, cap_effective=Decimal(2**64 - 1), pid=7), {}])
    lines = [r.value for r in to_ndjson(df).collect()]
    assert json.loads(lines[0]) == {
        "source_timestamp": int(NOW.timestamp()) * 10**6, "hostname": "h", "message": 'a"b', "pid": 7, "cap_effective": 2**64 - 1,
    }
    assert lines[1] == '{"source_timestamp":null,"hostname":null,"message":null}'
    assert sorted(map(str, from_ndjson(to_ndjson(df)).collect())) == sorted(map(str, df.collect()))
    path = tempfile.mkdtemp(prefix="run-json-") + "/out"
    write_ndjson(df, path)
    assert sorted(map(str, read_ndjson(spark, path).collect())) == sorted(map(str, df.collect()))


def test_table_life(spark):
    name = "life_of_logs"
    L.ensure_log_table(spark, name)
    days = [dt.datetime(2026, 1, 9, 23, 59, 59, tzinfo=UTC), dt.datetime(2026, 1, 10, tzinfo=UTC), NOW]
    df = logs(spark, [record(str(i), d) for i, d in enumerate(days)])
    L.append_to_table(df, name)
    L.ensure_log_table(spark, name)
    assert spark.table(name).count() == 3
    assert {r.message for r in L.apply_retention(df, NOW, 90).collect()} == {"1", "2"}
    assert L.drop_expired_partitions(spark, name, NOW, 90) == ["2026-01-09"]
    assert {r.message for r in spark.table(name).collect()} == {"1", "2"}
    spark.sql(f"DROP TABLE {name}")


def test_search_reads_few_columns_and_days(spark):
    path = tempfile.mkdtemp(prefix="run-logs-") + "/logs"
    L.write_logs(logs(spark, [record("x", NOW), record("y", NOW - dt.timedelta(days=3))]), path)
    start = int(NOW.timestamp()) - 3600
    found = S.search(L.read_logs(spark, path), P.field_eq("priority", 3), start).select("source_timestamp", "message")
    plan = found._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "TakeOrderedAndProject" in plan
    assert "event_date" in plan.split("PartitionFilters:")[1].split("\n")[0]
    pushed = plan.split("PushedFilters:")[1].split("\n")[0]
    assert "EqualTo(priority,3)" in pushed and "GreaterThanOrEqual(source_timestamp" in pushed
    assert "systemd_unit" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_page_of_a_search_reads_records_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(message):
        seen.add(1)
        return message != "no"

    test = F.udf(count, "boolean").asNondeterministic()
    rows = [record("yes" if i % 3 else "no", NOW - dt.timedelta(seconds=i), pid=i, hostname=None if i else "h") for i in range(30)]
    page = S.search_page(logs(spark, rows), test(F.col("message")), max_hits=7)
    assert (page.num_hits, page.hits.count(), page.columns[0]) == (20, 7, "source_timestamp")
    assert "hostname" not in page.columns and page.table().columns == page.columns
    assert page.view(["pid", "hostname"]).columns == ["pid", "message"]
    assert [r.pid for r in page.table().collect()] == ["1", "2", "4", "5", "7", "8", "10"]
    assert seen.value == 30
    S.search_table(S.search(logs(spark, rows), test(F.col("message")))).collect()
    assert seen.value == 60
    assert S.search_page(logs(spark, rows).where("false")).columns == []


def rows_scanned(df):
    """Rows that the scan of a plan gave, after it ran."""
    df._jdf.collectToPython()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_row_groups_without_a_string_are_skipped(spark, tmp_path):
    """Bloom filters pass over row groups whose bounds hold the wanted string, and over no row that has it."""
    from logkiln.sources import ingest_table as T

    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id"))
    made = {"source_timestamp": at, "hostname": F.lit("h"), "message": F.lit("m"), "message_id": F.md5(F.col("id").cast("string"))}
    data = spark.range(0, 200_000, 1, 4).select(*[made.get(f.name, F.lit(None)).cast(f.spark_type).alias(f.name) for f in C.FIELDS])
    wanted = P.field_eq("message_id", "a87ff679a2f3e71d9181a67b7542122c")  # of 4
    test_settings = {"spark.sql.adaptive.enabled": "false", "parquet.enable.dictionary": "false"}
    before = {k: spark.conf.get(k, None) for k in test_settings}
    for k, v in test_settings.items():
        spark.conf.set(k, v)
    try:
        for i in range(4):
            L.write_logs(data.where(f"unix_micros(source_timestamp) % 4 = {i}"), f"{tmp_path}/logs")
        hits = L.read_logs(spark, f"{tmp_path}/logs").where(wanted)
        assert hits.count() == 1
        assert 0 < rows_scanned(hits) < 200_000
        T.ensure_ingest_table(spark, "bloomed", f"{tmp_path}/table")
        try:
            more = [F.lit(None).cast(t).alias(n) for n, t in T._MORE.items()]
            for i in range(4):
                part = data.where(f"unix_micros(source_timestamp) % 4 = {i}")
                part.select("*", *more, F.lit(L.LOG).alias("outcome"), F.to_date("source_timestamp").alias(C.DATE_FIELD)).coalesce(1).write.insertInto("bloomed")
            hits = T.records(spark, "bloomed").where(wanted)
            assert hits.count() == 1 and 0 < rows_scanned(hits) <= 50_000
        finally:
            spark.sql("DROP TABLE bloomed")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_filters_of_small_files_are_small(spark, tmp_path):
    """A file of ten rows has bloom filters for ten rows, not of 32 KB and more for each column."""
    at = F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id"))
    made = {"source_timestamp": at, "hostname": F.lit("h"), "message": F.lit("m"), "message_id": F.md5(F.col("id").cast("string"))}
    rows = spark.range(0, 10, 1, 1).select(*[made.get(f.name, F.lit(None)).cast(f.spark_type).alias(f.name) for f in C.FIELDS])
    L.write_logs(rows, f"{tmp_path}/logs")
    sizes = [f.stat().st_size for f in tmp_path.glob("logs/*/*.parquet")]
    assert sizes and sum(sizes) < 200_000
