import datetime as dt
from datetime import datetime

import gzip
import json
import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.operators import packets
from logkiln.operators.gelf import decode_gelf_json, decode_gelf_packets
from logkiln.operators.normalize import normalize_gelf
from logkiln.operators.packets import classify_packets, inflate

UTC = dt.timezone.utc
RECV = dt.datetime(2026, 12, 1, 4, 30, tzinfo=UTC)


def test_catalog_counts():
    assert len(C.FIELDS) == 62 and len(set(C.FIELD_NAMES)) == 62
    assert Counter(f.storage for f in C.FIELDS) == {
        "string": 22, "text": 19, "u64": 17, "timestamp": 2, "i64": 1, "fast_timestamp": 1,
    }
    assert sum(f.syslog is not None for f in C.FIELDS) == 8
    assert sum(f.written_when_null for f in C.FIELDS) == 3
    assert sum(f.display is not None for f in C.FIELDS) == 2


def rows(spark, bodies):
    data = [("gelf", "10.0.0.1", i, RECV, bytearray(b)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(data, C.DATAGRAM)


def gelf(**members):
    base = {"version": "1.1", "host": "h", "short_message": "m", "timestamp": 1}
    return json.dumps({**base, **members})


BASE = '{"version":"1.1","host":"h","short_message":"m","timestamp":1'
# body, column looked at, its value, refusal
VALUES = [
    (gelf(_PID=12), "pid", 12, None),
    (gelf(_PID="+12"), "pid", 12, None),
    (gelf(_PID=" 12"), "pid", None, "pid:_PID:not_u64"),
    (gelf(_PID=-1), "pid", None, "pid:_PID:not_u64"),
    (BASE + ',"_PID":12.0}', "pid", None, "pid:_PID:not_u64"),
    (BASE + ',"_PID":1e3}', "pid", None, "pid:_PID:not_u64"),
    (gelf(_PID=True), "pid", None, "pid:_PID:not_u64"),
    (gelf(_PID=None), "pid", None, "pid:_PID:not_u64"),
    (gelf(_PID=2**63), "pid", None, "pid:_PID:over_long"),
    (gelf(_PID=2**64), "pid", None, "pid:_PID:not_u64"),
    (gelf(_PID=7, __PID="x"), "pid", 7, "pid:__PID:not_u64"),
    (gelf(__PID=8), "pid", 8, None),
    (gelf(_ERRNO="-5"), "errno", -5, None),
    (gelf(_ERRNO=-5), "errno", -5, None),
    (gelf(_ERRNO="x"), "errno", None, "errno:_ERRNO:not_i64"),
    (gelf(facility=3), "facility", None, "facility:facility:not_string"),
    (gelf(facility="3"), "facility", "3", None),
    (gelf(_HOSTNAME="other"), "hostname", "h", None),
    (gelf(_HOSTNAME=1), "hostname", "h", "hostname:_HOSTNAME:not_string"),
    (gelf(level=3, _PRIORITY="high"), "priority", 3, "priority:_PRIORITY:not_u64"),
    (gelf(_CAP_EFFECTIVE="ffffffffffffffff"), "cap_effective", 2**64 - 1, None),
    (gelf(_CAP_EFFECTIVE="+0000000000000000001F"), "cap_effective", 31, None),
    (gelf(_CAP_EFFECTIVE=18446744073709551615), "cap_effective", 2**64 - 1, None),
    (gelf(_CAP_EFFECTIVE="0x1f"), "cap_effective", None, "cap_effective:_CAP_EFFECTIVE:not_hex"),
    (gelf(_CAP_EFFECTIVE="10000000000000000"), "cap_effective", None, "cap_effective:_CAP_EFFECTIVE:not_hex"),
    (gelf(_CAP_EFFECTIVE=1.5), "cap_effective", None, "cap_effective:_CAP_EFFECTIVE:not_hex"),
    (gelf(timestamp="1.5"), "source_timestamp", 1_500_000, None),
    (gelf(timestamp=1385053862.3072), "source_timestamp", 1385053862307200, None),
    (gelf(timestamp=-3), "source_timestamp", 0, None),
    (gelf(timestamp="nan"), "source_timestamp", 0, None),
    (gelf(timestamp="inf"), "source_timestamp", None, "source_timestamp:timestamp:over_long"),
    (gelf(timestamp="1.0d"), "source_timestamp", None, "source_timestamp:timestamp:not_seconds"),
    (gelf(timestamp=" 1.5 "), "source_timestamp", None, "source_timestamp:timestamp:not_seconds"),
    (gelf(timestamp=None), "source_timestamp", None, "source_timestamp:timestamp:not_seconds"),
    (gelf(_SYSLOG_TIMESTAMP=" 2003-10-11T22:14:15.003Z "), "syslog_timestamp", 1065910455003000, None),
    (gelf(_SYSLOG_TIMESTAMP="Sat, 11 Oct 2003 22:14:15 +0200"), "syslog_timestamp", 1065903255000000, None),
    (gelf(_SYSLOG_TIMESTAMP="Aug  2 09:00:00"), "syslog_timestamp", 1785661200000000, None),
    (gelf(_SYSLOG_TIMESTAMP="2003-10-11"), "syslog_timestamp", None, "syslog_timestamp:_SYSLOG_TIMESTAMP:not_stamp"),
    (gelf(_SYSLOG_TIMESTAMP=5), "syslog_timestamp", None, "syslog_timestamp:_SYSLOG_TIMESTAMP:not_stamp"),
    (gelf(_SYSLOG_TIMESTAMP="1960-10-11T00:00:00Z"), "syslog_timestamp", -290995200000000, "syslog_timestamp:_SYSLOG_TIMESTAMP:negative_time"),
    (gelf(___REALTIME_TIMESTAMP="1600000000000001"), "recv_rt_timestamp", 1600000000000001, None),
]


@pytest.fixture(scope="module")
def converted(spark):
    out = normalize_gelf(
        decode_gelf_json(inflate(classify_packets(rows(spark, [v[0].encode() for v in VALUES])))), ("src_port", "json_reason")
    )
    times = {c: F.unix_micros(c).alias(c) for c in C.TIME_FIELDS}
    return {r.src_port: r for r in out.select(*[times.get(c, F.col(c)) for c in out.columns]).collect()}


@pytest.mark.parametrize("i", range(len(VALUES)), ids=[v[0][-50:] for v in VALUES])
def test_values(converted, i):
    _, column, value, reason = VALUES[i]
    row = converted[i]
    assert row.json_reason is None and row.convert_reason == reason
    if reason is None:
        assert row[column] == value


def test_bodies_and_packets(spark):
    good = gelf().encode()
    cases = [
        (good, None), (b" \n" + good + b"\n", None), (good + b" x", "bad_json"), (good + b"]", "bad_json"),
        (good + b"] " + good, "bad_json"), (good + good, "bad_json"), (b"[1]", "bad_json"), (b"{'version':'1'}", "bad_json"),
        (good[:-1] + b',"x":NaN}', "bad_json"), (good + b"\xff", "bad_utf8"), (good[:-1] + b',"x":"\\ud800"}', "bad_json"),
        (good[:-1] + b',"_x":["\\ud800"]}', "bad_json"), (good[:-1] + b',"_x":{"y":[1,{"\\udc00":2}]}}', "bad_json"),
        (good[:-1] + b',"_x":[{"y":"\\ud83d\\ude00"}]}', None),
        (good[:-1] + b',"_x":1,"_x":2}', None), (good[:-1] + b',"host":"again"}', "required:repeated"),
        (b'{"version":1,"host":"h","short_message":"m"}', "required:version"),
        (b'{"version":"1","host":"h"}', "required:short_message"),
        (gzip.compress(good), None), (gzip.compress(good) + gzip.compress(b"more"), None), (zlib.compress(good) + b"tail", None),
        (gzip.compress(good)[:-3], "bad_gzip"), (zlib.compress(good)[:-1], "bad_zlib"), (b"\x78\x9cnonsense", "bad_zlib"),
        (b"{", "too_small"), (b"", "too_small"), (b"\x1e\x0f123456789", "short_chunk"), (gzip.compress(gzip.compress(good)), "bad_utf8"),
    ]
    out = decode_gelf_json(inflate(classify_packets(rows(spark, [c[0] for c in cases]))))
    reason = F.coalesce("packet_reason", "inflate_reason", "json_reason")
    got = {r.src_port: r.r for r in out.select("src_port", reason.alias("r")).collect()}
    assert [(c[0], got[i]) for i, c in enumerate(cases)] == cases


def test_numbers_with_a_line_end_or_too_many_digits_are_refused(spark):
    from logkiln.plans.ingest import decode_datagrams

    def body(field):
        return ('{"version":"1.1","host":"h","short_message":"m","timestamp":1,' + field + "}").encode()

    fields = ['"_PID":"12\\n"', '"_CAP_EFFECTIVE":"1f\\n"', '"_CAP_EFFECTIVE":' + "9" * 5000, '"_PID":"12"']
    now = datetime(2024, 1, 1)
    data = spark.createDataFrame([("gelf", "1.1.1.1", 1, now, bytearray(body(f))) for f in fields], C.DATAGRAM)
    got = sorted(str(r.reason).rsplit(":", 1)[-1] for r in decode_datagrams(data).collect())
    assert got == ["None", "not_hex", "not_hex", "not_u64"]


def test_one_step_decodes_like_two(spark, monkeypatch):
    good = gelf(_PID=12, _UID="7", level=[1]).encode()
    bodies = [good, gzip.compress(good), zlib.compress(good), zlib.compress(good)[:-1], b"", b"{", b"\x1e\x0f123456789", b"\x1e\x0f" + bytes(12), b"\x78\x9cno", b"{]"]
    data = classify_packets(rows(spark, bodies * 30)).coalesce(1)
    names = ["src_port", "kind", "packet_reason", "inflate_reason", "json_reason", "type_reason", "gelf.host", "gelf._PID", "gelf._UID", "payload"]
    one, two = (sorted(map(str, x.select(*names).collect())) for x in (decode_gelf_packets(data), decode_gelf_json(inflate(data))))
    assert one == two
    assert decode_gelf_packets(data.where("false")).count() == 0


def test_one_python_step_in_the_plan(spark):
    out = normalize_gelf(decode_gelf_packets(classify_packets(rows(spark, [b"{}"]))).where("json_reason is null"))
    plan = out.where("convert_reason is null")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan


def test_bodies_that_grow_are_bounded():
    """A thousandfold body passes within the limit; beyond it none is held whole, and batches go out by bytes."""
    body = b"a" * (1 << 20)
    assert len(zlib.compress(body)) * 900 < len(body)
    assert packets.open_body("zlib", zlib.compress(body), 1 << 20) == (body, None)
    assert packets.open_body("zlib", zlib.compress(body), (1 << 20) - 1) == (None, "too_large")
    assert packets.open_body("gzip", gzip.compress(body)[:-1], 1 << 20) == (None, "bad_gzip")
    assert packets.open_body("gzip", gzip.compress(b""), 0) == (b"", None)
    huge = zlib.compress(b"a" * (300 << 20))
    tracemalloc.start()
    assert packets.open_body("zlib", huge) == (None, "too_large")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * packets.MAX_BODY


def test_batches_go_out_by_bytes(spark):
    body = json.dumps({"version": "1.1", "host": "h", "short_message": "m", "full_message": "a" * (1 << 20)}).encode()
    data = classify_packets(rows(spark, [zlib.compress(body)] * 100)).coalesce(1)
    assert decode_gelf_packets(data).where(F.length("gelf.full_message") == 1 << 20).count() == 100
    refused = decode_gelf_packets(data, max_bytes=1 << 20).groupBy("inflate_reason", "json_reason").count().collect()
    assert [tuple(r) for r in refused] == [("too_large", "no_body", 100)]
    made = []

    def columns(bodies, reasons):
        made.append(sum(map(len, bodies)))
        return []

    class Frame:
        columns, schema = ["payload", "kind"], data.select("payload", "kind").schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            batch = pa.RecordBatch.from_pydict({"payload": [zlib.compress(body)] * 100, "kind": ["zlib"] * 100})
            return [b.num_rows for b in run(iter([batch]))]

    from pyspark.sql import types as T

    assert sum(packets.map_bodies(Frame(), T.StructType([]), columns, "payload", packets.MAX_BODY)) == 100
    assert len(made) > 5 and max(made) <= packets.BATCH_BYTES + len(body)


def test_batches_of_packets_are_bounded(spark):
    """Packets reach the decoder in batches of some hundred, whatever the session allows."""
    from logkiln.operators import packets

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        rows = spark.range(0, 3000, 1, 1).select(F.lit("plain").alias("kind"), F.lit(b"{}").alias("payload"))

        def sizes(batches):
            import pyarrow as pa

            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

        found = [r.n for r in packets.inflate(rows).mapInArrow(sizes, "n bigint").collect()]
        assert sum(found) == 3000 and max(found) <= packets.BATCH_ROWS
    finally:
        spark.conf.set(key, before)
