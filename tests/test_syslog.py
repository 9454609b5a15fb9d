import datetime as dt

import pytest
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.operators.normalize import normalize_syslog, valid_logs
from logkiln.operators.syslog import parse_syslog_table

UTC = dt.timezone.utc
RECV = dt.datetime(2026, 12, 1, 4, 30, tzinfo=UTC)


def datagrams(spark, payloads, recv=RECV):
    rows = [("syslog", "10.0.0.1", 514, recv, bytearray(p if isinstance(p, bytes) else p.encode())) for p in payloads]
    return spark.createDataFrame(rows, C.DATAGRAM)


def parse_all(spark, lines, recv=RECV, zone="UTC"):
    rows = parse_syslog_table(datagrams(spark, lines, recv), zone).select(
        "payload", "priority", "facility", F.unix_micros("source_timestamp").alias("us"), "hostname", "identifier",
        "pid", "message", "full_message",
    ).collect()
    out = {}
    for r in rows:
        stamp = dt.datetime(1970, 1, 1, tzinfo=UTC) + dt.timedelta(microseconds=r.us)
        pid = None if r.pid is None else int(r.pid)
        out[bytes(r.payload).decode()] = (r.priority, r.facility, stamp, r.hostname, r.identifier, pid, r.message)
    return out


def parse(spark, line, recv=RECV, zone="UTC"):
    return parse_all(spark, [line], recv, zone)[line]


def at(*parts):
    return dt.datetime(*parts, tzinfo=UTC)


CASES = [
    # The lines the original behaviour is known from.
    ("<165>", (5, "local4", RECV, None, None, None, "")),
    ("Jan  2 12:24:59 ", (5, "user", at(2026, 1, 2, 12, 24, 59), None, None, None, "")),
    (
        "<78>Aug  2 09:00:00 crond[926]: USER root pid 14786 cmd logger -p syslog.info -- -- MARK --",
        (6, "cron", at(2026, 8, 2, 9), None, "crond", 926, "USER root pid 14786 cmd logger -p syslog.info -- -- MARK --"),
    ),
    ("<46>Aug  1 19:00:00 root: -- MARK --", (6, "syslog", at(2026, 8, 1, 19), None, "root", None, "-- MARK --")),
    (
        "<7> [0]DAA FXO: ON-HOOK, PARA HANDSET: OFF-HOOK",
        (7, "kern", RECV, None, None, None, "[0]DAA FXO: ON-HOOK, PARA HANDSET: OFF-HOOK"),
    ),
    ("<7> register callback", (7, "kern", RECV, None, None, None, "register callback")),
    # Consequences of the rules that look odd but are the rules.
    ("<7>register callback", (7, "kern", RECV, "register", None, None, "callback")),
    ("hello world foo", (5, "user", RECV, "hello", None, None, "world foo")),
    (
        "<34>1 2003-10-11T22:14:15.003Z mymachine.example.com su - ID47 - failed",
        (2, "auth", at(2003, 10, 11, 22, 14, 15, 3000), None, None, None, " mymachine.example.com su - ID47 - failed"),
    ),
    ("<34>1 - host app - - - x", (2, "auth", RECV, "1", None, None, "- host app - - - x")),
    ("<13>Aug 2 09:00:00 host app: m", (5, "user", RECV, "Aug", None, None, "2 09:00:00 host app: m")),
    ("<13>Feb 29 09:00:00 host app: m", (5, "user", RECV, "Feb", None, None, "29 09:00:00 host app: m")),
    (
        "<13>Aug  2 09:00:00 my-host sshd[1]: hi",
        (5, "user", at(2026, 8, 2, 9), None, None, None, "my-host sshd[1]: hi"),
    ),
    ("<255>Aug 12 24:00:00 x: y", (7, "local15", RECV, "Aug", None, None, "12 24:00:00 x: y")),
    ("<300>Aug  2 09:00:00 a b: c", (5, "user", RECV, None, None, None, "<300>Aug  2 09:00:00 a b: c")),
    (
        "<13>Aug  2 09:00:00 h1 a[99999999999999999999]: q",
        (5, "user", at(2026, 8, 2, 9), "h1", None, None, "a[99999999999999999999]: q"),
    ),
    ("", (5, "user", RECV, None, None, None, "")),
    # Further edges.
    ("<007>Aug 12 10:00:00 h x[5]: two\nlines", (7, "kern", at(2026, 8, 12, 10), "h", "x", 5, "two\nlines")),
    ("<13>Aug 12 10:00:60 h x: leap", (5, "user", at(2026, 8, 12, 10, 1), "h", "x", None, "leap")),
    ("<13>Aug 32 10:00:00 h x: m", (5, "user", RECV, "Aug", None, None, "32 10:00:00 h x: m")),
    ("<14>1 2003-08-24T05:14:15.000003-07:00 h x: m", (6, "user", at(2003, 8, 24, 12, 14, 15, 3), None, None, None, " h x: m")),
    (
        "h1 a[18446744073709551615]: q",
        (5, "user", RECV, "h1", "a", 18446744073709551615, "q"),
    ),
    ("a[1:2]: x", (5, "user", RECV, None, None, None, "a[1:2]: x")),
    ("été app: m", (5, "user", RECV, None, None, None, "été app: m")),
]


@pytest.fixture(scope="module")
def parsed(spark):
    return parse_all(spark, [line for line, _ in CASES])


@pytest.mark.parametrize("line,expected", CASES, ids=[c[0][:40] or "empty" for c in CASES])
def test_lines(parsed, line, expected):
    assert parsed[line] == expected


def test_bytes_that_are_not_utf8_are_replaced(spark):
    row = parse_syslog_table(datagrams(spark, [b"<13>Aug  2 09:00:00 h x: a\xffb"])).first()
    assert row.message == "a�b"


def test_stamp_takes_the_year_of_receipt_in_the_zone(spark):
    new_year = dt.datetime(2026, 12, 31, 23, 30, tzinfo=UTC)
    assert parse(spark, "Jan  1 00:30:00 h x: m", new_year, "Europe/Berlin")[2] == at(2026, 12, 31, 23, 30)
    assert parse(spark, "Dec 31 23:59:59 h x: m", dt.datetime(2026, 1, 1, 0, 0, 5, tzinfo=UTC))[2] == at(2026, 12, 31, 23, 59, 59)


def test_skipped_and_repeated_clock_times(spark):
    skipped = parse(spark, "Mar 29 02:30:00 h x: m", zone="Europe/Berlin")
    assert skipped[2] == RECV and skipped[3] == "Mar"
    assert parse(spark, "Oct 25 02:30:00 h x: m", zone="Europe/Berlin")[2] == at(2026, 10, 25, 0, 30)


def test_normalised_columns_and_validity(spark):
    lines = ["<165>", "<78>Aug  2 09:00:00 crond[926]: hi", "a[18446744073709551615]: q", ""]
    out = normalize_syslog(parse_syslog_table(datagrams(spark, lines)))
    assert [f.name for f in out.schema][2:-1] == list(C.FIELD_NAMES)
    assert {f.name: f.dataType for f in out.schema if f.name in C.BY_NAME} == {
        f.name: f.spark_type for f in C.FIELDS
    }
    rows = valid_logs(out).collect()
    assert sorted((r.message, r.syslog_pid, r.convert_reason) for r in rows) == [
        ("hi", 926, None), ("q", None, "syslog_pid:pid:over_long"),
    ]


def test_session_time_zone_does_not_matter(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert parse(spark, "Jan  2 12:24:59 x: y")[2] == at(2026, 1, 2, 12, 24, 59)
        assert parse(spark, "<34>1 2003-10-11T22:14:15Z x")[2] == at(2003, 10, 11, 22, 14, 15)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
