"""Syslog lines to their parts, in both common header styles, with built-in functions only.

Every part of the header is optional and whatever is left is the message, so a line never
fails; a part that does not fit stays in the text and the next part gets a try at it.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.functions.columns import settle
from logkiln.functions.convert import MAX_U64, wall_clock_year

# Facility names 0-15 in number order; 16-31 are local0-local15.
FACILITIES = (
    "kern", "user", "mail", "daemon", "auth", "syslog", "lpr", "news",
    "uucp", "cron", "authpriv", "ftp", "ntp", "audit", "alert", "clock",
)
DEFAULT_SEVERITY, DEFAULT_FACILITY = 5, "user"
# Month names of the short header stamp.
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

PARTS = ("priority", "facility", "source_timestamp", "hostname", "identifier", "pid", "message", "full_message")

# The texts of the header parts.
PRI = r"^<0*([0-9]{1,3})>"
VERSION = r"^[0-9]+ "
RFC5424_STAMP = (
    r"^[0-9]+ ([0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}"
    r"(?:[.][0-9]+)?(?:[Zz]|[+-][0-9]{2}:[0-9]{2})) "
)
RFC3164_STAMP = (
    r"^((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) (?: [0-9]|[0-9]{2}) [0-9]{2}:[0-9]{2}:[0-9]{2}) "
)
HOST = r"^([A-Za-z0-9.]+) "
TAG = r"^([^:\[ \t]+)(?:\[([0-9]+)\])?: "


def facility_name(number: Column) -> Column:
    local = F.concat(F.lit("local"), (number - 16).cast("string"))
    names = F.array(*[F.lit(n) for n in FACILITIES])
    return F.when(number < len(FACILITIES), F.get(names, number)).otherwise(local)


def severity_of(pri: Column) -> Column:
    return pri.bitwiseAND(7)


def facility_of(pri: Column) -> Column:
    return facility_name(F.shiftright(pri, 3))


def rfc3164_instant(stamp: Column, recv_ts: Column, zone: str = "UTC") -> Column:
    """Instant of a ``Mon dd HH:MM:SS`` text in the year of receipt, null if no such moment.

    A clock time the zone skips is null; one it has twice is the earlier of the two.
    """
    def number(pos: int) -> Column:
        return F.trim(F.substring(stamp, pos, 2)).try_cast("int")

    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(stamp, 1, 3)).cast("int")
    parts = [wall_clock_year(recv_ts, zone), month, number(5), number(8), number(11), number(14).cast("decimal(16,6)")]
    wall = F.call_function("try_make_timestamp", *parts, F.lit("UTC"))
    if zone == "UTC":
        return wall
    instant = F.to_utc_timestamp(wall, zone)
    return F.when(F.from_utc_timestamp(instant, zone) == wall, instant)


def _after(text: Column, length: Column | int) -> Column:
    return F.substr(text, F.lit(length) + 1 if isinstance(length, int) else length + 1)


def _steps(df: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    return reduce(lambda d, s: d.withColumns(s), steps, df)


def parse_syslog_table(df: DataFrame, zone: str = "UTC") -> DataFrame:
    """Add the parts of each ``payload`` to the datagram columns.

    Parts: priority, facility, source_timestamp, hostname, identifier, pid, message,
    full_message. ``zone`` is the time zone that stamps without one are written in.
    """
    found = F.col("_stamp5").isNotNull() | F.col("_stamp3").isNotNull()
    pid_text = F.regexp_extract("_rest3", TAG, 2)
    pid = pid_text.try_cast("decimal(38,0)")
    tag_fits = (pid_text == "") | F.coalesce(pid <= F.lit(Decimal(MAX_U64)), F.lit(False))
    tagged = F.regexp_extract("_rest3", TAG, 0)
    bare = ~found & F.col("hostname").isNull() & F.col("identifier").isNull() & F.col("_rest4").startswith(" ")
    pri = F.regexp_extract("full_message", PRI, 1).try_cast("int")
    stamp5 = F.regexp_extract("_rest1", RFC5424_STAMP, 1)
    stamp3 = F.regexp_extract("_rest1", RFC3164_STAMP, 1)
    host = F.regexp_extract("_rest2", HOST, 1)

    parsed = _steps(
        df,
        {"full_message": F.make_valid_utf8(F.col("payload").cast("string"))},
        {"_pri": F.when(pri <= 255, pri)},
        {
            "_rest1": F.when(F.col("_pri").isNull(), F.col("full_message")).otherwise(
                _after(F.col("full_message"), F.position(F.lit(">"), F.col("full_message")))
            )
        },
        {"_text5": stamp5, "_text3": stamp3},
        {
            "_stamp5": F.when(F.col("_text5") != "", F.upper("_text5").try_cast("timestamp")),
            "_stamp3": F.when(F.col("_text3") != "", rfc3164_instant(F.col("_text3"), F.col("recv_ts"), zone)),
        },
        {
            "_rest2": F.when(
                F.col("_stamp5").isNotNull(),
                # The blank after this stamp is not consumed.
                _after(F.col("_rest1"), F.length(F.regexp_extract("_rest1", VERSION, 0)) + F.length("_text5")),
            )
            .when(F.col("_stamp3").isNotNull(), _after(F.col("_rest1"), F.length("_text3") + 1))
            .otherwise(F.col("_rest1"))
        },
        {"hostname": F.nullif(host, F.lit(""))},
        {
            "_rest3": F.when(F.col("hostname").isNull(), F.col("_rest2")).otherwise(
                _after(F.col("_rest2"), F.length("hostname") + 1)
            )
        },
        {"_tag": F.when(tag_fits, F.nullif(tagged, F.lit("")))},
        {
            "identifier": F.when(F.col("_tag").isNotNull(), F.regexp_extract("_rest3", TAG, 1)),
            "pid": F.when(F.col("_tag").isNotNull() & (pid_text != ""), pid).cast("decimal(20,0)"),
            "_rest4": F.when(F.col("_tag").isNull(), F.col("_rest3")).otherwise(
                _after(F.col("_rest3"), F.length("_tag"))
            ),
        },
    )
    pri_col = F.col("_pri")
    parts = parsed.select(
        *df.columns,
        F.coalesce(severity_of(pri_col), F.lit(DEFAULT_SEVERITY)).alias("priority"),
        F.coalesce(facility_of(pri_col), F.lit(DEFAULT_FACILITY)).alias("facility"),
        F.coalesce("_stamp5", "_stamp3", "recv_ts").alias("source_timestamp"),
        "hostname",
        "identifier",
        "pid",
        F.when(bare, _after(F.col("_rest4"), 1)).otherwise(F.col("_rest4")).alias("message"),
        "full_message",
    )
    return settle(parts, *PARTS)
