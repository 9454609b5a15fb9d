"""Texts shown for column values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logkiln import catalog as C

# Names of the priorities 0-7.
PRIORITY_NAMES = ("Emergency", "Alert", "Critical", "Error", "Warning", "Notice", "Informational", "Debug")


def priority_label(n: Column) -> Column:
    names = F.array(*[F.lit(p) for p in PRIORITY_NAMES])
    known = n.between(0, len(PRIORITY_NAMES) - 1)
    name = F.when(known, F.get(names, F.when(known, n).cast("int"))).otherwise("Unknown")
    return F.concat(n.cast("string"), F.lit(" ("), name, F.lit(")"))


def hex_label(n: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.conv(n.cast("string"), 10, 16)))


def time_label(ts: Column) -> Column:
    """UTC date and time with 0, 3 or 6 decimals, in any session time zone."""
    us = F.unix_micros(ts)
    fraction = F.pmod(us, F.lit(1_000_000))
    seconds = ((us - fraction) / 1_000_000).cast("bigint")
    of_day = F.pmod(seconds, F.lit(86_400))
    day = F.date_from_unix_date(((seconds - of_day) / 86_400).cast("int")).cast("string")

    def two(n: Column) -> Column:
        return F.lpad(F.floor(n).cast("string"), 2, "0")

    clock = F.concat_ws(":", two(of_day / 3600), two(F.pmod(of_day, F.lit(3600)) / 60), two(F.pmod(of_day, F.lit(60))))
    digits = F.lpad(fraction.cast("string"), 6, "0")
    decimals = (
        F.when(fraction == 0, F.lit(""))
        .when(F.pmod(fraction, F.lit(1000)) == 0, F.concat(F.lit("."), F.substring(digits, 1, 3)))
        .otherwise(F.concat(F.lit("."), digits))
    )
    return F.when(ts.isNotNull(), F.concat(day, F.lit(" "), clock, decimals, F.lit(" UTC")))


def display_text(field: C.Field) -> Column:
    """Text of a column; null where the value is null."""
    value = F.col(field.name)
    if field.storage in C.TIME_STORAGE:
        return time_label(value)
    if field.display == "syslog_priority":
        return priority_label(value)
    if field.display == "hex":
        return hex_label(value)
    return value.cast("string")
