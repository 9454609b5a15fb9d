"""Conversions from the text of a GELF value to a typed column value, as SQL expressions.

A conversion takes the text of one JSON string or number (null when the key is absent) and
gives two expressions: the converted value, and the reason it was refused or null (none at all
where no text is refused). A refused value rejects its whole message. Numbers come as written,
so 12 passes as a whole number and 12.0 does not.

They are SQL text rather than Column calls because a record needs well over a hundred of them:
one call per column builds the plan in a fraction of the time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from logkiln import catalog as C

MAX_U64 = "18446744073709551615"

# The end of the text: a dollar sign would also match before a last line end.
_END = "(?!(?s:.))"
# The texts each kind of number may be written in.
U64_TEXT = "^[+]?[0-9]+" + _END
I64_TEXT = "^[+-]?[0-9]+" + _END
DOUBLE_TEXT = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?" + _END
NON_FINITE_TEXT = "(?i)^[+-]?(inf|infinity|nan)" + _END
HEX_TEXT = "^[+]?0*[0-9a-fA-F]{1,16}" + _END
RFC3339_TEXT = "^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt][0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})" + _END
RFC2822_TEXT = (
    "^([A-Za-z]{3},[ ]?)?[0-9]{1,2} [A-Z][a-z]{2} [0-9]{4} [0-9]{2}:[0-9]{2}:[0-9]{2} ([+-][0-9]{4}|GMT|UT)" + _END
)
RFC3164_TEXT = "^[A-Z][a-z]{2} [0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}" + _END

Sql = tuple[str, str | None]


def _unsigned(v: str) -> Sql:
    value = f"try_cast({v} AS bigint)"
    too_long = f"coalesce(try_cast({v} AS decimal(38,0)) <= {MAX_U64}, false)"
    reason = (
        f"CASE WHEN NOT {v} RLIKE '{U64_TEXT}' THEN 'not_u64' WHEN {v} IS NOT NULL AND {value} IS NULL "
        f"THEN if({too_long}, 'over_long', 'not_u64') END"
    )
    return value, reason


def lenient(v: str, field: C.Field, recv_ts: str) -> Sql:
    """The JSON type itself, or text that reads as that type."""
    if field.storage in (C.STRING, C.TEXT):
        return v, None
    if field.storage == C.I64:
        value = f"try_cast({v} AS bigint)"
        return value, f"CASE WHEN {v} IS NOT NULL AND (NOT {v} RLIKE '{I64_TEXT}' OR {value} IS NULL) THEN 'not_i64' END"
    value, reason = _unsigned(v)
    return (f"timestamp_micros({value})" if field.storage in C.TIME_STORAGE else value), reason


def float_sec_to_usec(v: str, field: C.Field, recv_ts: str) -> Sql:
    """Seconds as a number or numeric text, to microseconds, truncated; negative and NaN become 0."""
    micros = f"if({v} RLIKE '{DOUBLE_TEXT}', try_cast({v} AS double) * 1e6D, null)"
    nothing = f"coalesce({micros} <= 0, startswith({v}, '-') OR {v} RLIKE '(?i)nan$', false)"
    value = f"if({nothing}, 0L, try_cast({micros} AS bigint))"
    reason = (
        f"CASE WHEN NOT ({v} RLIKE '{DOUBLE_TEXT}' OR {v} RLIKE '{NON_FINITE_TEXT}') THEN 'not_seconds' "
        f"WHEN {v} IS NOT NULL AND {value} IS NULL THEN 'over_long' END"
    )
    # Absent seconds must stay absent.
    return f"timestamp_micros(if({v} IS NULL, null, {value}))", reason


def hex_to_uint(v: str, field: C.Field, recv_ts: str) -> Sql:
    """Hexadecimal text without a prefix, of at most 64 bits."""
    digits = f"if({v} RLIKE '{HEX_TEXT}', ltrim('+', {v}), null)"
    return (
        f"CAST(conv({digits}, 16, 10) AS decimal(20,0))",
        f"CASE WHEN NOT {v} RLIKE '{HEX_TEXT}' THEN 'not_hex' END",
    )


def syslog_timestamp(v: str, field: C.Field, recv_ts: str) -> Sql:
    """RFC 3339, RFC 2822 or ``Mon d HH:MM:SS`` text, the last read as UTC in the year of receipt."""
    text = rf"trim(regexp_replace({v}, r'\s+', ' '))"
    year = f"year(date_from_unix_date(CAST(floor(unix_micros({recv_ts}) / 86400000000) AS int)))"
    dated = f"regexp_replace(regexp_replace({text}, '^[A-Za-z]{{3}}, ?', ''), '(GMT|UT)$', '+0000')"
    value = (
        f"CASE WHEN {text} RLIKE '{RFC3339_TEXT}' THEN try_cast(upper({text}) AS timestamp) "
        f"WHEN {text} RLIKE '{RFC2822_TEXT}' THEN try_to_timestamp({dated}, 'd MMM yyyy HH:mm:ss Z') "
        f"WHEN {text} RLIKE '{RFC3164_TEXT}' THEN "
        f"try_to_timestamp(concat_ws(' ', {year}, {text}, '+0000'), 'yyyy MMM d HH:mm:ss Z') END"
    )
    # One use of the value: -1 before 1970, 2 where no form fits.
    reason = (
        f"CASE if({v} IS NULL, 0D, coalesce(signum(unix_micros({value})), 2D)) "
        "WHEN 2D THEN 'not_stamp' WHEN -1D THEN 'negative_time' END"
    )
    return value, reason


#: Conversion names used by the catalog. ``datetime_to_usec`` has no entry: a parsed syslog
#: stamp already is a timestamp and needs no conversion here.
CONVERSIONS: dict[str, Callable[[str, C.Field, str], Sql]] = {
    "none": lenient,
    "float_sec_to_usec": float_sec_to_usec,
    "hex_to_uint": hex_to_uint,
    "syslog_timestamp": syslog_timestamp,
}


def convert(v: str, field: C.Field, source: C.Source, recv_ts: str = "recv_ts") -> Sql:
    return CONVERSIONS[source.conversion](v, field, recv_ts)


def wall_clock_year(instant: Column, zone: str = "UTC") -> Column:
    """Calendar year of an instant in a zone, whatever the session time zone is."""
    wall = F.unix_micros(F.from_utc_timestamp(instant, zone) if zone != "UTC" else instant)
    return F.year(F.date_from_unix_date(F.floor(wall / F.lit(86_400_000_000)).cast("int")))
