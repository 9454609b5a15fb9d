"""The 62 columns of a log record, in order, and where each one comes from.

This is the only place that knows the columns: the table schema, both normalisers, the
NDJSON form, the search rules and the display rules are all derived from ``FIELDS``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING, TEXT, U64, I64 = "string", "text", "u64", "i64"
TIMESTAMP, FAST_TIMESTAMP = "timestamp", "fast_timestamp"

#: Storage types that hold an instant.
TIME_STORAGE = (TIMESTAMP, FAST_TIMESTAMP)
#: The three keys a GELF message must have; every other key is an additional one.
REQUIRED_GELF_KEYS = ("version", "host", "short_message")
#: Text columns searched when a query names no field.
DEFAULT_SEARCH_FIELDS = ("message", "full_message")
#: The time column, and the day column the tables are partitioned by.
TIME_FIELD = "source_timestamp"
DATE_FIELD = "event_date"
#: Days a record is kept.
RETENTION_DAYS = 90


@dataclass(frozen=True)
class Source:
    """One key a column may be read from, and the conversion it goes through."""

    key: str
    conversion: str = "none"


@dataclass(frozen=True)
class Field:
    name: str
    storage: str
    gelf: tuple[Source, ...]
    syslog: str | None = None
    display: str | None = None
    written_when_null: bool = False

    @property
    def spark_type(self) -> T.DataType:
        if self.storage in TIME_STORAGE:
            return T.TimestampType()
        if self.name == "cap_effective":
            # A 64-bit mask: all-ones is an ordinary value and does not fit a signed long.
            return T.DecimalType(20, 0)
        return T.LongType() if self.storage in (U64, I64) else T.StringType()


def _field(name, storage, *sources, syslog=None, display=None, written_when_null=False, conversion="none"):
    gelf = tuple(s if isinstance(s, Source) else Source(s, conversion) for s in sources)
    return Field(name, storage, gelf, syslog, display, written_when_null)


def _journal(name, storage, **kw):
    """A journal property sent under its own upper-case name."""
    return _field(name, storage, f"_{name.upper()}", **kw)


def _trusted(name, storage, **kw):
    """A trusted journal property: the second spelling carries one more underscore."""
    return _field(name, storage, f"_{name.upper()}", f"__{name.upper()}", **kw)


# Column names, types, key names and key order decide which record comes out.
FIELDS: tuple[Field, ...] = (
    _field(
        "source_timestamp", FAST_TIMESTAMP,
        Source("timestamp", "float_sec_to_usec"),
        "_SOURCE_REALTIME_TIMESTAMP", "__SOURCE_REALTIME_TIMESTAMP",
        syslog="source_timestamp", written_when_null=True,
    ),
    _field("hostname", STRING, "host", "_HOSTNAME", syslog="hostname", written_when_null=True),
    _field("message", TEXT, "short_message", syslog="message", written_when_null=True),
    _field("priority", U64, "level", "_PRIORITY", syslog="priority", display="syslog_priority"),
    _field("full_message", TEXT, "full_message", syslog="full_message"),
    _journal("message_id", STRING),
    _field("code_file", TEXT, "file", "_CODE_FILE"),
    _field("code_line", U64, "line", "_CODE_LINE"),
    _field("code_func", STRING, "_CODE_FUNC", "_function"),
    _journal("errno", I64),
    _journal("invocation_id", STRING),
    _journal("user_invocation_id", STRING),
    _field("facility", STRING, "facility", "_facility", "_SYSLOG_FACILITY", syslog="facility"),
    _journal("syslog_identifier", STRING, syslog="identifier"),
    _journal("syslog_pid", U64, syslog="pid"),
    _journal("syslog_timestamp", TIMESTAMP, conversion="syslog_timestamp"),
    _trusted("pid", U64),
    _trusted("uid", U64),
    _trusted("gid", U64),
    _trusted("comm", STRING),
    _trusted("exe", STRING),
    _trusted("cmdline", TEXT),
    _trusted("cap_effective", U64, conversion="hex_to_uint", display="hex"),
    _trusted("audit_session", U64),
    _trusted("audit_loginuid", U64),
    _trusted("systemd_cgroup", TEXT),
    _trusted("systemd_slice", TEXT),
    _trusted("systemd_unit", TEXT),
    _trusted("systemd_user_unit", TEXT),
    _trusted("systemd_user_slice", TEXT),
    _trusted("systemd_session", STRING),
    _trusted("systemd_owner_uid", U64),
    _trusted("selinux_context", STRING),
    _trusted("boot_id", STRING),
    _trusted("machine_id", STRING),
    _trusted("systemd_invocation_id", STRING),
    _trusted("transport", STRING),
    _trusted("stream_id", STRING),
    _journal("line_break", STRING),
    _journal("namespace", STRING),
    _journal("kernel_device", TEXT),
    _journal("kernel_subsystem", STRING),
    _journal("udev_sysname", TEXT),
    _journal("udev_devnode", TEXT),
    _journal("udev_devlink", TEXT),
    _journal("coredump_unit", TEXT),
    _journal("coredump_user_unit", TEXT),
    _journal("object_pid", U64),
    _journal("object_uid", U64),
    _journal("object_gid", U64),
    _journal("object_comm", STRING),
    _journal("object_exe", STRING),
    _journal("object_cmdline", TEXT),
    _journal("object_audit_session", U64),
    _journal("object_audit_loginuid", U64),
    _journal("object_systemd_cgroup", TEXT),
    _journal("object_systemd_session", STRING),
    _journal("object_systemd_owner_uid", U64),
    _journal("object_systemd_unit", TEXT),
    _journal("object_systemd_user_unit", TEXT),
    _field("recv_rt_timestamp", TIMESTAMP, "___REALTIME_TIMESTAMP"),
    _field("recv_mt_timestamp", U64, "___MONOTONIC_TIMESTAMP"),
)

BY_NAME: dict[str, Field] = {f.name: f for f in FIELDS}
FIELD_NAMES: tuple[str, ...] = tuple(f.name for f in FIELDS)
TIME_FIELDS: tuple[str, ...] = tuple(f.name for f in FIELDS if f.storage in TIME_STORAGE)


def gelf_keys() -> tuple[str, ...]:
    """Every GELF key that some column reads, each once, in catalog order."""
    return tuple(dict.fromkeys(s.key for f in FIELDS for s in f.gelf))


def log_schema() -> T.StructType:
    """Schema of a normalised log record; field metadata says how it may be searched."""
    return T.StructType(
        [
            T.StructField(f.name, f.spark_type, True, {"storage": f.storage, "fast": f.storage == FAST_TIMESTAMP})
            for f in FIELDS
        ]
    )


#: One row per datagram: the input of every decode job. ``recv_ts`` is the only clock.
DATAGRAM = T.StructType(
    [
        T.StructField("proto", T.StringType()),
        T.StructField("src_ip", T.StringType()),
        T.StructField("src_port", T.IntegerType()),
        T.StructField("recv_ts", T.TimestampType()),
        T.StructField("payload", T.BinaryType()),
    ]
)

#: Rows that could not become a record, with the stage and the reason.
QUARANTINE_COLUMNS = ("src_ip", "recv_ts", "payload", "stage", "reason")
