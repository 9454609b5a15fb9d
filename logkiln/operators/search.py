"""Searches over log tables, and the shape their hits are shown in."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.functions.display import display_text
from logkiln.functions.text import match_all
from logkiln.staging import stage

MAX_HITS = 1000
DEFAULT_MINUTES = 5
# Offered ranges in minutes; 0 is no bound.
RELATIVE_RANGES = {
    0: "All time", 1: "1m", 5: "5m", 15: "15m", 30: "30m", 60: "1h", 180: "3h", 720: "12h",
    1440: "1d", 2880: "2d", 7200: "5d", 10080: "7d", 20160: "14d", 43200: "30d",
}
# Columns shown unless others are chosen, and those never offered as columns.
DEFAULT_ENABLED = ("source_timestamp", "comm", "hostname", "priority")
MESSAGE_FIELDS = ("message", "full_message")

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


@dataclass(frozen=True)
class SearchOptions:
    """A search: predicate and bounds in epoch seconds, start included, end excluded."""

    predicate: Column | None = None
    start: int | None = None
    end: int | None = None
    max_hits: int = MAX_HITS


def event_date(ts: Column | str = C.TIME_FIELD) -> Column:
    """UTC day of an instant, in any session time zone."""
    us = F.unix_micros(ts)
    return F.date_from_unix_date(((us - F.pmod(us, F.lit(86_400_000_000))) / 86_400_000_000).cast("int"))


def in_time_range(df: DataFrame, start_s: int | None = None, end_s: int | None = None) -> DataFrame:
    """``start <= source_timestamp < end``; also bounds the partition column where there is one."""
    ts, day = F.col(C.TIME_FIELD), F.col(C.DATE_FIELD)
    dated = C.DATE_FIELD in df.columns
    if start_s is not None:
        df = df.where(ts >= F.timestamp_micros(F.lit(int(start_s) * 1_000_000)))
        df = df.where(day >= F.lit((_EPOCH + timedelta(seconds=start_s)).date())) if dated else df
    if end_s is not None:
        df = df.where(ts < F.timestamp_micros(F.lit(int(end_s) * 1_000_000)))
        df = df.where(day <= F.lit((_EPOCH + timedelta(seconds=end_s)).date())) if dated else df
    return df


def relative_range(now: datetime, minutes: int = DEFAULT_MINUTES) -> tuple[int | None, None]:
    """Bounds of the last ``minutes``; 0 gives no bound."""
    if minutes == 0:
        return None, None
    moment = now if now.tzinfo else now.replace(tzinfo=timezone.utc)
    return int((moment - _EPOCH).total_seconds()) - minutes * 60, None


def matching(logs: DataFrame, predicate: Column | None = None, start=None, end=None) -> DataFrame:
    return in_time_range(logs, start, end).where(match_all() if predicate is None else predicate)


def newest(df: DataFrame, k: int = MAX_HITS) -> DataFrame:
    """The ``k`` newest records; equal instants are ordered by the next columns of the record."""
    ties = [F.col(f) for f in ("hostname", "message", "full_message", "syslog_identifier", "syslog_pid", "pid")]
    return df.orderBy(F.col(C.TIME_FIELD).desc(), *ties).limit(k)


def search(logs: DataFrame, predicate: Column | None = None, start=None, end=None, max_hits: int = MAX_HITS) -> DataFrame:
    return newest(matching(logs, predicate, start, end), max_hits)


@dataclass(frozen=True)
class SearchPage:
    """What one search gives: the hits as a stored table, how many records match, and the columns that have values."""

    hits: DataFrame
    num_hits: int
    columns: list[str]

    def table(self) -> DataFrame:
        """Hits as shown: the columns found only, in display order, as text."""
        return hits_to_display(self.hits).select(*self.columns)

    def view(self, enabled: Iterable[str] = DEFAULT_ENABLED) -> DataFrame:
        """The chosen columns that have values, as text, and the message."""
        return select_view(self.hits, enabled, self.columns)


def search_page(logs: DataFrame, predicate: Column | None = None, start=None, end=None, max_hits: int = MAX_HITS) -> SearchPage:
    """Hits, number of matches and columns from one pass over the records.

    Matches are counted as they flow to the top-k; the hits are stored once and the columns are found on those.
    """
    seen = Observation()
    matches = matching(logs, predicate, start, end).observe(seen, F.count("*").alias("num_hits"))
    hits = stage(newest(matches, max_hits))
    return SearchPage(hits, seen.get["num_hits"], discovered_names(hits))


def newest_by_day(logs: DataFrame, days: Iterable[date], predicate: Column | None = None, start=None, end=None, max_hits: int = MAX_HITS) -> DataFrame:
    """The hits of a search over a table by days, reading no more days than it takes.

    The newest of ``days`` is searched first, then the two before it, then four, until there are enough hits: no record of an
    earlier day can be among them. ``days`` are those the table has.
    """
    left, width, found = sorted(days, reverse=True), 1, None
    need = max_hits
    while left and need > 0:
        now, left = left[:width], left[width:]
        part = stage(search(logs.where(F.col(C.DATE_FIELD).between(F.lit(now[-1]), F.lit(now[0]))), predicate, start, end, need))
        need -= part.count()
        found, width = part if found is None else found.unionByName(part), width * 2
    return newest(logs.where("false") if found is None else found, max_hits)


def run_search(logs: DataFrame, options: SearchOptions) -> DataFrame:
    return search(logs, options.predicate, options.start, options.end, options.max_hits)


def search_summary(logs: DataFrame, predicate: Column | None = None, start=None, end=None, max_hits: int = MAX_HITS) -> DataFrame:
    """One row: matches before the limit, and hits a search returns."""
    total = F.count("*")
    return matching(logs, predicate, start, end).agg(
        total.alias("num_hits"), F.least(total, F.lit(max_hits)).alias("hits_returned")
    )


def hits_to_display(hits: DataFrame) -> DataFrame:
    """Every column as the text shown for it, null where the value is null."""
    return hits.select(*[display_text(C.BY_NAME[c]).alias(c) for c in hits.columns if c in C.BY_NAME])


def discover_columns(hits: DataFrame) -> DataFrame:
    """Columns with a value in at least one hit, with the number of hits that have one."""
    names = [c for c in hits.columns if c in C.BY_NAME]
    counts = hits.agg(*[F.count(c).alias(c) for c in names])
    return counts.unpivot([], names, "field", "n_non_null").where("n_non_null > 0")


def order_columns(names: Iterable[str]) -> list[str]:
    """The time first, the others in byte order."""
    return sorted(names, key=lambda n: (n != C.TIME_FIELD, n.encode()))


def discovered_names(hits: DataFrame) -> list[str]:
    """Discovered columns in display order; at most one row per catalog column is collected."""
    return order_columns(r.field for r in discover_columns(hits).collect())


def search_table(hits: DataFrame) -> DataFrame:
    """Hits as shown: discovered columns only, in display order, as text. The hits are stored, so a search runs once."""
    hits = stage(hits)
    return hits_to_display(hits).select(*discovered_names(hits))


def select_view(hits: DataFrame, enabled: Iterable[str] = DEFAULT_ENABLED, discovered: Iterable[str] | None = None) -> DataFrame:
    """The chosen columns that have values, as text, and the message. Unless the columns are given, the hits are stored."""
    hits = stage(hits) if discovered is None else hits
    found = discovered_names(hits) if discovered is None else order_columns(discovered)
    chosen = set(enabled) - set(MESSAGE_FIELDS)
    return hits_to_display(hits).select(*[c for c in found if c in chosen], "message")


def field_list(hits: DataFrame) -> DataFrame:
    """Columns a user may choose from."""
    return discover_columns(hits).where(~F.col("field").isin(*MESSAGE_FIELDS))
