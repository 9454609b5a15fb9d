"""Reassembly of chunked messages on a stream, with the rules of the batch form.

Ids are dealt to ``BUCKETS`` buckets, and a bucket is what the state is kept by: calls between Spark and Python, frames and timers are
needed once a bucket and micro-batch and not once an id. The open group of an id is an entry (start, size, slots filled, end) of a map; what a
micro-batch adds to its slots is one entry of another. A micro-batch writes the slots that it fills and reads those of a group only
when it closes. The timer of a bucket stands at the first end of its groups.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from logkiln.functions.columns import settle
from logkiln.operators.chunks import COMPLETE, EXPIRED, GROUP, IGNORED, LIFETIME_SECONDS, MIN_COUNT, chunk_key
from logkiln.operators.packets import CHUNK_MAGIC

_NAMES = tuple(c.split()[0] for c in GROUP.split("array<")[0].split(", "))
#: Buckets that ids are dealt to, for good: a stream goes on with as many as it began with.
BUCKETS = 1024
#: Where the state of such a stream must be kept.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _instant(us: int | None):
    return None if us is None else pd.Timestamp(us, unit="us", tz="UTC")


def _whole_number(value) -> int | None:
    return None if pd.isna(value) else int(value)


class _Group:
    """An open group: what is known of it, the slots that this micro-batch filled, and in how many parts earlier ones wrote theirs."""

    def __init__(self, opened: int, size: int, chunk_id: bytes, seen: bytes = b"", parts: int = 0, end: int = 0):
        self.opened, self.size, self.chunk_id, self.parts, self.end = opened, size, chunk_id, parts, end
        self.seen, self.filled = set(seen), {}

    def fill(self, seqno: int, slot: tuple) -> None:
        self.seen.add(seqno)
        self.filled[seqno] = slot


class ChunkGroups(StatefulProcessor):
    """The open groups of the ids of a bucket; rows out for groups that close and chunks that are ignored."""

    def __init__(self, lifetime_us: int):
        self.lifetime_us = lifetime_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at bigint")
        self.groups = handle.getMapState("groups", "k string", "opened bigint, size int, chunk_id binary, seen binary, parts int, end bigint")
        self.slots = handle.getMapState("slots", "k string, part int", "filled binary")

    def close(self) -> None:
        pass

    def _row(self, status, opened, size, present, chunk_id, arrival=None, payload=None, pieces=None):
        t, ip, port = arrival or (None, None, None)
        return (status, chunk_id, size, present, _instant(opened), ip, port, _instant(t), payload, pieces)

    def _piece(self, chunk_id: bytes, seqno: int, slot: tuple) -> dict:
        t, count, ip, port, content = slot
        return {"src_ip": ip, "src_port": port, "recv_ts": _instant(t), "payload": CHUNK_MAGIC + chunk_id + bytes([seqno, count]) + content}

    def _expired(self, k: str, group: _Group):
        slots = self._all_slots(k, group)
        pieces = [self._piece(group.chunk_id, n, slots[n]) for n in sorted(slots)]
        return self._row(EXPIRED, group.opened, group.size, len(slots), group.chunk_id, pieces=pieces)

    def _frame(self, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=list(_NAMES))
        out["src_port"] = out["src_port"].astype("Int32")
        return out

    def _open_groups(self) -> dict[str, _Group]:
        """The groups of the bucket that earlier micro-batches left open."""
        return {k: _Group(opened, size, bytes(chunk_id), bytes(seen), parts, end) for (k,), (opened, size, chunk_id, seen, parts, end) in self.groups.iterator()}

    def _all_slots(self, k: str, group: _Group) -> dict:
        """All slots of a group; what earlier micro-batches wrote of them is read here."""
        slots: dict = {}
        for part in range(group.parts):
            slots.update(pickle.loads(bytes(self.slots.getValue((k, part))[0])))
        return slots | group.filled

    def _forget(self, k: str, group: _Group) -> None:
        for part in range(group.parts):
            self.slots.removeKey((k, part))
        self.groups.removeKey((k,))

    def _keep(self, k: str, group: _Group, watermark_us: int) -> None:
        # Late groups have their lifetime from the present clock. Timers are in whole milliseconds.
        end = (max(group.opened, watermark_us) + self.lifetime_us) // 1000 + 1
        if group.filled:
            self.slots.updateValue((k, group.parts), (pickle.dumps(group.filled),))
        group.parts, group.end = group.parts + bool(group.filled), end
        self.groups.updateValue((k,), (group.opened, group.size, group.chunk_id, bytes(sorted(group.seen)), group.parts, end))

    def _set_timer(self, groups: dict[str, _Group]) -> None:
        first, before = min((g.end for g in groups.values()), default=None), self.timer.get()
        if before is not None and before[0] != first:
            self.handle.deleteTimer(before[0])
            self.timer.clear()
        if first is not None and (before is None or before[0] != first):
            self.handle.registerTimer(first)
            self.timer.update((first,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Rows of a micro-batch come in no order; arrival order decides.
        arrived = pd.concat(list(rows)).sort_values(["k", "t", "seqno", "count", "src_ip", "src_port", "h"], na_position="first")
        columns = [arrived[c].tolist() for c in ("k", "t", "seqno", "count", "src_ip", "src_port", "chunk_id", "content")]
        out: list = []
        kept = self._open_groups()
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        for k, chunks in groupby(zip(*columns), lambda chunk: chunk[0]):
            chunks, group = list(chunks), kept.get(k)
            if group is not None:
                # What came more than a lifetime before the open group is no part of it.
                at = next((i for i, chunk in enumerate(chunks) if chunk[1] >= group.opened - self.lifetime_us), len(chunks))
                left = self._work(k, chunks[:at], None, out)
                if left is not None:
                    out.append(self._expired(k, left))
                chunks = chunks[at:]
                if not chunks:
                    continue
            left = self._work(k, chunks, group, out)
            if left is not group and group is not None:
                self._forget(k, group)
                del kept[k]
            if left is not None:
                self._keep(k, left, watermark_us)
                kept[k] = left
        self._set_timer(kept)
        if out:
            yield self._frame(out)

    def _work(self, k: str, chunks: list, group: _Group | None, out: list) -> _Group | None:
        """The group left open by the chunks of one id; it is ``group`` itself if that is still open."""
        for _, t, seqno, count, ip, port, chunk_id, content in chunks:
            t, seqno, count, port = int(t), int(seqno), int(count), _whole_number(port)
            if group is not None and t > group.opened + self.lifetime_us:
                out.append(self._expired(k, group))
                group = None
            if group is None:
                group = _Group(t, count, bytes(chunk_id))
            if seqno < group.size:
                group.fill(seqno, (t, count, ip, port, bytes(content)))
                if len(group.seen) == group.size:
                    whole = self._all_slots(k, group)
                    payload = b"".join(whole[n][4] for n in range(group.size))
                    out.append(self._row(COMPLETE, group.opened, group.size, group.size, group.chunk_id, (t, ip, port), payload))
                    group = None
            else:
                pieces = [self._piece(group.chunk_id, seqno, (t, count, ip, port, bytes(content)))]
                out.append(self._row(IGNORED, group.opened, group.size, len(group.seen), group.chunk_id, (t, ip, port), pieces=pieces))
        return group

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, clock = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        groups = self._open_groups()
        over = {k: g for k, g in groups.items() if g.end <= due or g.end < clock}
        out = [self._expired(k, g) for k, g in over.items()]
        for k, g in over.items():
            self._forget(k, g)
        # Spark takes the timer that has come itself.
        self.timer.clear()
        self._set_timer({k: g for k, g in groups.items() if k not in over})
        if out:
            yield self._frame(out)


def with_clock(rows: DataFrame, delay: str = "1 second", settled: tuple[str, ...] = ()) -> DataFrame:
    """The rows with a watermark that drops none of them, however late.

    Spark drops late rows before the state sees them, by the column that the watermark is on. So each row
    comes as two: its time alone moves ``clock``, and the row itself, with ``taken``, has no time there. Rows that later filters on ``settled`` columns leave out move the clock too.
    """
    tick = F.struct(F.col("recv_ts").alias("clock"), F.lit(False).alias("taken"))
    row = F.struct(F.lit(None).cast("timestamp").alias("clock"), F.lit(True).alias("taken"))
    both = rows.select("*", F.inline(F.array(tick, row)))
    # Settled, so that filters stay above the watermark.
    return settle(both.withWatermark("clock", delay), "taken", *settled).where("taken").drop("taken")


def reassemble_chunks_stream(
    chunks: DataFrame,
    key: tuple[str, ...] = ("chunk_id",),
    lifetime_seconds: float = LIFETIME_SECONDS,
    delay: str | None = "1 second",
) -> DataFrame:
    """Streaming form: classified chunk rows in, the columns of the batch form out.

    Groups that stay open are given up once the watermark on ``recv_ts`` passes their end. Chunks behind the
    watermark are worked like others: they join the open group of their id if they came within a lifetime
    of its start, else they make groups of their own. One task holds what one micro-batch brings for a bucket of ids, so the
    source's intake limit bounds it. With ``delay`` None the rows have been through ``with_clock``.
    """
    clocked = chunks if delay is None else with_clock(chunks, delay)
    clocked.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        clocked.where(F.col("count") >= MIN_COUNT)
        .select(
            F.pmod(F.xxhash64(chunk_key(key)), F.lit(BUCKETS)).cast("int").alias("bucket"), chunk_key(key).alias("k"), "clock", F.unix_micros("recv_ts").alias("t"), "seqno", "count",
            "src_ip", "src_port", "chunk_id", "content", F.xxhash64("content").alias("h"),
        )
        .groupBy("bucket")
        .transformWithStateInPandas(ChunkGroups(int(lifetime_seconds * 1e6)), GROUP, "append", "EventTime")
    )
