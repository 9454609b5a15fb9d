"""Reassembly of chunked messages, for tables of any size and any skew of chunk ids.

The rules, per chunk id and in order of arrival: the first chunk opens a group of as many slots
as it announces; a chunk fills the slot of its sequence number, the last one wins; a full group
is a message and closes; a group closes unfinished once it is older than the lifetime.

Only small arrival facts (who, when, which slot, a content hash) take part in the decision which
arrival ends up in which slot of which group. Contents are joined to the winning arrivals
afterwards, on keys that include the arrival, so no id can pile contents up in one task.

Arrivals of an ordinary id are scanned in one sorted pass that holds one open group. An id with
more arrivals than that should have ("hot") is cut into blocks of time. What a block does only
depends on where in it the first new group opens, and there are few such places: the rows within
one lifetime of its start. So each block is turned into a map from entry row to the entry row of
the next block. Maps are composed ``FAN_IN`` at a time, level by level, until an id has no more than that; then the entries go
down the levels again, and with its entry known every block is scanned on its own. No task holds more than ``FAN_IN`` maps
or the rows of one block, and blocks of an id are the shorter the more rows its busiest one has, down to little more than a lifetime.
The result is the same as one scan of the whole id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.operators.packets import CHUNK_MAGIC
from logkiln.staging import stage

LIFETIME_SECONDS = 5
MIN_COUNT = 2
COMPLETE, EXPIRED, IGNORED = "complete", "expired", "ignored"
#: Maps of a hot id that are composed at once.
FAN_IN = 64
#: Rows that the busiest block of a hot id should have at most, and the shortest block in lifetimes.
BLOCK_ROWS, SHORTEST_BLOCK = 100_000, 1.25
#: Ids with more arrivals are cut into blocks.
HOT_ROWS = 5_000_000

_ORDER = ("t", "seqno", "count", "src_ip", "src_port", "h")
_PIECES = (
    "k string, scope bigint, n bigint, status string, opened bigint, size int, present int, "
    "closed bigint, closed_ip string, closed_port int, "
    "slot int, t bigint, count int, src_ip string, src_port int, h bigint, copies bigint"
)


def _scan(lifetime_us: int):
    """Scan arrivals sorted by (k, scope, arrival order).

    One output row per filled slot of a group, complete or expired, and one per
    arrival whose number lies past the slots of its group. An expired group without a slot has one row too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in _PIECES.split(", ")]
        types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
        schema = pa.schema([(p.split()[0], types[p.split()[1]]) for p in _PIECES.split(", ")])
        out: list[tuple] = []
        here = None  # (k, scope) being scanned
        group = None  # [opened, size, {slot: arrival}]
        row = n = 0
        done = False  # the rest of this scope belongs to the next block

        def close(status: str, arrival: tuple | None) -> None:
            nonlocal group, n
            opened, size, slots = group
            t, ip, port = (arrival[0], arrival[2], arrival[3]) if arrival else (None, None, None)
            head = (*here, n, status, opened, size, len(slots), t, ip, port)
            if slots:
                out.extend((*head, slot, *piece) for slot, piece in slots.items())
            else:
                out.append((*head, None, None, None, None, None, None, 1))
            group = None
            n += 1

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("k", "scope", "entry", "own", *_ORDER, "copies")]
            for k, scope, entry, own, t, seqno, count, ip, port, h, copies in zip(*cols):
                if (k, scope) != here:
                    if group is not None:
                        close(EXPIRED, None)
                    here, row, n, done = (k, scope), 0, 0, False
                row += 1
                if done or row <= entry:
                    continue
                if group is not None and t > group[0] + lifetime_us:
                    close(EXPIRED, None)
                if group is None:
                    if not own:
                        done = True
                        continue
                    group = [t, count, {}]
                if seqno < group[1]:
                    group[2][seqno] = (t, count, ip, port, h, copies)
                    if len(group[2]) == group[1]:
                        close(COMPLETE, group[2][seqno])
                else:
                    facts = (group[0], group[1], len(group[2]), None, None, None)
                    out.append((*here, n, IGNORED, *facts, seqno, t, count, ip, port, h, copies))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=schema)
                out = []
        if group is not None:
            close(EXPIRED, None)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*out)))), schema=schema)

    return run


def _block_map(lifetime_us: int):
    """Per block: for each row a group may open at on entry, the row it opens at in the next block."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(_ORDER), na_position="first")  # Spark's order: nulls first
        t = rows["t"].to_numpy()
        seqno = rows["seqno"].to_numpy()
        size = rows["count"].to_numpy()
        own = int(rows["own"].sum())
        last = np.searchsorted(t, t + lifetime_us, side="right")  # first row past each row's lifetime
        ahead = np.full(256, len(t) + 1, dtype=np.int64)  # next row with each sequence number
        exits = np.zeros(own + 1, dtype=np.int32)
        for i in range(len(t) - 1, -1, -1):
            ahead[seqno[i]] = i
            if i < own:
                reopen = min(int(ahead[: size[i]].max()) + 1, int(last[i]))
                exits[i] = reopen - own if reopen >= own else exits[reopen]
        start = key[1] * int(rows["block_us"].iloc[0])
        entries = int(np.searchsorted(t[:own], start + lifetime_us, side="right")) + 1
        return pd.DataFrame({"k": [key[0]], "block": [key[1]], "exits": [exits[:entries].tobytes()]})

    return run


def _follow(exits: bytes, entry: np.ndarray) -> np.ndarray:
    table = np.frombuffer(exits, dtype=np.int32)
    # An entry past the last row of a block means the next block starts afresh.
    return np.where(entry < len(table), table[np.minimum(entry, len(table) - 1)], 0)


def _compose(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
    maps = maps.sort_values("block")
    state, before = None, None
    for block, last, exits in zip(maps["block"], maps["last"], maps["exits"]):
        if state is None:
            state = np.arange(len(exits) // 4)
        elif block != before + 1:
            state = np.zeros_like(state)
        state, before = _follow(exits, state), last
    return pd.DataFrame(
        {
            "k": [key[0]], "block": [maps["block"].iloc[0]], "last": [maps["last"].iloc[-1]],
            "exits": [state.astype(np.int32).tobytes()],
        }
    )


def _entries(key: tuple, maps: pd.DataFrame) -> pd.DataFrame:
    """Walk maps in order; the entry of the first is ``entry`` if given, else 0."""
    maps = maps.sort_values("block")
    entry = np.array([int(maps["entry"].iloc[0])])
    before, found = None, []
    for block, last, exits in zip(maps["block"], maps["last"], maps["exits"]):
        if before is not None and block != before + 1:
            entry = np.zeros(1, dtype=np.int64)
        found.append(int(entry[0]))
        entry, before = _follow(exits, entry), last
    return pd.DataFrame({"k": key[0], "block": maps["block"].to_numpy(), "entry": found})


def _floor_div(number: Column, by: int | Column) -> Column:
    by = F.lit(by) if isinstance(by, int) else by
    return ((number - F.pmod(number, by)) / by).cast("bigint")


def _block_lengths(arrivals: DataFrame, lifetime_us: int, block_us: int, block_rows: int) -> DataFrame:
    """Rows (k, block_us): shorter blocks for ids whose busiest one would have too many rows. Few ids are hot."""
    busy = arrivals.groupBy("k", _floor_div(F.col("t"), block_us).alias("block")).agg(F.count("*").alias("n")).groupBy("k").agg(F.max("n").alias("n"))
    fitting = F.floor(F.lit(block_us).cast("double") * block_rows / F.greatest("n", F.lit(block_rows))).cast("bigint")
    return busy.select("k", F.greatest(fitting, F.lit(min(block_us, int(lifetime_us * SHORTEST_BLOCK) + 1)).cast("bigint")).alias("block_us"))


def _block_entries(maps: DataFrame, fan_in: int) -> DataFrame:
    """Rows (k, block, entry) for the maps (k, block, exits) of each block."""
    levels = [stage(maps.withColumn("last", F.col("block")))]
    width = fan_in
    while levels[-1].groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > fan_in).limit(1).count():
        spans = levels[-1].withColumn("span", _floor_div(F.col("block"), width)).groupBy("k", "span")
        levels.append(stage(spans.applyInPandas(_compose, "k string, block bigint, last bigint, exits binary")))
        width *= fan_in
    found = levels[-1].withColumn("entry", F.lit(0)).groupBy("k").applyInPandas(_entries, "k string, block bigint, entry bigint")
    for level in reversed(levels[:-1]):
        width //= fan_in
        span = _floor_div(F.col("block"), width)
        above = found.select("k", span.alias("span"), "entry")
        found = level.withColumn("span", span).join(above, ["k", "span"]).groupBy("k", "span").applyInPandas(_entries, "k string, block bigint, entry bigint")
    return found


def _hot_rows(arrivals: DataFrame, lifetime_us: int, block_us: int, block_rows: int, fan_in: int) -> DataFrame:
    """Arrivals of hot ids, cut into blocks with their entry rows."""
    # Equal arrivals at one instant: only the first and the last can matter, so one instant
    # never holds more than a bounded number of rows.
    tie = F.struct("src_ip", "src_port", "h")
    ends = arrivals.groupBy("k", "t", "seqno", "count").agg(
        F.min(tie).alias("a"), F.max(tie).alias("z"), F.count("*").alias("m")
    )
    # All but the first fare alike, so the last stands for them.
    first = F.struct("a.*", F.lit(1).cast("bigint").alias("copies"))
    last = F.struct("z.*", (F.col("m") - 1).alias("copies"))
    rows = ends.select(
        "k", "t", "seqno", "count", F.explode(F.when(F.col("m") == 1, F.array(first)).otherwise(F.array(first, last))).alias("end")
    ).select("k", "t", "seqno", "count", "end.*")
    length = F.col("block_us")
    rows = rows.join(F.broadcast(_block_lengths(rows, lifetime_us, block_us, block_rows)), "k")
    block = _floor_div(F.col("t"), length)
    early = F.pmod(F.col("t"), length) <= lifetime_us
    blocks = rows.withColumn(
        "block", F.explode(F.when(early, F.array(block, block - 1)).otherwise(F.array(block)))
    ).withColumn("own", F.col("block") == block)
    # A copy for a block that has no rows of its own opens nothing there.
    maps = blocks.groupBy("k", "block").applyInPandas(_block_map(lifetime_us), "k string, block bigint, exits binary")
    return blocks.join(_block_entries(maps, fan_in), ["k", "block"]).select(
        "k", F.col("block").alias("scope"), "entry", "own", *_ORDER, "copies"
    )


def hot_ids(arrivals: DataFrame, hot_rows: int) -> DataFrame:
    # At most (all arrivals / hot_rows) ids are hot, so this side is small whatever the input.
    return F.broadcast(stage(arrivals.groupBy("k").agg(F.count("*").alias("n_rows")).where(F.col("n_rows") > hot_rows).select("k")))


def _each_sender(ignored: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Ignored rows that stand for several arrivals of a hot id, with the senders of those."""
    instant = ["k", "t", "seqno", "count"]
    tie = F.struct("src_ip", "src_port", "h")
    senders = arrivals.groupBy(*instant, "src_ip", "src_port", "h").agg(F.count("*").alias("m"))
    # The first arrival has a row of its own.
    first = senders.groupBy(*instant).agg(F.min(tie).alias("first"))
    others = senders.join(first, instant).withColumn("m", F.col("m") - F.col("first").eqNullSafe(tie).cast("bigint")).where("m > 0")
    others = others.select(
        F.col("k").alias("o_k"), F.col("t").alias("o_t"), F.col("seqno").alias("o_slot"), F.col("count").alias("o_count"),
        F.col("src_ip").alias("o_ip"), F.col("src_port").alias("o_port"), F.col("h").alias("o_h"), F.col("m").alias("o_copies"),
    )
    several = (F.col("copies") > 1) & (F.col("k") == F.col("o_k")) & (F.col("t") == F.col("o_t")) & (F.col("slot") == F.col("o_slot")) & (F.col("count") == F.col("o_count"))
    joined, folded = ignored.join(others, several, "left"), F.col("o_k").isNotNull()
    return joined.withColumns({
        "src_ip": F.when(folded, F.col("o_ip")).otherwise(F.col("src_ip")),
        "src_port": F.when(folded, F.col("o_port")).otherwise(F.col("src_port")),
        "h": F.when(folded, F.col("o_h")).otherwise(F.col("h")),
        "copies": F.when(folded, F.col("o_copies")).otherwise(F.col("copies")),
    })


def chunk_key(key: tuple[str, ...]) -> Column:
    return F.concat_ws("|", *[F.hex(c) if c == "chunk_id" else F.col(c).cast("string") for c in key])


def arrivals_of(chunks: DataFrame, key: tuple[str, ...], *more: str | Column) -> DataFrame:
    """Rows (k, t, seqno, count, src_ip, src_port, h), which tell arrivals apart, and ``more`` of classified chunk rows."""
    return chunks.where(F.col("count") >= MIN_COUNT).select(
        chunk_key(key).alias("k"), F.unix_micros("recv_ts").alias("t"), "seqno", "count", "src_ip", "src_port",
        F.xxhash64("content").alias("h"), *more,
    )


def assign_chunks(
    chunks: DataFrame,
    key: tuple[str, ...] = ("chunk_id",),
    lifetime_seconds: float = LIFETIME_SECONDS,
    block_seconds: float = 60,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Decide which arrival fills which slot of which group.

    One row per filled slot of a complete or expired group and per ignored arrival. Ids with more than
    ``hot_rows`` arrivals are handled in blocks of ``block_seconds``, or shorter ones of about ``block_rows`` rows; there a row
    may stand for ``copies`` arrivals of one instant. ``hot`` names these ids where they are known already.
    """
    return assign_arrivals(arrivals_of(chunks, key), lifetime_seconds, block_seconds, hot_rows, block_rows, fan_in, hot)


def assign_arrivals(
    arrivals: DataFrame,
    lifetime_seconds: float = LIFETIME_SECONDS,
    block_seconds: float = 60,
    hot_rows: int = HOT_ROWS,
    block_rows: int = BLOCK_ROWS,
    fan_in: int = FAN_IN,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``assign_chunks`` for rows of ``arrivals_of``."""
    lifetime_us, block_us = int(lifetime_seconds * 1e6), int(block_seconds * 1e6)
    if block_us <= lifetime_us or fan_in < 2:
        raise ValueError("a block must be longer than the lifetime of a group, and maps are composed two at a time at least")
    hot = hot_ids(arrivals, hot_rows) if hot is None else hot
    ordinary = arrivals.join(hot, "k", "left_anti").select(
        "k", F.lit(0).cast("bigint").alias("scope"), F.lit(0).cast("bigint").alias("entry"), F.lit(True).alias("own"), *_ORDER,
        F.lit(1).cast("bigint").alias("copies"),
    )
    if hot.isEmpty():
        rows = ordinary
    else:
        hot_arrivals = stage(arrivals.join(hot, "k", "left_semi"))
        rows = ordinary.unionByName(_hot_rows(hot_arrivals, lifetime_us, block_us, block_rows, fan_in))
    return (
        rows.repartition("k", "scope")
        .sortWithinPartitions("k", "scope", *_ORDER)
        .mapInArrow(_scan(lifetime_us), _PIECES)
    )


#: A chunk that came, as it came.
PIECE = "struct<src_ip: string, src_port: int, recv_ts: timestamp, payload: binary>"

#: Columns of reassembled groups and ignored arrivals.
GROUP = (
    "status string, chunk_id binary, size int, present int, opened_ts timestamp, "
    f"src_ip string, src_port int, recv_ts timestamp, payload binary, pieces array<{PIECE}>"
)


def datagram_of(k: Column, slot: Column, count: Column, content: Column) -> Column:
    """The chunk datagram again: two fixed bytes, id, number, count, content."""
    def byte(number: Column) -> Column:
        return F.unhex(F.lpad(F.hex(number), 2, "0"))

    return F.concat(F.lit(CHUNK_MAGIC), F.unhex(F.substring(k, 1, 16)), byte(slot), byte(count), content)


def reassemble_chunks(chunks: DataFrame, key: tuple[str, ...] = ("chunk_id",), **options) -> DataFrame:
    """Join chunks to messages.

    Takes classified chunk rows (``count`` below 2 is ignored here). Gives one row per group or
    ignored arrival: ``status`` complete, expired or ignored, ``chunk_id``, ``size``, ``present``, ``opened_ts``, and for
    complete groups ``payload`` with the ``src_ip``, ``src_port``, ``recv_ts`` of the chunk that
    completed it. Others have ``pieces``: each chunk that filled a slot, or the ignored one, with its own sender and datagram.
    Stage ``chunks`` as a table first where it is costly to compute: it is read for
    the ids, for the arrival facts and for the contents.
    """
    arrivals = arrivals_of(chunks, key)
    hot = hot_ids(arrivals, options.get("hot_rows", HOT_ROWS))
    pieces = assign_arrivals(arrivals, hot=hot, **options)
    return assembled(winners(pieces, arrivals, hot), arrivals_of(chunks, key, "content"))


#: What a row of pieces says of its group.
_OF_GROUP = ("k", "scope", "n", "opened", "size", "present", "closed", "closed_ip", "closed_port")


def winners(pieces: DataFrame, arrivals: DataFrame, hot: DataFrame) -> DataFrame:
    """``pieces`` with one row for equal ignored arrivals, ``copies`` of them, which are groups of their own (``one``) with their sender as closing one."""
    ignored = pieces.where(F.col("status") == IGNORED)
    if not hot.isEmpty():
        ignored = _each_sender(ignored, arrivals.join(hot, "k", "left_semi")).select(*pieces.columns)
    ignored = ignored.withColumns({"closed": F.col("t"), "closed_ip": F.col("src_ip"), "closed_port": F.col("src_port")})
    ignored = ignored.groupBy(*[c for c in pieces.columns if c != "copies"]).agg(F.sum("copies").alias("copies"))
    one = F.struct("slot", "count", "h")
    groups = pieces.where(F.col("status") != IGNORED).withColumns({"copies": F.lit(1).cast("bigint"), "one": F.when(F.lit(False), one)})
    return groups.unionByName(ignored.withColumn("one", one))


def assembled(rows: DataFrame, contents: DataFrame) -> DataFrame:
    """Groups of ``rows`` (of ``winners``) with their ``contents`` (of ``arrivals_of``), which are joined and grouped once.

    Rows that ``nested.unfold`` has put in the place of others name the arrival that holds their bytes, and where those go.
    """
    unfolded = "at_k" in rows.columns
    of = dict(zip(("k", "t", "seqno", "count", "src_ip", "src_port", "h"), ("at_k", "at_t", "at_seqno", "at_count", "at_ip", "at_port", "at_h") if unfolded else ("k", "t", "slot", "count", "src_ip", "src_port", "h")))
    contents = contents.select(*[F.col(c).alias(f"c_{c}") for c in of], "content")
    same = F.lit(True)
    for c, name in of.items():
        same = same & (rows[name].eqNullSafe(contents[f"c_{c}"]) if c in ("src_ip", "src_port") else rows[name] == contents[f"c_{c}"])
    joined = rows.join(contents, same, "left")
    pos, content = F.lit(0).cast("bigint"), F.coalesce("content", F.lit(b""))
    if unfolded:
        pos, content = F.col("pos"), F.substr(content, F.col("skip") + 1, F.octet_length(content))

    def datagram(k, part, content) -> Column:
        whole = datagram_of(k, part["slot"], part["count"], content)
        return F.struct(part["src_ip"].alias("src_ip"), part["src_port"].alias("src_port"), F.timestamp_micros(part["t"]).alias("recv_ts"), whole.alias("payload"))

    def whole(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(b""), lambda done, part: F.concat(done, part["content"]))

    # A set, as the same datagram may have arrived twice in the same microsecond.
    filled = F.when(F.col("slot").isNotNull(), F.struct("slot", pos.alias("pos"), content.alias("content"), "t", "count", "src_ip", "src_port"))
    parts = F.array_sort(F.collect_set(filled))
    done = F.col("status") == COMPLETE
    if unfolded:
        # Of several rows for a slot the first one stands for it.
        slots = F.filter("parts", lambda part: part["pos"] == 0)
        slots = F.filter(slots, lambda part, i: (i == 0) | (F.get(slots, i - 1)["slot"] != part["slot"]))
        pieces = F.transform(slots, lambda slot: datagram(F.col("k"), slot, whole(F.filter("parts", lambda part: part["slot"] == slot["slot"]))))
    else:
        pieces = F.transform("parts", lambda part: datagram(F.col("k"), part, part["content"]))
    groups = joined.groupBy("status", *_OF_GROUP, "one", "copies").agg(parts.alias("parts")).select(
        "status", *_OF_GROUP, F.when(done, whole(F.col("parts"))).alias("payload"), F.when(~done, pieces).cast(f"array<{PIECE}>").alias("pieces"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")),
    )
    return groups.select(
        "status",
        F.unhex(F.substring("k", 1, 16)).alias("chunk_id"),
        "size",
        "present",
        F.timestamp_micros("opened").alias("opened_ts"),
        F.col("closed_ip").alias("src_ip"),
        F.col("closed_port").alias("src_port"),
        F.timestamp_micros("closed").alias("recv_ts"),
        "payload",
        "pieces",
    )


def expired_chunks(groups: DataFrame) -> DataFrame:
    """Groups that never filled up: id, slots filled, slots announced."""
    return groups.where(F.col("status") == EXPIRED).select("chunk_id", "present", "size", "opened_ts")
