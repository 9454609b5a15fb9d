import datetime as dt
import json
import random
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.plans.ingest import decode_datagrams, ingest
from logkiln.sources.datagrams import read_datagrams
from logkiln.sources.log_table import read_ingested_logs, read_quarantine
from logkiln.streaming.chunks import ChunkGroups
from logkiln.streaming.ingest import start_ingest
from test_chunks import T0, chunk

HEAD = b'{"version":"1.1","host":"h","short_message":"'


def message(text):
    return HEAD + text + b'","timestamp":1767225600}'


def plain(text, at):
    return ("gelf", "10.0.0.9", 1, T0 + dt.timedelta(seconds=at), bytearray(message(text)))


def syslog(line, at):
    return ("syslog", "10.0.0.8", 1, T0 + dt.timedelta(seconds=at), bytearray(line))


def halves(cid, text, at, gap):
    body = message(text)
    return [chunk(cid, 0, 2, body[:20], at), chunk(cid, 1, 2, body[20:], at + gap)]


FILES = [
    [plain(b"one", 0), syslog(b"<13>Jan  1 00:00:01 a x: hello", 1), *halves(1, b"joined", 0, 1), halves(2, b"split", 2, 3)[0]],
    [halves(2, b"split", 2, 3)[1], halves(3, b"late", 5, 6)[0], syslog(b"", 6), plain(b"", 6), chunk(4, 5, 2, b"past", 6)],
    [halves(3, b"late", 5, 6)[1], chunk(5, 0, 1, b"x", 12), plain(b"two", 13)],
    # Later traffic moves the clock past the end of every open group.
    [plain(b"three", 60)],
    [plain(b"four", 120)],
]


def both(logs, refused):
    return (
        sorted((r.hostname, r.message) for r in logs.collect()),
        sorted((r.stage, r.reason, r.payload is not None) for r in refused.collect()),
    )


def test_stream_gives_what_the_batch_gives(spark):
    folder = tempfile.mkdtemp(prefix="run-stream-")
    for rows in FILES:
        spark.createDataFrame(rows, C.DATAGRAM).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    seen = []
    query = start_ingest(
        spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", interval=None, max_files=1,
        on_stats=lambda i, s: seen.append((i, s)),
    )
    query.awaitTermination(240)
    assert query.exception() is None
    streamed = both(read_ingested_logs(spark, f"{folder}/out"), read_quarantine(spark, f"{folder}/out"))

    data = read_datagrams(spark, f"{folder}/in")
    ingest(data, f"{folder}/batch")
    assert streamed == both(read_ingested_logs(spark, f"{folder}/batch"), read_quarantine(spark, f"{folder}/batch"))
    assert streamed[0] == [("a", "hello"), *[("h", m) for m in ("four", "joined", "one", "split", "three", "two")]]
    assert [r[:2] for r in streamed[1]] == [
        ("chunk", "chunk_count"), ("chunk", "chunk_seqno"), ("chunk", "expired"), ("chunk", "expired"),
        ("valid", "no_message"), ("valid", "no_message"),
    ]
    assert sum(s["records"] for _, s in seen) == 7

    # A run that is repeated leaves one copy; another run adds.
    for run, n in (("a", 14), ("a", 14), ("b", 21)):
        ingest(data, f"{folder}/batch", run=run)
        assert read_ingested_logs(spark, f"{folder}/batch").count() == n


def test_late_chunks_are_worked(spark):
    """Messages that are read minutes after later ones, also a piece at a time, and before a newer use of their id."""
    first, second = halves(8, b"parted", 2, 1)
    newer = halves(6, b"newer", 103, 1)
    files = [
        *[[plain(b"now", 100 + i)] for i in range(3)], halves(7, b"whole", 0, 1), [first], [second], halves(9, b"half", 3, 1)[:1],
        newer[:1], halves(6, b"older", 4, 1), newer[1:], [plain(b"then", 200)], [plain(b"end", 300)],
    ]
    folder = tempfile.mkdtemp(prefix="run-stream-")
    for rows in files:
        spark.createDataFrame(rows, C.DATAGRAM).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = start_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", interval=None, max_files=1)
    query.awaitTermination(240)
    assert query.exception() is None
    streamed = both(read_ingested_logs(spark, f"{folder}/out"), read_quarantine(spark, f"{folder}/out"))
    ingest(read_datagrams(spark, f"{folder}/in"), f"{folder}/batch")
    assert streamed == both(read_ingested_logs(spark, f"{folder}/batch"), read_quarantine(spark, f"{folder}/batch"))
    assert [m for _, m in streamed[0]] == ["end", "newer", "now", "now", "now", "older", "parted", "then", "whole"]
    assert [r[:2] for r in streamed[1]] == [("chunk", "expired")]


def test_reading_when_nothing_was_refused_or_nothing_kept(spark):
    folder = tempfile.mkdtemp(prefix="run-stream-")
    data = spark.createDataFrame([r for rows in FILES for r in rows], C.DATAGRAM).where("proto = 'syslog'")
    ingest(data, f"{folder}/good")
    assert read_ingested_logs(spark, f"{folder}/good").count() + read_quarantine(spark, f"{folder}/good").count() == data.count()
    ingest(data.where("false"), f"{folder}/none")
    assert read_ingested_logs(spark, f"{folder}/none").count() == read_quarantine(spark, f"{folder}/none").count() == 0


def test_chunks_inside_a_chunked_message(spark):
    def wrapped(outer, inner, at):
        raw = bytes(inner[4])
        return [chunk(outer, 0, 2, raw[:30], at), chunk(outer, 1, 2, raw[30:], at + 0.1)]

    a, b = halves(9, b"deep", 0, 1)
    rows = wrapped(20, a, 0) + wrapped(21, b, 1)
    data = spark.createDataFrame(rows, C.DATAGRAM)
    got = decode_datagrams(data).select("message", "reason").collect()
    assert [(r.message, r.reason) for r in got] == [("deep", None)]


def test_chunks_of_plain_and_wrapped_pieces_at_any_depth(spark):
    """Against one datagram at a time, where a message that is a chunk goes back in at once."""
    rng = random.Random(4)
    rows = []
    for m in range(30):
        # Each level sends its first piece plainly and cuts the datagram of its second one in two again.
        body, at = message(b"m%d " % m + bytes(rng.choices(b"abc", k=rng.randint(0, 90)))), m * 40.0
        for level in range(rng.randint(1, 7)):
            cut = rng.randint(1, len(body) - 1)
            first, second = (chunk(1000 * level + m, i, 2, part, 0) for i, part in enumerate((body[:cut], body[cut:])))
            sent, body = (first, bytes(second[4])) if rng.random() < 0.5 else (second, bytes(first[4]))
            rows.append((*sent[:3], T0 + dt.timedelta(seconds=at + rng.choice([0, 1, 2, 3, 9]) + level * 0.01), sent[4]))
        rows.append(("gelf", "10.0.0.9", 1, T0 + dt.timedelta(seconds=at + 4), bytearray(body)))
    open_groups, shown = {}, []

    def take(t, ip, payload):
        if payload[:2] != b"\x1e\x0f":
            return shown.append((ip, json.loads(payload)["short_message"]))
        cid, seqno, count, content = payload[2:10], payload[10], payload[11], payload[12:]
        opened, slots = open_groups.get(cid, (t, {}))
        if t - opened > 5:
            opened, slots = t, {}
        slots[seqno] = content
        open_groups[cid] = (opened, slots)
        if len(slots) == count:
            del open_groups[cid]
            take(t, ip, b"".join(slots[i] for i in range(count)))

    for r in sorted(rows, key=lambda r: r[3]):
        take((r[3] - T0).total_seconds(), r[1], bytes(r[4]))
    got = decode_datagrams(spark.createDataFrame(rows, C.DATAGRAM)).where("reason is null").select("src_ip", "message").collect()
    assert sorted((r.src_ip, r.message) for r in got) == sorted(shown) and 5 < len(shown) < 30


def test_refused_chunks_keep_sender_and_bytes(spark):
    rows = [
        chunk(1, 0, 3, b"a", 0, "10.0.0.1"), chunk(1, 1, 3, b"old", 1, "10.0.0.2"), chunk(1, 1, 3, b"new", 2, "10.0.0.3"),
        chunk(2, 9, 2, b"past", 0, "10.0.0.4", 7), chunk(3, 0, 1, b"lone", 0, "10.0.0.5"), chunk(4, 0, 2, b"", 0, "10.0.0.6"),
    ]
    folder = tempfile.mkdtemp(prefix="run-stream-")
    for part in (rows[:2], rows[2:], [plain(b"later", 100)], [plain(b"last", 200)]):
        spark.createDataFrame(part, C.DATAGRAM).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    want = sorted([(r, rows[k][1], bytes(rows[k][4])) for r, k in (("expired", 0), ("expired", 2), ("chunk_seqno", 3), ("chunk_count", 4), ("expired", 5))])

    def of(refused):
        return sorted((r.reason, r.src_ip, bytes(r.payload)) for r in refused.collect())

    assert of(decode_datagrams(read_datagrams(spark, f"{folder}/in")).where("reason is not null")) == want
    query = start_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", interval=None, max_files=1)
    query.awaitTermination(240)
    assert of(read_quarantine(spark, f"{folder}/out")) == want


def test_open_groups_outlive_a_restart(spark):
    """Each start takes in one part: slots that an earlier run filled are kept, and one may be filled anew."""
    body = message(b"restarted")
    parts = [
        [chunk(1, 0, 3, body[:10], 0), chunk(1, 1, 3, b"wrong", 0.5)],
        [chunk(1, 1, 3, body[10:20], 1), plain(b"between", 1)],
        [chunk(1, 2, 3, body[20:], 2), chunk(2, 0, 2, b"x", 2)],
        [plain(b"later", 100)],
        [plain(b"last", 200)],
    ]
    folder = tempfile.mkdtemp(prefix="run-stream-")
    for part in parts:
        spark.createDataFrame(part, C.DATAGRAM).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        query = start_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", interval=None)
        query.awaitTermination(240)
        assert query.exception() is None
    logs, refused = both(read_ingested_logs(spark, f"{folder}/out"), read_quarantine(spark, f"{folder}/out"))
    assert [m for _, m in logs] == ["between", "last", "later", "restarted"]
    assert refused == [("chunk", "expired", True)]


def test_a_batch_writes_few_files_a_day(spark):
    """Lines of two days that many tasks hold end up in a file or two for each day, with every line there."""
    folder = tempfile.mkdtemp(prefix="run-stream-")
    lines = spark.range(0, 400, 1, 16).select(
        F.lit("syslog").alias("proto"), F.lit("10.0.0.8").alias("src_ip"), F.lit(1).alias("src_port"),
        F.lit(T0).cast("timestamp").alias("recv_ts"),
        F.concat(F.lit("<13>2026-01-0"), (F.col("id") % 2 + 1).cast("string"), F.lit("T00:00:01Z a x: "), F.col("id").cast("string")).cast("binary").alias("payload"),
    )
    lines.write.parquet(f"{folder}/in")
    start_ingest(spark, f"{folder}/in", f"{folder}/out", f"{folder}/checkpoint", interval=None).awaitTermination()
    logs = spark.read.parquet(f"{folder}/out")
    assert logs.count() == 400
    assert logs.select(F.col("_metadata.file_path")).distinct().count() <= 4


class Kept(dict):
    """A state of Spark's as a dict that counts calls; a value state has one entry."""

    calls = 0

    def get(self, key=None):
        Kept.calls += 1
        return super().get(key)

    getValue = get

    def update(self, value):
        Kept.calls += 1
        self[None] = value

    def updateValue(self, key, value):
        Kept.calls += 1
        self[key] = value

    def removeKey(self, key):
        Kept.calls += 1
        del self[key]

    def iterator(self):
        Kept.calls += 1
        return list(self.items())


class Handle:
    """What a processor keeps its state by, without Spark."""

    def __init__(self):
        self.states, self.timers = {}, set()

    def getMapState(self, name, *schemas):
        return self.states.setdefault(name, Kept())

    getValueState = getMapState

    def registerTimer(self, at):
        Kept.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        Kept.calls += 1
        self.timers.remove(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms

    getExpiryTimeInMs = getCurrentWatermarkInMs


def in_bucket(batches, lifetime_us=5_000_000):
    """The rows of a bucket's micro-batches, each a watermark (ms) and chunks (k, t, seqno, count, content); the handle, and the state calls of each."""
    groups, handle, rows, calls = ChunkGroups(lifetime_us), Handle(), [], []
    groups.init(handle)
    for ms, chunks in batches:
        Kept.calls = 0
        frame = pd.DataFrame([(k, t, n, c, "10.0.0.1", 1, k.encode(), body, hash(body)) for k, t, n, c, body in chunks], columns="k t seqno count src_ip src_port chunk_id content h".split())
        rows += [r for out in groups.handleInputRows((0,), iter([frame]), At(ms)) for r in out.itertuples()] if chunks else []
        while handle.timers and min(handle.timers) <= ms:
            due = min(handle.timers)
            rows += [r for out in groups.handleExpiredTimer((0,), At(ms), At(due)) for r in out.itertuples()]
            handle.timers.discard(due)
        calls.append(Kept.calls)
    return rows, handle, calls


def test_state_calls_do_not_grow_with_whole_messages():
    """Many ids share a bucket, and those that are whole within a micro-batch cost no call of their own."""
    chunks = [(f"{i:08d}", i, n, 3, b"%d-%d" % (i, n)) for i in range(2000) for n in range(3)]
    rows, handle, calls = in_bucket([(0, chunks)])
    assert calls[0] <= 3 and not handle.timers
    assert sorted(r.payload for r in rows) == sorted(b"".join(b"%d-%d" % (i, n) for n in range(3)) for i in range(2000))


def test_ids_of_a_bucket_like_one_chunk_at_a_time():
    """Groups that go on over micro-batches, expire, are late, begin with a number past their size, or fill a slot anew."""
    rng = random.Random(8)
    sent = []
    for i in range(120):
        start, count = rng.randrange(0, 60_000_000, 1000), rng.randint(2, 5)
        for n in range(count):
            for _ in range(rng.choice([0, 1, 1, 1, 1, 2])):
                seqno = n if rng.random() < 0.95 else count + 1
                sent.append((f"{i % 90:08d}", start + rng.choice([0, 1000, 1_000_000, 4_000_000, 6_000_000]) + len(sent), seqno, count, b"%d" % rng.randrange(1 << 30)))
    sent.sort(key=lambda c: c[1])
    batches = [sent[at : at + 40] for at in range(0, len(sent), 40)]
    # The clock stands at the last time of the batch before; nothing is late.
    clocks = [0, *[b[-1][1] // 1000 for b in batches]]
    got, handle, _ = in_bucket([*zip(clocks, batches), (10**9, [])])
    want, groups = [], {}

    def give_up(k):
        t, size, slots = groups.pop(k)
        want.append(("expired", k, t, tuple(slots[n] for n in sorted(slots))))

    for k, t, seqno, count, body in sent:
        if k in groups and t > groups[k][0] + 5_000_000:
            give_up(k)
        opened, size, slots = groups.setdefault(k, (t, count, {}))
        if seqno >= size:
            want.append(("ignored", k, opened, (body,)))
            continue
        slots[seqno] = body
        if len(slots) == size:
            want.append(("complete", k, opened, (b"".join(slots[n] for n in range(size)),)))
            del groups[k]
    for k in [*groups]:
        give_up(k)
    rows = [(r.status, bytes(r.chunk_id).decode(), round(r.opened_ts.timestamp() * 1e6), (r.payload,) if r.pieces is None else tuple(p["payload"][12:] for p in r.pieces)) for r in got]
    assert sorted(rows) == sorted(want) and {s for s, *_ in want} == {"expired", "ignored", "complete"}
    assert not any(handle.states.values()) and not handle.timers
