"""Chunked messages that are chunks again, against the rules applied to one datagram at a time."""

import datetime as dt
import random

from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.operators import nested
from logkiln.plans import ingest

T0 = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
START = int(T0.timestamp()) * 10**6
MAGIC = bytes([0x1E, 0x0F])


def datagram(cid, seqno, count, content):
    return MAGIC + cid.to_bytes(8, "big") + bytes([seqno, count]) + content


def row(data, us, ip="a", port=1):
    return ("gelf", ip, port, T0 + dt.timedelta(microseconds=us), bytearray(data))


def plain_groups(arrivals):
    """(cid, status, closed, ip, port, pieces) of arrivals (cid, t, seqno, count, ip, port, content); pieces are (slot, arrival)."""
    out, groups = [], {}
    none = lambda x: (x is not None, x or 0)
    for a in sorted(arrivals, key=lambda a: (a[0], a[1], a[2], a[3], (a[4] is not None, a[4] or ""), none(a[5]))):
        cid, t, seqno, count, ip, port, _ = a
        g = groups.get(cid)
        if g and t > g[0] + 5_000_000:
            out.append((cid, "expired", None, None, None, list(g[2].items())))
            g = None
        if g is None:
            g = groups[cid] = (t, count, {})
        if seqno >= g[1]:
            out.append((cid, "chunk_seqno", None, None, None, [(seqno, a)]))
            continue
        g[2][seqno] = a
        if len(g[2]) == g[1]:
            out.append((cid, None, t, ip, port, sorted(g[2].items())))
            del groups[cid]
    return out + [(cid, "expired", None, None, None, list(g[2].items())) for cid, g in groups.items()]


def plain_packets(rows):
    """Packets (ip, port, t, payload, reason), with inner chunks found round by round."""
    taken = [((p := bytes(r[4]))[2:10], int((r[3] - T0) / dt.timedelta(microseconds=1)), p[10], p[11], r[1], r[2], p[12:]) for r in rows]
    inner = None
    while True:
        groups = plain_groups([a for a in taken if a[3] >= 2] + (inner or []))
        found, out = [], [(a[4], a[5], a[1], datagram(int.from_bytes(a[0], "big"), a[2], a[3], a[6]), "chunk_count") for a in taken if a[3] < 2]
        for cid, reason, t, ip, port, pieces in groups:
            if reason is None:
                p = b"".join(a[6] for _, a in pieces)
                if p[:2] == MAGIC and len(p) >= 12 and p[11] >= 2:
                    found.append((p[2:10], t, p[10], p[11], ip, port, p[12:]))
                else:
                    out.append((ip, port, t, p, "chunk_count" if p[:2] == MAGIC and len(p) >= 12 else None))
            else:
                out += [(a[4], a[5], a[1], datagram(int.from_bytes(cid, "big"), slot, a[3], a[6]), reason) for slot, a in pieces]
        if sorted(found, key=str) == sorted(inner or [], key=str):
            return sorted(map(str, out))
        inner = found


def packets(spark, rows, **options):
    out = ingest.assemble(spark.createDataFrame(rows, C.DATAGRAM).repartition(3), **options).withColumn("us", F.unix_micros("recv_ts") - START)
    return sorted(str((r.src_ip, r.src_port, r.us, bytes(r.payload), r.chunk_reason)) for r in out.collect())


def sent(seed, ids, messages, depth):
    """Messages cut in chunks, of which some are sent in chunks again; some get lost, and no two come at once."""
    r, out = random.Random(seed), []

    def send(data, depth, at):
        cid, k = r.randrange(1, ids), r.choice([2, 2, 3, 12])
        most = len(data) if r.random() < 0.5 else min(len(data), 30)
        cuts = sorted(r.randrange(0, most + 1) for _ in range(k - 1))
        for i, part in enumerate(data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)])):
            if r.random() < 0.01:
                continue
            count = k if r.random() > 0.01 else r.randrange(6)
            d = datagram(cid, i if r.random() > 0.01 else r.randrange(30), count, part)
            if depth and r.random() < 0.6:
                send(d, depth - 1, at + r.randrange(10**6))
            else:
                out.append(row(d, (at + r.randrange(10**6)) // 10**5 * 10**5 + len(out) % 10**5, r.choice(["a", "b", None]), r.choice([1, 2, None])))

    for m in range(messages):
        send(b'{"n": %d, "x": "%s"}' % (m, b"y" * r.randrange(60)), r.randrange(depth + 1), m * 10**5)
    return out


def test_like_one_datagram_at_a_time(spark):
    rows = sent(3, 1 << 50, 25, 2)
    assert packets(spark, rows) == plain_packets(rows)


def whole(data, levels, us, cut):
    """``data`` in chunks, of which the first is sent in chunks again, ``levels`` times, and the last time in pieces of ``cut`` bytes."""
    pieces = [data]
    for level in range(levels):
        inside = datagram(us * 100 + level, 0, 2, pieces[0][: len(pieces[0]) // 2]), datagram(us * 100 + level, 1, 2, pieces[0][len(pieces[0]) // 2 :])
        pieces = [inside[0], *pieces[1:], inside[1]]
    first = pieces[0]
    parts = [first[i : i + cut] for i in range(0, len(first), cut)]
    pieces = [datagram(us * 100 + 99, i, len(parts), p) for i, p in enumerate(parts)] + pieces[1:]
    return [row(p, us * 1000 + i) for i, p in enumerate(pieces)]


def test_headers_behind_each_other(spark, monkeypatch):
    """Heads that a row knows, and those that lie across many small pieces or too deep."""
    data = b'{"x": "' + b"y" * 400 + b'"}'
    rows = whole(data, 3, 1, 40) + whole(data, 2, 2, 5) + whole(data, 3, 3, 7) + whole(data, 1, 4, 13)
    expected = plain_packets(rows)
    assert sum("None)" in x for x in expected) == 4 and len(expected) == 4
    assert packets(spark, rows) == expected
    monkeypatch.setattr(nested, "STACKED", 1)
    assert packets(spark, rows) == expected


def test_contents_are_staged_with_chunks_and_groups_only(spark, monkeypatch):
    """Rounds go over arrival facts, so contents are written twice, not twice a level."""
    staged = []

    def stage(df, write=ingest.stage):
        out = write(df)
        held = [c for c in ("content", "payload") if c in out.columns]
        if held:
            staged.append(out.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in held), F.lit(0)))).first()[0] or 0)
        return out

    for module in (ingest, nested):
        monkeypatch.setattr(module, "stage", stage)
    monkeypatch.setattr(ingest.K, "stage", stage)
    data, rows = b'{"x": "' + b"y" * 3000 + b'"}', []
    rest = data
    for level in range(4):
        rows.append(row(datagram(level + 1, 0, 2, rest[: len(rest) // 2]), level))
        rest = datagram(level + 1, 1, 2, rest[len(rest) // 2 :])
    rows.append(row(rest, 9))
    assert packets(spark, rows) == plain_packets(rows) == [str(("a", 1, 9, data, None))]
    assert sum(staged) < 2.2 * len(data)
