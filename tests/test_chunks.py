import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logkiln import catalog as C
from logkiln.operators.chunks import expired_chunks, reassemble_chunks
from logkiln.operators.packets import classify_packets

UTC = dt.timezone.utc
T0 = dt.datetime(2026, 1, 1, tzinfo=UTC)


def chunk(cid, seqno, count, content, at, ip="10.0.0.1", port=1):
    payload = bytes([0x1E, 0x0F]) + cid.to_bytes(8, "big") + bytes([seqno, count]) + content
    return ("gelf", ip, port, T0 + dt.timedelta(seconds=at), bytearray(payload))


def groups(spark, rows, **options):
    chunks = classify_packets(spark.createDataFrame(rows, C.DATAGRAM)).where("kind = 'chunk'")
    out = reassemble_chunks(chunks, **options).withColumns(
        {"opened": F.unix_micros("opened_ts"), "closed": F.unix_micros("recv_ts")}
    )
    return sorted(
        (
            int.from_bytes(r.chunk_id, "big"), r.opened - int(T0.timestamp()) * 10**6, r.status, r.size, r.present,
            None if r.closed is None else r.closed - int(T0.timestamp()) * 10**6, r.src_ip,
            None if r.payload is None else bytes(r.payload),
        )
        for r in out.collect()
    )


def brief(rows):
    return [(r[2], r[3], r[4], r[6], r[7]) for r in rows]


def simulate(rows):
    """The rules, one datagram at a time."""
    out, open_groups = [], {}
    def us(r):
        return int((r[3] - T0).total_seconds() * 10**6 + 0.5)

    arrivals = sorted(rows, key=lambda r: (us(r), r[4][10], r[4][11], r[1], r[2]))
    for r in arrivals:
        cid, seqno, count, content = int.from_bytes(r[4][2:10], "big"), r[4][10], r[4][11], bytes(r[4][12:])
        if count < 2:
            continue
        g = open_groups.get(cid)
        if g and us(r) - g[0] > 5_000_000:
            out.append((cid, g[0], "expired", g[1], len(g[2]), None, None, None))
            g = None
        if g is None:
            g = open_groups[cid] = (us(r), count, {})
        if seqno < g[1]:
            g[2][seqno] = content
        if len(g[2]) == g[1]:
            out.append((cid, g[0], "complete", g[1], g[1], us(r), r[1], b"".join(g[2][i] for i in range(g[1]))))
            del open_groups[cid]
        elif seqno >= g[1]:
            out.append((cid, g[0], "ignored", g[1], len(g[2]), us(r), r[1], None))
    out += [(cid, g[0], "expired", g[1], len(g[2]), None, None, None) for cid, g in open_groups.items()]
    return sorted(out, key=str)


def test_rules(spark):
    rows = [
        # joined by number, not by arrival; source is the completing one
        chunk(1, 1, 2, b"B", 0.0, "10.0.0.1"), chunk(1, 0, 2, b"A", 1.0, "10.0.0.2"),
        # the opener fixes the size; a number past it is ignored; last copy wins
        chunk(2, 0, 2, b"x", 0), chunk(2, 5, 9, b"no", 1), chunk(2, 0, 2, b"X", 2), chunk(2, 1, 9, b"Y", 3),
        # alive at exactly five seconds, not after; the anchor is the first chunk
        chunk(3, 0, 2, b"p", 0), chunk(3, 1, 2, b"q", 5.0),
        chunk(4, 0, 3, b"p", 0), chunk(4, 1, 3, b"q", 4), chunk(4, 2, 3, b"r", 5.000001),
        # an id may be used again once its message is complete
        chunk(5, 0, 2, b"1", 0), chunk(5, 1, 2, b"2", 1), chunk(5, 0, 2, b"3", 2), chunk(5, 1, 2, b"4", 3),
        # a number past the size may open a group
        chunk(6, 7, 2, b"no", 0),
        # too few chunks announced: never opens one
        chunk(7, 0, 1, b"one", 0),
        # empty contents are contents
        chunk(8, 0, 2, b"", 0), chunk(8, 1, 2, b"z", 1),
        # the same datagram twice at once
        chunk(9, 0, 2, b"s", 0), chunk(9, 0, 2, b"s", 0), chunk(9, 1, 2, b"t", 1),
    ]
    out = groups(spark, rows)
    by_id = {}
    for r in out:
        by_id.setdefault(r[0], []).append((r[2], r[3], r[4], r[6], r[7]))
    assert by_id == {
        1: [("complete", 2, 2, "10.0.0.2", b"AB")],
        2: [("complete", 2, 2, "10.0.0.1", b"XY"), ("ignored", 2, 1, "10.0.0.1", None)],
        3: [("complete", 2, 2, "10.0.0.1", b"pq")],
        4: [("expired", 3, 2, None, None), ("expired", 3, 1, None, None)],
        5: [("complete", 2, 2, "10.0.0.1", b"12"), ("complete", 2, 2, "10.0.0.1", b"34")],
        6: [("expired", 2, 0, None, None), ("ignored", 2, 0, "10.0.0.1", None)],
        8: [("complete", 2, 2, "10.0.0.1", b"z")],
        9: [("complete", 2, 2, "10.0.0.1", b"st")],
    }


def test_source_can_be_part_of_the_key(spark):
    rows = [chunk(1, 0, 2, b"a", 0, "10.0.0.1"), chunk(1, 0, 2, b"c", 0.1, "10.0.0.2"),
            chunk(1, 1, 2, b"b", 0.2, "10.0.0.1"), chunk(1, 1, 2, b"d", 0.3, "10.0.0.2")]
    assert sorted(r[7] for r in groups(spark, rows, key=("chunk_id", "src_ip"))) == [b"ab", b"cd"]
    assert sorted(str(r[7]) for r in groups(spark, rows)) == ["None", "b'cb'"]


def busy_stream(seed):
    rng = random.Random(seed)
    rows, now = [], 0.0
    for i in range(1500):
        now += rng.choice([0, 0.001, 0.01, 0.2, 0.2, 0.5, 1.1, 7.0]) if rng.random() < 0.7 else 0
        cid = 1 if rng.random() < 0.7 else rng.randrange(2, 30)
        count = rng.choice([2, 2, 3, 4])
        rows.append(chunk(cid, rng.randrange(count + (rng.random() < 0.1)), count, str(i).encode(), round(now, 6), f"10.0.0.{rng.randrange(3)}", i))
    return rows


def periodic_stream():
    # Without pauses and out of step with every block: nothing ever brings two entries together.
    rows = [chunk(1, i % 4, 4, str(i).encode(), 0.37 * i + 0.1, port=i) for i in range(1, 1400)]
    return rows + [chunk(2, i % 2, 2, str(i).encode(), 400 + i * 0.5, port=i) for i in range(20)]


@pytest.mark.parametrize("rows", [busy_stream(1), busy_stream(2), periodic_stream()], ids=["busy1", "busy2", "periodic"])
@pytest.mark.parametrize(
    "options",
    [{}, {"hot_rows": 0, "block_seconds": 6}, {"hot_rows": 50, "block_seconds": 11}, {"hot_rows": 0, "block_seconds": 7, "fan_in": 2},
     {"hot_rows": 0, "block_seconds": 60, "block_rows": 40, "fan_in": 3}],
    ids=["one scan", "all ids in blocks", "hot ids in blocks", "two maps at a time", "blocks by rows"],
)
def test_like_one_datagram_at_a_time(spark, rows, options):
    assert sorted(groups(spark, rows, **options), key=str) == simulate(rows)


def test_ignored_copies_of_a_hot_id_keep_number_and_sender(spark):
    rows = [chunk(1, 0, 4, b"a", 0), chunk(1, 1, 4, b"b", 0.1), chunk(1, 2, 4, b"c", 0.2)]
    # The first of these completes the group; the others open one of two slots and lie past it.
    rows += [chunk(1, 3, 2, b"d", 0.3, f"10.0.0.{i}", i) for i in (1, 2, 3, 4, 4, 5)]
    # All of these are ignored.
    rows += [chunk(2, 0, 2, b"a", 0)] + [chunk(2, 7, 2, b"x", 0.1, f"10.0.1.{i}") for i in (1, 1, 2, 3, 3)]
    # An id whose copies differ in nothing.
    rows += [chunk(3, 9, 2, b"x", 0) for _ in range(4)]
    plain = sorted(groups(spark, rows), key=str)
    assert plain == simulate(rows) and sum(r[2] == "ignored" for r in plain) == 14
    assert sorted(groups(spark, rows, hot_rows=0, block_seconds=6), key=str) == plain


def test_expired_view(spark):
    chunks = classify_packets(spark.createDataFrame([chunk(3, 0, 3, b"a", 0)], C.DATAGRAM))
    row = expired_chunks(reassemble_chunks(chunks)).first()
    assert (bytes(row.chunk_id), row.present, row.size) == ((3).to_bytes(8, "big"), 1, 3)
