"""Exact repeated byte strings by bucket-pointer refinement.

A byte goes if a string of ``WINDOW`` bytes around it also starts earlier: in a smaller doc_id or earlier in
the same document. Buckets are named, not numbered, so that they are the same on every executor:

1. q-gram buckets. Names of 1, 2, 4, 8 ... 40 bytes come from names at the same and at a later offset (names of each
   length are reused for the next). Of every window of 100 bytes the smallest 40-gram names are its anchors, about
   one position in 31. Any two equal windows have equal anchors, so only buckets with several anchors matter.
2. Refinement by later and earlier offsets: anchors of one bucket are sorted by the name of all that windows around them
   can reach (60 bytes before and behind). Equal ones repeat each other in every window: all but the first are
   settled. If a bucket holds one such name only, so is the first. The others are undecided.
3. Undecided anchors are refined again, window by window: windows get the name of their 40-grams at
   offsets 0, 40 and 60, and all but the first of a bucket are repeats. Surroundings are dealt out by anchor and
   their windows named there, as equal windows have equal anchors.

What a task finds is collapsed there before it is dealt out: a string with a million copies costs a row per
task. An anchor with many different surroundings in some task is marked; all its surroundings are dealt out window
by window instead, by the windows' own names, which spread.
Names have 64 bits of a mixing function; two different strings share one with the odds of 1 in 2**64 a pair.

Defined results: a null or empty text has no bytes; a text shorter than a window loses none; rows that share an id are one
document to each other (equal rows get equal results; offsets found in one hold for all), null ids count as one
id behind all others; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logkiln.llm.common import bound_batches, shuffle_width, utf8
from logkiln.staging import stage

WINDOW, GRAM = 100, 40
_SIDE = WINDOW - GRAM
#: Text that a task collapses at once, text for each shuffle partition, and surroundings of an anchor that it deals out.
_CHUNK, _PART, _FEW = 24 << 20, 16 << 20, 8
_NULL = (1 << 63) - 1
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_ANCHOR = np.dtype([("h", "<u8"), ("sig", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1")])
_WINDOW = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<i4")])
_CONTEXT = np.dtype([("h", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("left", "u1"), ("right", "u1"), ("bytes", "u1", GRAM + 2 * _SIDE)])
_MARK = 0x80  # in "left": an anchor whose windows are dealt out one by one
_RUN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The names of strings from the names of their two parts."""
    x = a * _A + b
    x ^= x >> np.uint64(32)
    x *= _B
    x ^= x >> np.uint64(29)
    return x


def gram_names(data: np.ndarray) -> np.ndarray:
    """Names of the 40-grams at each offset of some bytes; the last 39 offsets have none."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    one = _join(data.astype(np.uint64) + np.uint64(1), _B)
    names = {1: one}
    for k in (1, 2, 4, 8, 16):
        names[2 * k] = _join(names[k][: len(data) - 2 * k + 1], names[k][k:])
    return _join(names[32][: len(data) - GRAM + 1], names[8][32:])


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick (minimum or maximum) over x[i : i + n]."""
    k = 1
    while 2 * k <= n:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[: len(x) - (n - k)], x[n - k :]) if n > k else x


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-gram names of joined documents, and the anchors' offsets; ``ends`` are the documents' ends."""
    names = gram_names(data)
    if len(names) <= _SIDE:
        return names, np.zeros(0, np.int64)
    least = _slide(names, _SIDE + 1, np.minimum)
    for e in ends[:-1]:  # windows that reach across an end are none
        least[max(0, e - WINDOW + 1) : e] = 0
    padded = np.concatenate([np.zeros(_SIDE, np.uint64), least, np.zeros(_SIDE, np.uint64)])
    return names, np.flatnonzero(_slide(padded, _SIDE + 1, np.maximum) == names)


def _runs(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ranges of bytes merged by document."""
    out = np.zeros(len(doc), _RUN)
    out["doc"], out["start"], out["end"] = doc, start, end
    if len(out) < 2:
        return out
    out = out[np.lexsort((out["start"], out["doc"]))]
    # Ends as a running maximum within a document, by a sum that keeps documents apart.
    rank = np.cumsum(np.concatenate([[0], out["doc"][1:] != out["doc"][:-1]])).astype(np.int64) << 32
    reach = np.maximum.accumulate(rank + out["end"])
    new = np.concatenate([[True], rank[1:] + out["start"][1:] > reach[:-1]])
    first = np.flatnonzero(new)
    merged = out[first]
    last = np.concatenate([first[1:] - 1, [len(out) - 1]])
    merged["end"] = (reach[last] - rank[last]).astype(np.int32)
    return merged


def _around(a: np.ndarray) -> np.ndarray:
    return _runs(a["doc"], a["pos"] - a["left"].astype(np.int32), a["pos"] + GRAM + a["right"].astype(np.int32))


def _collapse(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Anchors sorted with one for each surroundings (the first), and those that repeat one."""
    a = a[np.lexsort((a["pos"], a["doc"], a["sig"], a["h"]))]
    same = np.concatenate([[False], (a["h"][1:] == a["h"][:-1]) & (a["sig"][1:] == a["sig"][:-1])])
    # The same place twice is one place.
    place = np.concatenate([[True], (a["doc"][1:] != a["doc"][:-1]) | (a["pos"][1:] != a["pos"][:-1])])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(a))))
    origin = (a["doc"] == a["doc"][first]) & (a["pos"] == a["pos"][first])
    return a[~same], a[same & place & ~origin]


def _kinds(a: np.ndarray) -> np.ndarray:
    """For sorted anchors, how many share each one's bucket."""
    _, where, n = np.unique(a["h"], return_inverse=True, return_counts=True)
    return n[where]


def _first_windows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = w[np.lexsort((w["pos"], w["doc"], w["h"]))]
    same = np.concatenate([[False], w["h"][1:] == w["h"][:-1]])
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(w))))
    origin = (w["doc"] == w["doc"][first]) & (w["pos"] == w["pos"][first])
    return w[~same], w[same & ~origin]


_DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])
_FOUND = pa.schema([("doc", pa.int64()), ("kind", pa.string()), ("data", pa.binary())])


def _deal(records: np.ndarray, kind: str, buckets: int) -> pa.RecordBatch:
    """Packed records by bucket, a row each."""
    key = (records["h"] >> np.uint64(20)) % np.uint64(buckets) if "h" in records.dtype.names else records["doc"].astype(np.uint64) % np.uint64(buckets)
    order = np.argsort(key, kind="stable")
    records, key = records[order], key[order]
    edges = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    parts = np.split(records, edges[1:]) if len(edges) else []
    return pa.RecordBatch.from_arrays([pa.array(key[edges].astype(np.int32)), pa.array([kind] * len(parts), pa.string()), pa.array([p.tobytes() for p in parts], pa.binary())], schema=_DEALT)


def _by_doc(runs: np.ndarray, kind: str) -> pa.RecordBatch:
    runs = runs[np.argsort(runs["doc"], kind="stable")]
    edges = np.flatnonzero(np.concatenate([[True], runs["doc"][1:] != runs["doc"][:-1]])) if len(runs) else np.zeros(0, np.int64)
    parts = np.split(runs, edges[1:]) if len(edges) else []
    data = [np.stack([p["start"], p["end"]], axis=1).astype("<i4").tobytes() for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(runs["doc"][edges], pa.int64()), pa.array([kind] * len(parts), pa.string()), pa.array(data, pa.binary())], schema=_FOUND)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= _CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _map_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            made = []
            for b in chunk:
                texts = b.column(1).to_pylist()
                data = np.frombuffer(b"".join(texts), np.uint8)
                ends = np.cumsum([len(t) for t in texts])
                names, at = anchors(data, ends)
                if not len(at):
                    continue
                which = np.searchsorted(ends, at, side="right")
                begin = np.concatenate([[0], ends[:-1]])[which]
                left, right = np.minimum(_SIDE, at - begin), np.minimum(_SIDE, ends[which] - at - GRAM)
                sig = _join(names[at - left], names[at - np.minimum(left, 20)])
                sig = _join(_join(sig, names[at + np.minimum(right, 20)]), names[at + right])
                a = np.zeros(len(at), _ANCHOR)
                a["h"], a["sig"] = names[at], _join(sig, (left * 64 + right).astype(np.uint64))
                a["doc"], a["pos"], a["left"], a["right"] = np.array(b.column(0).to_pylist(), np.int64)[which], at - begin, left, right
                made.append(a)
            if not made:
                continue
            first, repeats = _collapse(np.concatenate(made))
            rank = np.arange(len(first)) - np.maximum.accumulate(np.where(np.concatenate([[True], first["h"][1:] != first["h"][:-1]]), np.arange(len(first)), 0))
            many = _kinds(first) > _FEW
            undecided = first[many]
            few = first[~many | (rank < 2)]
            few["left"][many[~many | (rank < 2)]] |= _MARK
            yield _deal(few, "anchor", buckets)
            yield _deal(_around(repeats), "repeat", buckets)
            yield _deal(_around(undecided), "spread", buckets)

    return run


def _reduce_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = []
    for b in batches:
        for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if kind == "anchor":
                held.append(np.frombuffer(data, _ANCHOR))
            else:
                yield _by_doc(np.frombuffer(data, _RUN), kind)
    if held:
        all_ = np.concatenate(held)
        marked = np.unique(all_["h"][all_["left"] >= _MARK])
        all_["left"] &= _MARK - 1
        first, repeats = _collapse(all_)
        yield _by_doc(_around(repeats), "repeat")
        undecided = first[_kinds(first) > 1]
        spread = np.isin(undecided["h"], marked)
        yield _by_doc(_around(undecided[spread]), "spread")
        out = np.zeros(int((~spread).sum()), _RUN)
        out["doc"], out["start"] = undecided["doc"][~spread], undecided["pos"][~spread]
        out["end"] = undecided["left"][~spread].astype(np.int32) << 8 | undecided["right"][~spread]
        yield _by_doc(out, "open")


def _window_names(names: np.ndarray) -> np.ndarray:
    """Names of windows from those of 40-grams at all offsets."""
    n = max(0, len(names) - _SIDE)
    return _join(_join(names[:n], names[GRAM : GRAM + n]), names[_SIDE : _SIDE + n])


def _map_windows(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            windows, contexts = [], []
            for b in chunk:
                for doc, text, spread, open_ in zip(*(b.column(i).to_pylist() for i in range(4))):
                    data = np.frombuffer(text, np.uint8)
                    if spread:
                        runs = np.concatenate([np.frombuffer(p, "<i4").reshape(-1, 2) for p in spread])
                        runs = _runs(np.zeros(len(runs), np.int64), runs[:, 0], runs[:, 1])
                        for s, e in zip(runs["start"].tolist(), runs["end"].tolist()):
                            names = _window_names(gram_names(data[s:e]))
                            w = np.zeros(len(names), _WINDOW)
                            w["h"], w["doc"], w["pos"] = names, doc, np.arange(s, s + len(names))
                            windows.append(w)
                    if open_:
                        at = np.concatenate([np.frombuffer(p, "<i4").reshape(-1, 2) for p in open_])
                        at = at[at[:, 0] + GRAM + (at[:, 1] & 255) <= len(data)]
                        c = np.zeros(len(at), _CONTEXT)
                        c["doc"], c["pos"], c["left"], c["right"] = doc, at[:, 0], at[:, 1] >> 8, at[:, 1] & 255
                        padded = np.concatenate([np.zeros(_SIDE, np.uint8), data, np.zeros(_SIDE, np.uint8)])
                        c["bytes"] = padded[at[:, :1] + np.arange(GRAM + 2 * _SIDE)]
                        contexts.append(c)
            if windows:
                first, repeats = _first_windows(np.concatenate(windows))
                yield _deal(first, "window", buckets)
                yield _deal(_runs(repeats["doc"], repeats["pos"], repeats["pos"] + WINDOW), "repeat", buckets)
            if contexts:
                c = np.concatenate(contexts)
                grams = np.ascontiguousarray(c["bytes"][:, _SIDE : _SIDE + GRAM])
                c["h"] = gram_names(grams.reshape(-1))[:: GRAM]
                yield _deal(c, "context", buckets)

    return run


def _context_windows(c: np.ndarray) -> np.ndarray:
    """All windows around anchors that lie in their documents."""
    if not len(c):
        return np.zeros(0, _WINDOW)
    width = GRAM + 2 * _SIDE
    names = _window_names(gram_names(np.ascontiguousarray(c["bytes"]).reshape(-1)))
    offsets = np.arange(_SIDE + 1)
    row, at = np.nonzero((offsets >= _SIDE - c["left"].astype(np.int32)[:, None]) & (offsets <= c["right"].astype(np.int32)[:, None]))
    w = np.zeros(len(row), _WINDOW)
    w["h"], w["doc"], w["pos"] = names[row * width + at], c["doc"][row], c["pos"][row] - _SIDE + at
    return w


def _reduce_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    windows, contexts = [], []
    for b in batches:
        for kind, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            if kind == "window":
                windows.append(np.frombuffer(data, _WINDOW))
            elif kind == "context":
                contexts.append(np.frombuffer(data, _CONTEXT))
            else:
                yield _by_doc(np.frombuffer(data, _RUN), kind)
    if contexts:
        # Anchor by anchor, some thousands at once: equal windows have equal anchors.
        c = np.concatenate(contexts)
        c = c[np.argsort(c["h"], kind="stable")]
        edges = np.flatnonzero(np.concatenate([[True], c["h"][1:] != c["h"][:-1], [True]]))
        start = 0
        while start < len(edges) - 1:
            stop = max(start + 1, int(np.searchsorted(edges, edges[start] + 5000, side="right")) - 1)
            _, repeats = _first_windows(_context_windows(c[edges[start] : edges[stop]]))
            yield _by_doc(_runs(repeats["doc"], repeats["pos"], repeats["pos"] + WINDOW), "repeat")
            start = stop
    if windows:
        _, repeats = _first_windows(np.concatenate(windows))
        yield _by_doc(_runs(repeats["doc"], repeats["pos"], repeats["pos"] + WINDOW), "repeat")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc, data): packed pairs (start, end) of repeated bytes; several rows a document."""
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("doc"), utf8().alias("b"))
    size = texts.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    parts = max(shuffle_width(spark), -(-size // _PART))
    dealt = texts.mapInArrow(_map_anchors(4 * parts), "bucket int, kind string, data binary").repartition(parts, "bucket")
    found = stage(dealt.mapInArrow(_reduce_anchors, "doc bigint, kind string, data binary"))
    left = [F.collect_list(F.when(F.col("kind") == k, F.col("data"))).alias(k) for k in ("spread", "open")]
    open_ = found.where("kind <> 'repeat'").groupBy("doc").agg(*left)
    again = texts.join(open_, "doc").select("doc", "b", "spread", "open").mapInArrow(_map_windows(4 * parts), "bucket int, kind string, data binary")
    settled = again.repartition(parts, "bucket").mapInArrow(_reduce_windows, "doc bigint, kind string, data binary")
    return found.where("kind = 'repeat'").unionByName(settled).select("doc", "data")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, runs, kept): removed runs as pairs and the bytes that stay."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gone, runs, kept = [], [], [], []
            for text, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                out = np.zeros((0, 2), np.int32)
                if parts:
                    all_ = np.concatenate([np.frombuffer(p, "<i4").reshape(-1, 2) for p in parts])
                    all_ = np.minimum(all_, len(text))
                    all_ = all_[all_[:, 1] > all_[:, 0]]
                    merged = _runs(np.zeros(len(all_), np.int64), all_[:, 0], all_[:, 1])
                    out = np.stack([merged["start"], merged["end"]], axis=1)
                edges = [0, *out.reshape(-1).tolist(), len(text)]
                kept.append(b"".join(text[a:z] for a, z in zip(edges[::2], edges[1::2])))
                size.append(len(text)), gone.append(len(text) - len(kept[-1])), runs.append(out.reshape(-1).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.list_(pa.int32())), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "runs", "kept"])

    repeats = repeated_runs(docs).groupBy("doc").agg(F.collect_list("data").alias("parts"))
    rows = docs.select("doc_id", utf8().alias("b"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NULL)).alias("doc"))
    return rows.join(repeats, "doc", "left").select("doc_id", "b", "parts").mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, runs array<int>, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_bytes", "n_removed", (F.size("runs") / 2).cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
