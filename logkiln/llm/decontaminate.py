"""Benchmark decontamination: SimHash fingerprints of windows as long as the benchmark items.

Words are runs of letters, digits and underscores, lower-cased; shingles are ``SHINGLE`` words (an item that is shorter is one
shingle). The similarity of a window and an item is that of their weighted shingles, weights being how
often each occurs: sum of minima over sum of maxima.

1. Windows: a window that reaches ``SIMILARITY`` shares a fixed part of its shingles with the item. The running count of
   document shingles that the item has gives every window of the item's length that can; no other can be similar.
2. Candidates: these windows' fingerprints are looked up in the items' by multi-index hashing: 64 bits in RADIUS + 1
   blocks, so an item within the radius agrees in at least one block. Fingerprints beyond the radius are no candidates.
3. Verification: the exact similarity.

Items are taken from the benchmark in blocks of ``ITEMS``; each block is a bounded index that every task holds, and a pass
over the documents. Documents are never shuffled.

Defined results: null or empty texts, and items without words, match nothing; a text shorter than an item is
one window, whole; of equal windows the first counts; equal rows and equal items each get their own result; extra columns
are kept by ``clean`` and ignored otherwise.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logkiln.llm.common import bound_batches

SHINGLE, SIMILARITY, RADIUS, ITEMS = 5, 0.8, 24, 5000
_WORD = re.compile(r"\w+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _grams(ids: np.ndarray, size: int) -> np.ndarray:
    """64-bit numbers of runs of ``size`` word numbers."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = _mixed(out + ids[i : i + n].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


def fingerprint(grams: np.ndarray) -> int:
    bits = np.unpackbits(_mixed(grams).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(grams), bitorder="little").view(np.uint64)[0])


def similarity(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[k]) for k, n in a.items())
    return low / (sum(a.values()) + sum(b.values()) - low)


class Index:
    """A block of benchmark items, ready for looking up."""

    def __init__(self, items: list[tuple], size: int = SHINGLE, least: float = SIMILARITY, radius: int = RADIUS):
        self.size, self.least, self.radius = size, least, radius
        self.numbers: dict[str, int] = {}
        self.ids, self.words, self.grams, self.shingles, self.prints = [], [], [], [], []
        holders: dict[int, dict[int, list[int]]] = {}
        for item, text in items:
            own = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in _WORD.findall((text or "").lower())], np.int64)
            if not len(own):
                continue
            k = min(size, len(own))
            grams = _grams(own, k)
            index = len(self.ids)
            self.ids.append(item), self.words.append(len(own)), self.grams.append(grams)
            self.shingles.append(Counter(grams.tolist())), self.prints.append(fingerprint(grams))
            for g in set(grams.tolist()):
                holders.setdefault(k, {}).setdefault(g, []).append(index)
        self.holders = {k: (np.array(sorted(h), np.uint64), h) for k, h in holders.items()}
        self.blocks = []
        edges = [64 * i // (radius + 1) for i in range(radius + 2)]
        for a, b in zip(edges, edges[1:]):
            table: dict[int, list[int]] = {}
            for i, f in enumerate(self.prints):
                table.setdefault(f >> a & (1 << b - a) - 1, []).append(i)
            self.blocks.append((a, (1 << b - a) - 1, table))

    def near(self, f: int) -> set[int]:
        """All items within the radius of a fingerprint."""
        found = {i for shift, mask, table in self.blocks for i in table.get(f >> shift & mask, ())}
        return {i for i in found if (self.prints[i] ^ f).bit_count() <= self.radius}

    def matches(self, text: str | None) -> list[tuple]:
        """(item, first word, words of the window, similarity, differing bits): the best window of each item, by item."""
        words = _WORD.findall((text or "").lower())
        get = self.numbers.get
        ids = np.array([get(w, 0) for w in words], np.int64)
        best: dict[int, tuple] = {}
        for k, (known, holders) in self.holders.items():
            n = len(ids) - k + 1
            if n <= 0:
                continue
            zeros = np.concatenate([[0], np.cumsum(ids == 0)])
            at = np.flatnonzero(zeros[k:] == zeros[:-k])
            if not len(at):
                continue
            grams = _grams(ids, k)
            at = at[known[np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)] == grams[at]]
            places: dict[int, list[int]] = {}
            for p in at.tolist():
                for i in holders[int(grams[p])]:
                    places.setdefault(i, []).append(p)
            for i, own in places.items():
                self._windows(i, np.array(own), grams, k, len(ids), best)
        return [best[i] for i in sorted(best, key=lambda i: (best[i][0] is None, best[i][0], i))]

    def _windows(self, item: int, places: np.ndarray, grams: np.ndarray, k: int, words: int, best: dict) -> None:
        """Windows of the item's length that share enough shingles with it, through the fingerprints."""
        width, whole = min(self.words[item], words), len(self.grams[item])
        m = width - k + 1
        # low / (m + whole - low) >= least
        need = self.least * (m + whole) / (1 + self.least) - 1e-9
        if len(places) < need:
            return
        hit = np.zeros(len(grams) + 1, np.int64)
        hit[places + 1] = 1
        total = np.cumsum(hit)
        for s in np.flatnonzero(total[m:] - total[:-m] >= need).tolist():
            window = grams[s : s + m]
            f, bag = fingerprint(window), None
            for i in self.near(f):
                if min(self.words[i], words) != width or min(self.size, self.words[i]) != k:
                    continue
                bag = bag or Counter(window.tolist())
                alike = similarity(bag, self.shingles[i])
                if alike >= self.least and (i not in best or alike > best[i][3] or (alike == best[i][3] and s < best[i][1])):
                    best[i] = (self.ids[i], s, width, alike, (self.prints[i] ^ f).bit_count())


def _blocks(benchmark: DataFrame, rows: int = ITEMS) -> Iterator[Index]:
    """The benchmark as indexes of ``rows`` items; the driver holds one block at a time."""
    held: list[tuple] = []
    for r in benchmark.select("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        if len(held) == rows:
            yield Index(held)
            held = []
    if held:
        yield Index(held)


def find_matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, first_word, n_words, similarity, distance): each pair's best window."""
    spark = docs.sparkSession
    bound_batches(spark)
    kind, item = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item}, first_word int, n_words int, similarity double, distance int"
    out = spark.createDataFrame([], schema)
    for index in _blocks(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            types = [pa.int32(), pa.int32(), pa.float64(), pa.int32()]
            for b in batches:
                found = [(i, *m) for i, text in enumerate(b.column(1).to_pylist()) for m in shared.value.matches(text)]
                which, items, *rest = zip(*found) if found else ((),) * 6
                columns = [pa.array(x, t) for x, t in zip(rest, types)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which, pa.int64())), pa.array(items, pa.int64()) if item == "bigint" else pa.array(items), *columns], ["doc_id", "item_id", "first_word", "n_words", "similarity", "distance"])

        out = out.unionByName(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, whose texts hold no window that is similar to an item."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not shared.value.matches(x) for x in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
