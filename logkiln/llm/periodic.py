"""Periodic runs of words by string synchronising sets.

A run is a longest stretch of words in which words q apart are identical, with q its smallest period. All runs of at least four
periods are found. Words are numbered, and texts of a batch are laid one after another with a different number between any two,
so that arrays are worked for many texts at once and no period reaches over an end.

At scale t (4, 8, 16, ...) each place j has the exact name of its t words, by doubling the names of the scale before. Place i belongs to
the synchronising set if the least hashed name of the places i to i + t is that of i or of i + t; places whose t words have a period of at
most t / 4 are left out. Membership depends on the 2 t words from i on alone, and any t places in a row hold a member unless
their words are of such a small period. So a run of period q, t <= q < 2 t, holds members i and i + q with equal contexts of 2 t
words, no equal context between them, as q is its smallest period. Neighbouring members of equal context whose distance lies in
that range therefore propose every such run, and each proposal is extended word by word. Regions of the small periods
left out are those of runs found at lower scales; periods 1 to 3 are found on their own, by comparing words so far apart.

Defined results: a null or empty text has no runs and stays empty; rows with the same id keep their rows; runs come by start, then
period; a text is worked whole in one task; an empty table gives an empty one. Only ``doc_id`` and ``text`` are read, so other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.llm.common import bound_batches, utf8

#: A run has at least so many periods, and so many words.
PERIODS, LEAST = 4, 6
#: The smallest scale; periods below it are compared directly.
FIRST = 4
#: Words that are worked at once, unless one text has more.
BATCH_WORDS = 1 << 17
#: Spaces that part words.
SPACES = "[\\x20\\x09-\\x0D]+"


def _mixed(names: np.ndarray, turn: int) -> np.ndarray:
    x = names.astype(np.uint64) + np.uint64(turn * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row: the rest of one block and the beginning of the next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    rest = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(rest[: n - width + 1], ahead[width - 1 : n])


def _small(words: np.ndarray, q: int) -> list[tuple[int, int, int]]:
    """Runs (start, end, q) of a period below ``FIRST``."""
    same = np.concatenate([[False], words[q:] == words[:-q], [False]]) if len(words) > q else np.zeros(2, bool)
    edges = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edges[::2], edges[1::2] + q
    long = ends - starts >= PERIODS * q
    starts, ends = starts[long], ends[long]
    # A smaller period than 2 or 3 can only be 1: equal words at the beginning.
    own = np.ones(len(starts), bool) if q == 1 else (words[starts] != words[starts + 1]) | (words[starts + q - 2] != words[starts + q - 1])
    return [(int(s), int(e), q) for s, e in zip(starts[own], ends[own])]


def _extended(words: np.ndarray, at: int, q: int, ahead: int) -> tuple[int, int]:
    """The longest stretch around ``at`` in which words q apart are identical; the ``ahead`` words from ``at`` on are known to be."""
    start, step = at, 16
    while start:
        low = max(0, start - step)
        differ = np.flatnonzero(words[low:start] != words[low + q : start + q])
        if len(differ):
            start = low + int(differ[-1]) + 1
            break
        start, step = low, step * 2
    end, step, n = at + ahead, 16, len(words) - q
    while end < n:
        high = min(n, end + step)
        differ = np.flatnonzero(words[end:high] != words[end + q : high + q])
        if len(differ):
            end += int(differ[0])
            break
        end, step = high, step * 2
    return start, end + q


def word_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, end, period) of at least ``PERIODS`` periods, unordered."""
    runs = [r for q in range(1, FIRST) for r in _small(words, q)]
    longest, names, t = len(words) // PERIODS, words, 1
    places = np.arange(len(words))
    while t <= longest:
        if t >= FIRST:
            runs += _at_scale(words, names, t, runs)
        # Exact names of twice the length; places without so many words after them have none.
        left = len(names) - t
        if left <= 0:
            break
        _, names = np.unique(names[:left] * (int(names.max()) + 1) + names[t:], return_inverse=True)
        t *= 2
    return runs


def _at_scale(words: np.ndarray, names: np.ndarray, t: int, lower: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of the periods from t to below 2 t; ``names`` are those of t words, ``lower`` all runs of smaller periods."""
    n = len(names)
    if n <= t:
        return []
    none = np.iinfo(np.uint64).max
    order = np.minimum(_mixed(names, t), none - np.uint64(1))
    periodic = np.zeros(n + 1, np.int64)
    for start, end, q in lower:
        if 4 * q <= t <= end - start:
            periodic[start] += 1
            periodic[end - t + 1] -= 1
    order[np.cumsum(periodic[:n]) > 0] = none
    least = _window_least(order, t + 1)
    members = np.flatnonzero(((order[:-t] == least) | (order[t:] == least)) & (least != none))
    # The context of 2 t words: the names of its two halves.
    first, second = names[members], names[members + t]
    by = np.lexsort((members, second, first))
    at, first, second = members[by], first[by], second[by]
    apart = np.diff(at)
    proposed = np.flatnonzero((first[1:] == first[:-1]) & (second[1:] == second[:-1]) & (apart >= t) & (apart < 2 * t))
    runs, reached = [], {}
    for i, q in sorted(zip(at[proposed].tolist(), apart[proposed].tolist())):
        if reached.get(q, -1) > i:  # within the stretch of an earlier proposal of this period
            continue
        start, end = _extended(words, i, q, 2 * t)
        reached[q] = end - q
        if end - start >= PERIODS * q:
            runs.append((start, end, q))
    return runs


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, period), by start and period."""
    number: dict[bytes, int] = {}
    sizes = np.array([len(words) for words in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    flat = np.empty(int(sizes.sum()) + len(texts), np.int64)
    for at, words in zip(starts.tolist(), texts):
        flat[at : at + len(words)] = [number.setdefault(w, len(number)) for w in words]
    flat[starts + sizes] = len(number) + np.arange(len(texts))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, q in word_runs(flat):
        if end - start >= max(LEAST, PERIODS * q):
            k = int(np.searchsorted(starts, start, "right")) - 1
            out[k].append((start - int(starts[k]), end - start, q))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run repeats: each run keeps its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        drop[start + q] += 1
        drop[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(drop[:-1]) == 0).tolist()]


def collapse_runs(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, runs, text): runs as (start, length, period), and the text with each run cut to one period, words parted by one space."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, runs, held, waiting = [x.as_py().split() for x in b.column(1)], [], 0, 0
            for k, words in enumerate(texts, 1):
                held += len(words)
                if held >= BATCH_WORDS or k == len(texts):
                    runs += find_runs(texts[waiting:k])
                    held, waiting = 0, k
            ends = pa.array(np.cumsum([0, *map(len, runs)], dtype=np.int32))
            flat = np.array([r for each in runs for r in each], np.int64).reshape(-1, 3)
            struct = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            kept = pa.array([b" ".join(kept_words(w, r)) for w, r in zip(texts, runs)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, struct), kept], ["doc_id", "runs", "b"])

    found = docs.select("doc_id", utf8().alias("b")).mapInArrow(run, f"doc_id {kind}, runs array<struct<start: bigint, length: bigint, period: bigint>>, b binary")
    return found.select("doc_id", "runs", F.col("b").cast("string").alias("text"))


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text): where crc32 of the id as text is divisible by ten, words from some place on repeat a period of its own.

    With that number h, g = floor(h / 10) and n words, the word i >= a = g % n becomes a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)).
    A null id counts as the empty text.
    """
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), SPACES), lambda w: w != "")
    chosen = docs.select("doc_id", "text", h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    placed = chosen.withColumn("n", n).withColumn("a", F.when(F.col("n") > 0, g % F.col("n")))
    placed = placed.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    a = F.col("a")
    tail = F.transform(F.sequence(a, F.col("n") - 1), lambda i: F.get("words", (a + (i - a) % F.col("p")).cast("int")))
    new = F.array_join(F.concat(F.slice("words", F.lit(1), a.cast("int")), tail), " ")
    return placed.select("doc_id", F.when(F.col("n") > 0, new).otherwise(F.col("text")).alias("text"))


def most_periodic(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones the first in their order, which is by start and period."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(better(best, r), r).otherwise(best))
