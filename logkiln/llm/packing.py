"""Mixture-controlled packing by deficit round-robin over source queues.

The queues of all sources are visited in rounds of ``length`` tokens. In a round each source adds its quantum
(length x target share) to its deficit and gives whole tokens for it; what is left of a deficit is carried into the
next round. With fixed shares a source has given floor(rounds x length x share) tokens after any number of rounds, so
where a token lands follows from its place in its queue, and no window waits for another: that closed form
carries the deficits across windows and partitions alike. The stream is cut into windows of ``length``. When a queue
runs dry its share goes to the others in proportion; that happens at most once a source. Shares default to
the sources' token counts, which empties all queues together.

Tokens of a document: the tokenizer's ids, then ``END``. Queues: the documents of a source in the order of the
staged token table (task, then row); ids that are staged are read back, never made twice. A source's place in
a task is its base (sums of what earlier tasks hold) plus its running count there. The bases are
a small table, tasks x sources, that Spark joins by broadcast or by shuffle as its size demands.
The last, short window is cut into powers of two, so nothing is padded.

Defined results: a null or empty text is the end token alone; a null source is a queue of its own; rows with the same id
are documents of their own; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from fractions import Fraction
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logkiln.llm.alignment import byte_letters
from logkiln.llm.common import bound_batches, utf8
from logkiln.staging import stage

LENGTH, END = 2048, 1
#: Words that a worker remembers the ids of from batch to batch.
_CACHE = 600_000
#: New words that are encoded at once, and words whose ids are put in place at once.
_TOGETHER = 1 << 16
#: Rounds whose tokens are counted at once.
_ROUNDS = 1 << 14
#: White space to Python alone.
_ODD = re.compile("[\x1c-\x1f]")
#: The pattern by which the default tokenizer cuts words into units; a fixed value.
_UNITS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same on lower-cased Latin-1, in the classes that it names; a line feed is a unit too.
_LETTERS, _NUMBERS = (re.escape("".join(c for c in map(chr, range(256)) if unicodedata.category(c)[0] == x)) for x in "LN")
_CUT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+|\n").findall
_PIECES = "doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"


class WordTokens(dict):
    """Ids of texts as little-endian 16 or 32-bit bytes; a word is encoded when it is first met and remembered.

    For tokenizers that lower-case, drop white space, cut words by ``_UNITS`` and close each unit with ``</w>``, as the
    default one does, texts are split at ASCII white space, words in Latin-1 are cut here, and all new words of a batch go to the merges together. A blank
    stands for ``</w>`` there: it joins the letter before it ahead of all other merges. Other words, and those with an added
    token in them, go through the file's own tokenizer; so does every text if the file describes anything else.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.added = tuple(t["content"] for t in file.get("added_tokens", ()))
        self.merges, self.feed = self._merges(file)

    @staticmethod
    def _merges(file: dict):
        """The merges, and the id of a line feed that is a unit; nothing if the file is of another kind."""
        model, before = file["model"], (file.get("pre_tokenizer") or {}).get("pretokenizers", ())
        steps = [n.get("type") for n in (file.get("normalizer") or {}).get("normalizers", ())]
        usual = steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in before] == ["Split", "ByteLevel"]
        usual = usual and before[0]["pattern"] == {"Regex": _UNITS} and before[0]["invert"] and before[0]["behavior"] == "Removed"
        usual = usual and not before[1]["add_prefix_space"] and not before[1]["use_regex"] and model.get("end_of_word_suffix") == "</w>"
        if not usual or model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            return None, None
        if any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in file.get("added_tokens", ())):
            return None, None  # words cannot be told apart from their neighbours
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        if any(model["vocab"].get(a + b) != 512 + k for k, (a, b) in enumerate(merges)):
            return None, None  # ids are not the order of the merges
        import tiktoken

        letters, ranks = byte_letters(), {}
        for token, i in model["vocab"].items():
            if i < 512 + len(merges):
                whole = token.removesuffix("</w>")
                ranks[bytes(letters[c] for c in whole) + b" " * (whole != token)] = i
        if sorted(ranks.values()) != list(range(512 + len(merges))) or any(len(x) != 1 + (i > 255) for x, i in ranks.items() if i < 512):
            return None, None
        return tiktoken.Encoding("file", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary, ranks[b"\n "]

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def _usual(self, text: str) -> bool:
        return max(text, default="") < "\u0100" and not _ODD.search(text) and not any(a in text for a in self.added)

    def learn(self, words: list[str]) -> None:
        """Encode new words."""
        if not self._usual("\n".join(["", *words, ""])):
            self.update((w, self.encode(w)) for w in words if not self._usual(w))
            words = [w for w in words if self._usual(w)]
        # Words end in line feeds, each a unit by itself.
        units = _CUT("\n".join([*words, ""]).lower())
        ids = np.array(self.merges(" ".join([*units, ""])), self.kind)
        ends = np.flatnonzero(ids == self.feed)
        data, z = ids.tobytes(), self.kind.itemsize
        starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        self.update(zip(words, [data[i:k] for i, k in zip((starts * z).tolist(), (ends * z).tolist())]))

    def batch(self, texts: list[str]) -> list[bytes]:
        if self.merges is None:
            return [self.encode(t) for t in texts]
        listed = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded, edges = listed.flatten().dictionary_encode(), listed.offsets.to_numpy()
        words, which = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        new = list(filterfalse(self.__contains__, words))
        for i in range(0, len(new), _TOGETHER):
            self.learn(new[i : i + _TOGETHER])
        own = list(map(self.__getitem__, words))
        size = np.fromiter(map(len, own), np.int64, len(own)) // self.kind.itemsize
        ids, start, out = np.frombuffer(b"".join(own), self.kind), np.cumsum(size) - size, []
        for i in range(0, len(which), _TOGETHER):
            w = which[i : i + _TOGETHER]
            n = size[w]
            out.append(ids[np.arange(n.sum()) + np.repeat(start[w] - np.cumsum(n) + n, n)])
        ends = np.concatenate([[0], np.cumsum(size[which])])[edges].tolist()
        out = np.concatenate([*out, ids[:0]])
        if len(self) > _CACHE:
            self.clear()
        return [out[i:k].tobytes() for i, k in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One for all tasks that a worker runs."""
    return WordTokens(path)


@dataclass(frozen=True)
class Phase:
    """Rounds between two moments at which a queue runs dry."""

    begin: int  # place in the packed stream
    rounds: int
    sources: tuple
    shares: tuple[Fraction, ...]
    before: tuple[int, ...]  # tokens that each source has given earlier

    def given(self, rounds: int, length: int) -> list[int]:
        return [(rounds * length * x).__floor__() for x in self.shares]


def phases(totals: dict, weights: dict | None = None, length: int = LENGTH) -> list[Phase]:
    """The whole schedule; ``totals`` in the order of the turn. At most two phases a source."""
    left = {s: n for s, n in totals.items() if n}
    before, at, out = dict.fromkeys(left, 0), 0, []
    while left:
        names = tuple(left)
        target = {s: Fraction((weights or totals).get(s) or 0) for s in names}
        if not sum(target.values()):
            target = dict.fromkeys(names, Fraction(1))
        whole = sum(target.values())
        phase = Phase(at, 0, names, tuple(target[s] / whole for s in names), tuple(before[s] for s in names))
        low, high = 0, max(int(left[s] / (length * x)) + 2 for s, x in zip(names, phase.shares) if x)
        while low < high:  # the most rounds that every queue is long enough for
            mid = (low + high + 1) // 2
            fits = all(n <= left[s] for s, n in zip(names, phase.given(mid, length)))
            low, high = (mid, high) if fits else (low, mid - 1)
        if low == 0:
            # A round in which queues run dry: each gives its share or what it has.
            took = [min(n, left[s]) for s, n in zip(names, phase.given(1, length))]
            phase, low = replace(phase, shares=tuple(Fraction(n, length) for n in took)), 1
        phase = replace(phase, rounds=low)
        out.append(phase)
        for s, n in zip(names, phase.given(low, length)):
            before[s] += n
            left[s] -= n
            at += n
            if not left[s]:
                del left[s]
    return out


def _floor(w0: int, n: int, length: int, share: Fraction) -> np.ndarray:
    """floor(w x length x share) for w0 <= w < w0 + n, exact: big numbers for w0, the rest in 64 bits."""
    a, b = share.numerator * length, share.denominator
    base, rest = divmod(w0 * a, b)
    step, a = divmod(a, b)
    w = np.arange(n, dtype=np.int64)
    if rest + n * a < 1 << 63:
        return base + w * step + (rest + w * a) // b
    return base + w * step + np.array([(rest + x * a) // b for x in range(n)], np.int64)


def place_run(source, at: int, n: int, plan: list[Phase], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the n tokens from place ``at`` of a source's queue go: runs (start, count, stream place)."""
    out, done = [], 0
    for phase in plan:
        if source not in phase.sources or done == n:
            continue
        k = phase.sources.index(source)
        begin, share = phase.before[k], phase.shares[k]
        span = (phase.rounds * length * share).__floor__()
        q = at + done - begin
        if q >= span:
            continue
        take = min(n - done, span - q)
        # Rounds that give queue places q to q + take, some thousands at once.
        low, end = max(0, (q / (length * share)).__floor__() - 2), min(phase.rounds, ((q + take) / (length * share)).__floor__() + 3)
        for w0 in range(low, end, _ROUNDS):
            own, total, ahead = None, 0, 0
            rounds = min(_ROUNDS, end - w0)
            for j, x in enumerate(phase.shares):
                given = _floor(w0, rounds + 1, length, x)
                total = total + given
                if j < k:
                    ahead = ahead + given[1:] - given[:-1]
                elif j == k:
                    own = given
            places = phase.begin + total[:-1] + ahead
            starts, ends = np.maximum(own[:-1], q), np.minimum(own[1:], q + take)
            some = ends > starts
            out.append((done + starts[some] - q, (ends - starts)[some], (places + starts - own[:-1])[some]))
        done += take
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (empty, empty, empty)


def place(source, at: int, n: int, plan: list[Phase], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """``place_run`` as a list of its runs."""
    return list(zip(*(x.tolist() for x in place_run(source, at, n, plan, length))))


def _tail(total: int, length: int) -> np.ndarray:
    """Edges of the sequences from the last full one on: what is left of ``total`` in powers of two."""
    edges = [total // length * length]
    while edges[-1] < total:
        edges.append(edges[-1] + (1 << ((total - edges[-1]).bit_length() - 1)))
    return np.array(edges, np.int64)


def cut_runs(start: np.ndarray, n: np.ndarray, at: np.ndarray, total: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Runs at places ``at`` of the stream as pieces (run, start, count, sequence, offset): full sequences, then the tail."""
    full, tail = total // length, _tail(total, length)

    def sequence(x: np.ndarray) -> np.ndarray:
        return np.where(x < full * length, x // length, full + np.searchsorted(tail, x, side="right") - 1)

    def edge(s: np.ndarray) -> np.ndarray:
        return np.where(s < full, s * length, tail[np.clip(s - full, 0, len(tail) - 1)])

    first = sequence(at)
    pieces = np.where(n > 0, sequence(at + n - 1) - first + 1, 0)
    run = np.repeat(np.arange(len(n)), pieces)
    seq = first[run] + np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    low = np.maximum(at[run], edge(seq))
    return run, start[run] + low - at[run], np.minimum((at + n)[run], edge(seq + 1)) - low, seq, low - edge(seq)


def cut(start: int, n: int, at: int, total: int, length: int = LENGTH) -> list[tuple[int, int, int, int]]:
    """``cut_runs`` of one run, as a list of its pieces."""
    one = (np.array([x], np.int64) for x in (start, n, at))
    return list(zip(*(x.tolist() for x in cut_runs(*one, total, length)[1:])))


def cut_documents(sources: list, n: np.ndarray, at: np.ndarray, plan: list[Phase], total: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The pieces (document, start, count, sequence, offset) of documents with n tokens from place ``at`` of their source's queue.

    Documents that follow each other in a queue are placed together, and cut apart after that."""
    by: dict = {}
    for i, s in enumerate(sources):
        by.setdefault(s, []).append(i)
    out = []
    for s, own in by.items():
        own = np.array(own)
        own = own[np.argsort(at[own], kind="stable")]
        gaps = np.flatnonzero(at[own][1:] != (at + n)[own][:-1]) + 1
        for docs in np.split(own, gaps):
            begin = int(at[docs[0]])
            start, count, stream = place_run(s, begin, int(n[docs].sum()), plan, length)
            # Runs are cut where a document ends.
            edges = np.union1d(start, at[docs] - begin)
            run = np.searchsorted(start, edges, side="right") - 1
            size = np.append(edges[1:], start[-1] + count[-1]) - edges
            doc = np.searchsorted(at[docs] - begin, edges, side="right") - 1
            piece, first, k, q, o = cut_runs(edges, size, stream[run] + edges - start[run], total, length)
            out.append((docs[doc[piece]], first - (at[docs] - begin)[doc[piece]], k, q, o))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 5


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Staged rows (doc_id, source, task, before, n, ids): ids in 16 or 32 bits, ``before`` what the task holds of the source ahead."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tokens, held = TaskContext.get().partitionId(), word_tokens(tokenizer), {}
        end = np.array([END], tokens.kind).tobytes()
        for b in batches:
            ids = [x + end for x in tokens.batch([x.decode("utf-8", "replace") for x in b.column(2).to_pylist()])]
            sources, before, n = b.column(1).to_pylist(), [], [len(x) // tokens.kind.itemsize for x in ids]
            for s, k in zip(sources, n):
                before.append(held.get(s, 0))
                held[s] = before[-1] + k
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([task] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "source", "task", "before", "n", "ids"])

    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), utf8().alias("b"))
    return stage(rows.mapInArrow(run, f"doc_id {kind}, source string, task int, before bigint, n bigint, ids binary"))


def pack(docs: DataFrame, tokenizer: str, weights: dict | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces of all documents in sequences. Sources are few (a row each on the driver); ``weights`` are target
    proportions by source, by default the sources' sizes."""
    tokens = token_table(docs, tokenizer)
    kind = docs.schema["doc_id"].dataType.simpleString()
    held = stage(tokens.groupBy("task", "source").agg(F.sum("n").alias("n")))
    # Bases by task: running sums within blocks of tasks, and over blocks; neither window holds all tasks of a source.
    block = (F.col("task") / 1024).cast("int")
    blocks = held.groupBy("source", block.alias("block")).agg(F.sum("n").alias("n"))
    over = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "block").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    inner = held.withColumn("block", block).withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    bases = stage(
        inner.alias("i").join(blocks.alias("b"), F.col("i.source").eqNullSafe(F.col("b.source")) & (F.col("i.block") == F.col("b.block")))
        .select(F.col("i.source").alias("s"), F.col("i.task").alias("t"), (F.col("own") + F.col("ahead")).alias("base"))
    )
    totals = {r["source"]: r["n"] for r in held.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    totals = {s: totals[s] for s in sorted(totals, key=lambda s: (s is None, s or ""))}
    plan, total = phases(totals, weights, length), sum(totals.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"]
        for b in batches:
            n, at = (np.array(b.column(c).to_pylist(), np.int64) for c in ("n", "at"))
            doc, start, size, seq, off = cut_documents(b.column("source").to_pylist(), n, at, plan, total, length)
            order = np.argsort(doc, kind="stable")
            doc, start, size, seq, off = (x[order] for x in (doc, start, size, seq, off))
            ends, crc, now, data = (start + size).tolist(), [], -1, b""
            ids, count = b.column("ids"), n.tolist()
            for i, a, z in zip(doc.tolist(), start.tolist(), ends):
                if i != now:
                    own, now = ids[i].as_py(), i
                    data = memoryview(np.frombuffer(own, "<u2" if len(own) == 2 * count[i] else "<u4").astype("<u4").tobytes())
                crc.append(zlib.crc32(data[4 * a : 4 * z]))
            index = pa.array(doc, pa.int64())
            numbers = [pa.array(x, pa.int64()) for x in (start, size, crc, n[doc], seq, off)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(index), *numbers, b.column("source").take(index)], names)

    rows = tokens.join(bases, (F.col("task") == F.col("t")) & F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "source", "n", (F.col("before") + F.col("base")).alias("at"), "ids")
    return rows.mapInArrow(run, _PIECES.format(kind=kind))
