"""Language-model scores of whole documents, from a recurrent model learned on the corpus.

1. Count: every task counts its words and deals them out by hash, packed; the sums give the number of tokens
   and of distinct ones, and the ``TABLE`` most frequent words with their counts.
2. Learn, in ``ROUNDS`` rounds: the documents are dealt into rounds by a hash of their text, so each is learned from once, at
   every size. In a round every task goes through its own documents of the round from the same start; the mean of all tasks'
   parameters and squared gradients, weighted by tokens, is the next round's start and in the end the model. Tasks, and so
   what is gathered, grow with the input.
3. Score: every task runs its documents through the model. Words outside the table are dealt out by hash as
   (hash, document); there each gets its count, and sums by document come back.

A token's probability is the model's; for tokens off the shortlist the model gives the probability that one comes, and
counts say which: (count + 1) of their sum, with one more for all that was never seen. So the probabilities of all
tokens add up to one. Rare words are told apart by 64-bit XXH64 values.

Defined results: a null or empty text is its end token alone; without learning texts every count is zero and the model is its
start; rows with the same id are scored each; an empty table gives an empty one; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.llm import gru
from logkiln.llm.common import bound_batches, lower_words, shuffle_width, utf8
from logkiln.staging import stage

#: Words with counts that every task holds.
TABLE = 65_536
#: How often the tasks' parameters are averaged.
ROUNDS = 3
#: Bytes of text that a task works on at once, and of text for each shuffle partition.
_CHUNK, _PART = 16 << 20, 16 << 20
_STOP = b" "  # the end token; no word has a blank
_RARE = np.dtype([("h", "<u8"), ("doc", "<i4")])
_SUM = np.dtype([("doc", "<i4"), ("known", "<i4"), ("log", "<f8")])


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


def _parts(texts: DataFrame) -> int:
    size = texts.agg(F.sum(F.octet_length("b"))).first()[0] or 0
    return max(shuffle_width(texts.sparkSession), -(-size // _PART))


def count_words(texts: DataFrame, parts: int) -> DataFrame:
    """Staged rows (word, n): the most frequent words of each bucket, and one row a bucket with a null word,
    its tokens as n and its distinct words as kinds."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            seen: Counter[bytes] = Counter()
            for b in chunk:
                for x in b.column(0):
                    seen.update(lower_words(x.as_py()))
                seen[_STOP] += b.num_rows
            by: list[list[bytes]] = [[] for _ in range(parts)]
            for w in seen:
                by[zlib.crc32(w) % parts].append(w)
            words = [b"\n".join(x) for x in by]
            numbers = [np.fromiter((seen[w] for w in x), "<i8", len(x)).tobytes() for x in by]
            yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(words, pa.binary()), pa.array(numbers, pa.binary())], ["bucket", "words", "numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, dict[bytes, int]] = {}
        for b in batches:
            for bucket, words, numbers in zip(*(b.column(i).to_pylist() for i in range(3))):
                if numbers:
                    own = by.setdefault(bucket, {})
                    get = own.get
                    for w, n in zip(words.split(b"\n"), np.frombuffer(numbers, "<i8").tolist()):
                        own[w] = get(w, 0) + n
        for own in by.values():
            top = sorted(own.items(), key=lambda x: (-x[1], x[0]))[:TABLE]
            words, n = [w for w, _ in top] + [None], [k for _, k in top] + [sum(own.values())]
            kinds = [None] * len(top) + [len(own)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array(kinds, pa.int64())], ["word", "n", "kinds"])

    dealt = texts.mapInArrow(count, "bucket int, words binary, numbers binary").repartition(parts, "bucket")
    return stage(dealt.mapInArrow(add, "word binary, n bigint, kinds bigint").where(F.col("kinds").isNotNull() | (F.col("n") > 1)))


class Vocabulary:
    """The end token and the most frequent words, by number; their counts; all tokens and distinct ones."""

    def __init__(self, counted: DataFrame):
        row = counted.where("kinds IS NOT NULL").agg(F.sum("n"), F.sum("kinds")).first()
        self.tokens, self.kinds = int(row[0] or 0), int(row[1] or 0)
        stop = counted.where(F.col("word") == F.lit(_STOP)).agg(F.sum("n")).first()[0] or (1 if self.tokens else 0)
        words = counted.where(F.col("word").isNotNull() & (F.col("word") != F.lit(_STOP)))
        # Spark takes the first rows of every partition to one place. So words that cannot be among the first are left out before: of
        # how often counts of each bit length occur, the driver gets one number each.
        bits = {r["bits"]: r["n"] for r in words.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count("*").alias("n")).collect()}
        least, above = 0, 0
        for k in sorted(bits, reverse=True):
            above += bits[k]
            if above >= TABLE - 1:
                least = 1 << (k - 1)
                break
        top = words.where(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(TABLE - 1).collect()
        self.words = [_STOP] + [bytes(r["word"]) for r in top]
        self.counts = np.array([stop] + [r["n"] for r in top], np.int64)

    @property
    def numbers(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    def start(self) -> np.ndarray:
        short = self.counts[: gru.SHORT]
        return gru.start(np.concatenate([short, np.zeros(gru.SHORT - len(short)), [self.tokens - short.sum()]]))


def _ids(words: list[bytes], numbers: dict[bytes, int]) -> np.ndarray:
    """Table numbers of a text's words and its end; -1 off the table."""
    out = np.empty(len(words) + 1, np.int32)
    out[:-1] = np.fromiter(map(numbers.get, words, repeat(-1)), np.int32, len(words))
    out[-1] = gru.END
    return out


def _short(ids: np.ndarray) -> np.ndarray:
    return np.where((ids < 0) | (ids >= gru.SHORT), gru.OTHER, ids).astype(np.int16)


def learn(texts: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """The parameters after all rounds."""
    flat, squares = vocabulary.start(), np.full(gru.SIZE, 1e-5, np.float32)
    turn = F.pmod(F.xxhash64("b"), F.lit(ROUNDS))
    for k in range(ROUNDS):
        flat, squares = _round(texts.where(turn == k), vocabulary, flat, squares)
    return flat


def _round(texts: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the parameters and squared gradients that all tasks learn; summed in groups, so that the driver adds up a few."""
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary.words[: gru.SHORT], flat, squares))
    made = pa.schema([("seen", pa.int64()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, *first = shared.value
        numbers, (flat, squares), seen = {w: i for i, w in enumerate(words)}, (x.copy() for x in first), 0
        for chunk in _chunks(batches):
            seen += gru.train(flat, [_short(_ids(lower_words(x.as_py()), numbers)) for b in chunk for x in b.column(0)], squares)
        if seen:
            yield pa.RecordBatch.from_pydict({"seen": [seen], "sums": [(np.stack([flat, squares]).astype(np.float64) * seen).tobytes()]}, made)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sums = 0, np.zeros(2 * gru.SIZE)
        for b in batches:
            for n, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen, sums = seen + n, sums + np.frombuffer(x)
        if seen:
            yield pa.RecordBatch.from_pydict({"seen": [seen], "sums": [sums.tobytes()]}, made)

    groups = max(1, math.isqrt(texts.rdd.getNumPartitions()))
    rows = texts.mapInArrow(run, "seen bigint, sums binary").repartition(groups).mapInArrow(add, "seen bigint, sums binary").collect()
    if not rows:
        return flat, squares
    mean = sum(np.frombuffer(r["sums"]) for r in rows) / sum(r["seen"] for r in rows)
    return tuple(mean.astype(np.float32).reshape(2, -1))


def _value(counts: np.ndarray) -> np.ndarray:
    return np.log10(counts + 1.0)


def score(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, learning: Column, parts: int) -> DataFrame:
    """(doc_id, learning, n_tokens, n_known, base_score, score); ``learning`` says whose words were counted."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast((vocabulary.words, vocabulary.counts, flat))
    # Of all tokens, and of those off the shortlist: the logarithms of what counts are divided by.
    whole = math.log10(vocabulary.tokens + vocabulary.kinds + 1)
    short = vocabulary.counts[: gru.SHORT]
    rest = math.log10(max(0, vocabulary.tokens - int(short.sum()) + vocabulary.kinds - len(short)) + 1)
    fields = f"doc_id {kind}, learning boolean"
    head = f"key bigint, kind string, bucket int, data binary, docs array<struct<doc_id:{kind},learning:boolean>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        words, counts, flat = shared.value
        numbers, value = {w: i for i, w in enumerate(words)}, np.append(_value(counts), 0.0)
        task = TaskContext.get().partitionId()
        for number, chunk in enumerate(_chunks(batches)):
            key, texts, figures, rare = (task << 20) | number, [], [], []
            for b in chunk:
                for learn, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    own = lower_words(data)
                    ids = _ids(own, numbers)
                    off = np.flatnonzero(ids < 0)
                    if len(off):
                        r = np.empty(len(off), _RARE)
                        r["h"] = [xxhash.xxh64_intdigest(own[i]) for i in off.tolist()]
                        r["doc"] = 2 * len(texts) + bool(learn)
                        rare.append(r)
                    logs = value[ids]
                    figures.append((len(ids), len(ids) - len(off), logs.sum(), logs[ids >= gru.SHORT].sum(), int(((ids < 0) | (ids >= gru.SHORT)).sum())))
                    texts.append(_short(ids))
            model = gru.score(flat, texts)
            info = np.array([(*f, m) for f, m in zip(figures, model)], "<f8").reshape(-1, 6)
            ids = pa.concat_arrays([b.column(0) for b in chunk])
            flags = pa.concat_arrays([b.column(1) for b in chunk])
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.StructArray.from_arrays([ids, flags], ["doc_id", "learning"]))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array(["texts"]), pa.array([key % parts], pa.int32()), pa.array([info.tobytes()], pa.binary()), listed], ["key", "kind", "bucket", "data", "docs"])
            if rare:
                r = np.concatenate(rare)
                bucket = (r["h"] >> np.uint64(20)) % np.uint64(parts)
                order = np.argsort(bucket, kind="stable")
                r, bucket = r[order], bucket[order]
                edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
                blobs = [x.tobytes() for x in np.split(r, edges[1:])]
                n = len(blobs)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(["rare"] * n), pa.array(bucket[edges].astype(np.int32)), pa.array(blobs, pa.binary()), pa.nulls(n, listed.type)], ["key", "kind", "bucket", "data", "docs"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held = [], []
        for b in batches:
            rare = np.array(b.column("kind").to_pylist()) == "rare"
            yield b.filter(pa.array(~rare)).drop_columns(["bucket"])
            for key, data in zip(b.column("key").filter(pa.array(rare)).to_pylist(), b.column("data").filter(pa.array(rare)).to_pylist()):
                keys.append(key), held.append(np.frombuffer(data, _RARE))
        if not held:
            return
        all_ = np.concatenate(held)
        _, where = np.unique(all_["h"], return_inverse=True)
        found = np.bincount(where, weights=all_["doc"] & 1)[where]
        at = 0
        for key, own in zip(keys, held):
            c, doc = found[at : at + len(own)], own["doc"] >> 1
            at += len(own)
            which, index = np.unique(doc, return_inverse=True)
            out = np.empty(len(which), _SUM)
            out["doc"], out["known"], out["log"] = which, np.bincount(index, weights=c > 0), np.bincount(index, weights=_value(c))
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array(["sums"]), pa.array([out.tobytes()], pa.binary()), pa.nulls(1, b.schema.field("docs").type)], ["key", "kind", "data", "docs"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, sums = {}, {}
        for b in batches:
            for i, (key, kind, data) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "kind", "data")))):
                if kind == "texts":
                    texts[key] = (np.frombuffer(data, "<f8").reshape(-1, 6), b.column("docs")[i].values)
                else:
                    sums.setdefault(key, []).append(np.frombuffer(data, _SUM))
        for key, (info, rows) in texts.items():
            known, log = np.zeros(len(info)), np.zeros(len(info))
            for s in sums.get(key, ()):
                known[s["doc"]] += s["known"]
                log[s["doc"]] += s["log"]
            n, others = info[:, 0], info[:, 4]
            base = info[:, 2] + log - n * whole
            score = info[:, 5] / math.log(10) + info[:, 3] + log - others * rest
            yield pa.RecordBatch.from_arrays([rows.field(0), rows.field(1), pa.array(n.astype(np.int64)), pa.array((info[:, 1] + known).astype(np.int64)), pa.array(base), pa.array(score)], ["doc_id", "learning", "n_tokens", "n_known", "base_score", "score"])

    rows = docs.select("doc_id", learning.alias("learning"), utf8().alias("b"))
    dealt = rows.mapInArrow(run, head).repartition(parts, "bucket")
    looked = dealt.mapInArrow(look_up, head.replace(" bucket int,", "")).repartition(parts, "key")
    return looked.mapInArrow(finish, f"{fields}, n_tokens bigint, n_known bigint, base_score double, score double")


def score_corpus(docs: DataFrame, learning: Column) -> DataFrame:
    """Learn from the rows that ``learning`` holds for and score all; see ``score``, and train_tokens."""
    bound_batches(docs.sparkSession)
    texts = docs.where(learning).select(utf8().alias("b"))
    parts = _parts(docs.select(utf8().alias("b")))
    vocabulary = Vocabulary(count_words(texts, parts))
    flat = learn(texts, vocabulary)
    return score(docs, vocabulary, flat, learning, parts).withColumn("train_tokens", F.lit(vocabulary.tokens).cast("bigint"))
