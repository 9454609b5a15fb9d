"""Language by prediction by partial matching: which language's byte model gives the shortest code.

Bytes (ASCII letters lower-cased) are the symbols, all ``BYTES`` of them. Each language has a context tree of depth ``DEPTH``: counts of bytes after the last 0 to
3 bytes. A byte is coded in the longest context that was seen; where it is new there, an escape
is paid and the context shortened (method C: in a context with n bytes, d of them different, a byte
seen c times has c / (n + d), the escape d / (n + d)); below the empty context all bytes are equal.
The trees are frozen after learning, so the code length of a byte depends on four bytes only. Trees are sparse: sorted numbers of the four bytes
that were seen, with their counts, and all else follows from those. For scoring, the code lengths of what any language of a slice has seen are written out in a hash table:
a lookup a byte, and shorter contexts for the few that no language has seen.

Learning counts over all labelled texts: a task gives the counts it has found, sums are made by
shuffle. Every language is learned, however many there are: tables of up to ``AT_ONCE``, with ``NUMBERS`` code lengths or one language, are sent out
together, and with more every text is coded by one such slice after the other; the results of all slices are put together by row.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text
if nothing was learned. Ties go to the language that sorts first. The score is the weight of the
prediction among the languages, at equal priors. Repeated rows each get their result. A language is learned from one byte on;
one whose texts are all empty is not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logkiln.llm.common import bound_batches, utf8
from logkiln.staging import stage

BYTES, DEPTH = 256, 3
#: The alphabet of ``code_lengths``, small enough to write out every code length.
SYMBOLS = 32
#: Languages whose tables are sent out at once at most, and code lengths of those tables: 4 bytes each, in every worker.
AT_ONCE, NUMBERS = 64, 1 << 25
#: Bytes of a piece of a text and of a group of pieces that are worked together, and entries of counts that a task holds before it gives them.
PIECE, GROUP, HELD = 1 << 16, 1 << 17, 1 << 21
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOW = np.uint64((1 << 32) - 1)


# --- trees --------------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """What a language has seen at one depth: grams are contexts with the symbol after them, as numbers in order."""

    grams: np.ndarray
    bits: np.ndarray  # of the gram's symbol in its context
    contexts: np.ndarray
    escapes: np.ndarray  # bits of an escape from the context

    def escape(self, contexts: np.ndarray) -> np.ndarray:
        """Bits of an escape, none from contexts that were not seen."""
        at, seen = _found(self.contexts, contexts)
        return np.where(seen, self.escapes[at], np.float32(0))


def _found(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted number stands among the known ones, and whether it does."""
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return at, known[at] == wanted


def tree(grams: np.ndarray, counts: np.ndarray, symbols: int = BYTES) -> list[Level]:
    """The levels of a tree, from counts of grams of the greatest depth in order; those of shorter contexts are their sums."""
    levels = []
    for depth in range(DEPTH + 1):
        # Earlier symbols are summed out.
        own, c = grams, counts.astype(np.float64)
        if depth < DEPTH:
            own, at = np.unique(grams % np.uint32(symbols ** (depth + 1)), return_inverse=True)
            c = np.bincount(at, weights=c)
        contexts, begin, kinds = np.unique(own // np.uint32(symbols), return_index=True, return_counts=True)
        total = np.add.reduceat(c, begin) + kinds
        bits = -np.log2(c / np.repeat(total, kinds))
        levels.append(Level(own, bits.astype(np.float32), contexts, -np.log2(kinds / total).astype(np.float32)))
    return levels


def gram_bits(levels: list[Level], grams: np.ndarray, depth: int = DEPTH, symbols: int = BYTES) -> np.ndarray:
    """Bits of the last symbol of each gram after the ``depth`` symbols before it."""
    if depth < 0:
        return np.full(len(grams), np.log2(symbols), np.float32)
    grams = grams if depth == DEPTH else grams % np.uint32(symbols ** (depth + 1))
    at, seen = _found(levels[depth].grams, grams)
    out = levels[depth].bits[at]
    new = grams[~seen]
    if len(new):
        out[~seen] = levels[depth].escape(new // np.uint32(symbols)) + gram_bits(levels, new, depth - 1, symbols)
    return out


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Bits of a symbol after three others for an alphabet small enough to write them all out; counts by 4-symbol number."""
    symbols, grams = round(len(counts) ** (1 / (DEPTH + 1))), np.flatnonzero(counts).astype(np.uint32)
    if not len(grams):
        return np.full(len(counts), np.log2(symbols))
    return gram_bits(tree(grams, counts[grams], symbols), np.arange(len(counts), dtype=np.uint32), DEPTH, symbols)


# --- tables -------------------------------------------------------------------------------


class Places:
    """Different numbers of 32 bits in a hash table that gives their places."""

    def __init__(self, numbers: np.ndarray):
        width = max(1, int(2 * len(numbers)).bit_length())
        self.shift, self.mask = np.uint32(32 - width), (1 << width) - 1
        self.numbers, self.places = np.zeros(1 << width, np.uint32), np.full(1 << width, -1, np.int32)
        left, slot = np.arange(len(numbers), dtype=np.int32), self._slots(numbers)
        while len(left):
            free = left[self.places[slot[left]] < 0]
            # Of several for one slot one gets it, the others go on.
            self.places[slot[free]] = free
            own = self.places[slot[left]] == left
            self.numbers[slot[left[own]]] = numbers[left[own]]
            left = left[~own]
            slot[left] = (slot[left] + 1) & self.mask

    def _slots(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers * np.uint32(0x9E3779B1)) >> self.shift).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that are not there."""
        slot = self._slots(numbers)
        out = self.places[slot]
        left = np.flatnonzero((self.numbers[slot] != numbers) & (out >= 0))
        while len(left):
            at = slot[left] = (slot[left] + 1) & self.mask
            out[left] = self.places[at]
            left = left[(self.numbers[at] != numbers[left]) & (out[left] >= 0)]
        return out


@dataclass(frozen=True)
class Model:
    """Code lengths of some languages, a column each: of the grams and three-byte numbers that any of them has seen, and of all pairs."""

    languages: tuple[str, ...] = ()  # in order
    grams: Places | None = None
    bits: np.ndarray | None = None  # of the grams, float32
    threes: Places | None = None
    three_bits: np.ndarray | None = None  # of the third byte after the two before it
    three_escapes: np.ndarray | None = None  # from the three bytes as a context
    pair_bits: np.ndarray | None = None
    pair_escapes: np.ndarray | None = None
    rest: DataFrame | None = field(default=None, compare=False)  # the counts of all languages, where more come after these

    def slices(self) -> Iterator[Model]:
        """The model in slices of languages, in order; the driver holds one at a time."""
        part = self
        while True:
            yield replace(part, rest=None)
            if part.rest is None:
                return
            part = _slice(part.rest, part.languages[-1])

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each gram, a column for each language."""
        at = self.grams.find(grams)
        out = self.bits[at]
        new = np.flatnonzero(at < 0)
        if len(new):
            contexts, shorter = grams[new] >> np.uint32(8), grams[new] & np.uint32(0xFFFFFF)
            at, context_at = self.threes.find(shorter), self.threes.find(contexts)
            bits, pairs = self.three_bits[at], np.flatnonzero(at < 0)
            bits[pairs] = self.pair_escapes[shorter[pairs] >> np.uint32(8)] + self.pair_bits[shorter[pairs] & np.uint32(0xFFFF)]
            out[new] = np.where(context_at[:, None] < 0, np.float32(0), self.three_escapes[context_at]) + bits
        return out


def _slice(counted: DataFrame, after: str | None = None) -> Model:
    """The tables of the next languages in order, as many as are sent out at once."""
    later = counted if after is None else counted.where(F.col("lang") > after)
    sizes = later.select("lang", "size").orderBy("lang").limit(AT_ONCE + 1).collect()
    names, total = [], 0
    for r in sizes[:AT_ONCE]:
        total += r["size"]
        if names and total * (len(names) + 1) > NUMBERS:
            break
        names.append(r["lang"])
    if not names:
        return Model()
    trees: list = [None] * len(names)
    for r in counted.where(F.col("lang").isin(*names)).toLocalIterator():
        trees[names.index(r["lang"])] = tree(np.frombuffer(r["grams"], np.uint32), np.frombuffer(r["counts"], np.int64))

    def table(rows: np.ndarray, of) -> np.ndarray:
        out = np.empty((len(rows), len(names)), np.float32)
        for i, levels in enumerate(trees):
            out[:, i] = of(levels, rows)
        return out

    grams = np.unique(np.concatenate([t[3].grams for t in trees]))
    threes = np.unique(np.concatenate([x for t in trees for x in (t[2].grams, t[3].contexts)]))
    pairs = np.arange(BYTES**2, dtype=np.uint32)
    return Model(
        tuple(names), Places(grams), table(grams, gram_bits), Places(threes), table(threes, lambda t, x: gram_bits(t, x, 2)), table(threes, lambda t, x: t[3].escape(x)),
        table(pairs, lambda t, x: gram_bits(t, x, 1)), table(pairs, lambda t, x: t[2].escape(x)), counted if len(sizes) > len(names) else None,
    )


# --- texts --------------------------------------------------------------------------------


def _groups(texts: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts that are worked together: the number of each one's text, the grams, and where each one's begin and end among them.

    Each byte of a text ends one gram; spaces stand before the text. Grams across two pieces lie between an end and the next beginning.
    """
    numbers: list[int] = []
    parts: list[bytes] = []
    size = 0

    def group():
        s = np.frombuffer(b"".join(parts).translate(_FOLD), np.uint8).astype(np.uint32)
        pair = (s[:-1] << np.uint32(8)) | s[1:]
        lengths = np.array([len(x) for x in parts])
        begin = np.cumsum(lengths) - lengths
        return numbers, (pair[:-2] << np.uint32(16)) | pair[2:], begin, begin + lengths - DEPTH

    for i, data in enumerate(texts):
        data = b" " * DEPTH + data
        for at in range(0, len(data) - DEPTH, PIECE):
            parts.append(data[at : at + PIECE + DEPTH])
            numbers.append(i)
            size += len(parts[-1])
            if size >= GROUP:
                yield group()
                numbers, parts, size = [], [], 0
    if parts:
        yield group()


def texts_bits(texts: list[bytes], model: Model) -> np.ndarray:
    """Code length of each text under each language."""
    out = np.zeros((len(texts), len(model.languages)))
    for numbers, grams, begin, end in _groups(texts):
        bounds = np.stack([begin, end], axis=1).reshape(-1)[:-1]
        np.add.at(out, numbers, np.add.reduceat(model.of(grams), bounds, axis=0, dtype=np.float64)[::2])
    return out


def _counted(packed: np.ndarray) -> np.ndarray:
    """Grams with counts, as one number each, put together by gram."""
    packed = np.sort(packed)
    grams = packed >> np.uint64(32)
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return (grams[begin] << np.uint64(32)) | np.add.reduceat(packed & _LOW, begin)


def _grams(texts: list[bytes]) -> np.ndarray:
    """The different grams of some texts with their counts."""
    found = []
    for _, grams, begin, end in _groups(texts):
        own = np.ones(len(grams), bool)
        for shift in range(DEPTH):
            own[end[:-1] + shift] = False
        grams = np.sort(grams[own])
        at = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        found.append((grams[at].astype(np.uint64) << np.uint64(32)) | np.diff(np.append(at, len(grams))).astype(np.uint64))
    return _counted(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of all rows with a language; ``docs`` should hold learning rows only."""
    bound_batches(docs.sparkSession)
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), utf8(text).alias("b"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list[np.ndarray]] = {}
        held = read = 0

        def found() -> Iterator[pa.RecordBatch]:
            for name, parts in total.items():
                packed = parts[0]
                for at in range(0, len(packed), 1 << 16):
                    some = packed[at : at + (1 << 16)]
                    grams = pa.array((some >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(name, pa.string()), len(some)), grams, pa.array((some & _LOW).astype(np.int64))], ["lang", "gram", "n"])

        for b in batches:
            own: dict[str, list[bytes]] = {}
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if data:
                    own.setdefault(name, []).append(data)
            for name, texts in own.items():
                total.setdefault(name, []).append(_grams(texts))
                held += len(total[name][-1])
            read += b.nbytes
            # Counts have 32 bits here.
            if held > 2 * HELD or read > 1 << 31:
                total = {name: [_counted(np.concatenate(parts))] for name, parts in total.items()}
                held = sum(len(parts[0]) for parts in total.values())
                if held > HELD or read > 1 << 31:
                    yield from found()
                    total, held, read = {}, 0, 0
        total = {name: [_counted(np.concatenate(parts))] for name, parts in total.items()}
        yield from found()

    def whole(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
        grams = np.concatenate([np.asarray(x, np.int32) for x in parts["gram"]]).view(np.uint32)
        counts = np.concatenate([np.asarray(x, np.int64) for x in parts["n"]])
        order = np.argsort(grams)
        return pd.DataFrame({"lang": [key[0]], "size": [len(grams)], "grams": [grams[order].tobytes()], "counts": [counts[order].tobytes()]})

    sums = rows.mapInArrow(count, "lang string, gram int, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    lists = sums.groupBy("lang", (F.col("gram") % 64).alias("part")).agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n"))
    return _slice(stage(lists.groupBy("lang").applyInPandas(whole, "lang string, size bigint, grams binary, counts binary")))


def _by_slices(docs: DataFrame, model: Model, text: str, keep: tuple[str, ...]) -> DataFrame:
    """``predict`` with more languages than are sent out at once: each row gets its best language and its weights from every slice."""
    kept = docs.select(F.struct(*keep).alias("_kept"), F.col(text).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    kept = stage(kept)
    found = None
    for part in model.slices():
        own = predict(kept, part, "_text", ("_row",))
        own = stage(own.where("bits_per_byte IS NOT NULL"))
        found = own if found is None else found.unionByName(own)
    # Rates are of one text in each group, so they stand for its bits.
    best = found.groupBy("_row").agg(F.min(F.struct("bits_per_byte", "lang_pred")).alias("_best"), F.collect_list(F.struct("bits_per_byte", "score")).alias("_all"))
    rows = kept.join(best, "_row", "left").withColumn("_n", F.octet_length(utf8("_text")))
    weight = F.aggregate("_all", F.lit(0.0), lambda done, x: done + F.pow(F.lit(2.0), F.greatest((F.col("_best.bits_per_byte") - x["bits_per_byte"]) * F.col("_n"), F.lit(-1000.0))) / x["score"])
    none = F.col("_best").isNull()
    return rows.select(
        "_kept.*", F.when(none, "und").otherwise(F.col("_best.lang_pred")).alias("lang_pred"),
        F.when(none, 0.0).otherwise(1 / weight).alias("score"), F.col("_best.bits_per_byte").alias("bits_per_byte"),
    )


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, lang_pred, score, and bits_per_byte of the best language."""
    if model.rest is not None:
        return _by_slices(docs, model, text, keep)
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # NUMBERS code lengths at most, or those of one language
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    fields = T.StructType([*[T.StructField(c, docs.schema[c].dataType) for c in keep], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            names, scores, rates = ["und"] * b.num_rows, [0.0] * b.num_rows, [None] * b.num_rows
            marked = [i for i, letter in enumerate(b.column(len(keep)).to_pylist()) if letter and model.languages]
            texts = [b.column(len(keep) + 1)[i].as_py() for i in marked]
            for i, data, bits in zip(marked, texts, texts_bits(texts, model)):
                k = int(np.argmin(bits))
                names[i], rates[i] = model.languages[k], float(bits[k] / len(data))
                scores[i] = float(1 / np.exp2(np.maximum(bits[k] - bits, -1000)).sum())
            columns = [b.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rates, pa.float64())], [*keep, "lang_pred", "score", "bits_per_byte"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    return docs.select(*keep, letter.alias("_letter"), utf8(text).alias("_bytes")).mapInArrow(run, fields)
