"""Cross-tokenizer alignment: tokens of two tokenizers on one text, matched by the byte offsets at which they end.

Each text is encoded by A (byte-level BPE, on a space and the text) and by B (sentencepiece, which adds that space itself). The
ends of the tokens are two rising lists over the same bytes. The shorter list drives: each of its ends is looked for in the
longer one by exponential steps from the place of the one before, then by binary search within the last step. Ends in both
lists cut the tokens into groups; the difference of neighbouring ranks is the range of tokens that an end's token overlaps.

Two tokens that end together are linked. How many links each pair of ids has in the whole corpus is counted by Spark. The counts go
back to the documents in two ways: at most ``HEAVY`` of the most frequent pairs are broadcast (they hold most links and are the
only keys that many documents share), all others are joined by pair.

Defined results: null and empty texts, and those whose tokens do not spell a space and the text (a U+2581 in the text), have no
tokens, and zeros everywhere; rows with the same id keep their rows, a null id stays null; of equal counts all are best; an
empty table gives an empty one. Only ``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logkiln.llm.common import bound_batches
from logkiln.staging import stage

#: Most pairs that are broadcast with their counts.
HEAVY = 1 << 16
#: Letters that are aligned at once, unless one text has more, and tokens of different words that a task holds.
BATCH_LETTERS, POOL = 1 << 20, 1 << 20
#: Between two words: a space behind a character that is none, unless the text ends with it.
BETWEEN = re.compile(r"(?<=\S) (?=[\s\S])")
#: The pattern by which byte-level BPE cuts texts before its merges; a fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The letter by which byte-level vocabularies write each byte: itself where it can be seen, else the next from U+0100 on."""
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    other = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteLevel:
    """Tokenizer A: ids of a space and the text, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters, special = byte_letters(), {t["id"] for t in file.get("added_tokens", ()) if t["special"]}
        vocabulary = file["model"]["vocab"]
        self.bytes = [b""] * (max([*vocabulary.values(), *special]) + 1)
        for token, i in vocabulary.items():
            if i not in special:
                self.bytes[i] = bytes(letters[c] for c in token)
        ranked = self._by_ranks(file, special)
        self.usual, self.encode = ranked is not None, ranked or self._by_file(path)

    def _by_ranks(self, file: dict, special: set[int]) -> Callable[[str], list[int]] | None:
        """Several times faster, and the same where ids are the order of merges and texts are cut in the usual way."""
        import tiktoken

        before, model = file.get("pre_tokenizer") or {}, file["model"]
        vocabulary_ids = model["vocab"].values()
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        plain = plain and not file.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
        plain = plain and all(len(self.bytes[i]) == 1 for i in range(256)) and len(set(vocabulary_ids) - special) == 256 + len(merges)
        if not plain or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        ranks = {b: i for i, b in enumerate(self.bytes) if i not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _by_file(self, path: str) -> Callable[[str], list[int]]:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.encode_special_tokens = True
        return lambda text: own.encode(text, add_special_tokens=False).ids


class Pieces:
    """Tokenizer B: ids of the text, and the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
        self.encode = lambda text: model.encode(text, num_threads=1)


def gallop(short: list[int], long: list[int]) -> list[int]:
    """For each end of ``short`` the place of the first end of ``long`` that is not smaller. Both rise and have the same last end."""
    ranks, at, n = [], 0, len(long)
    for x in short:
        if long[at] < x:
            low, step, probe = at, 1, at + 1
            while probe < n and long[probe] < x:
                step *= 2
                low, probe = probe, probe + step
            at = bisect_left(long, x, low + 1, min(probe, n))
        ranks.append(at)
    return ranks


def meet(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of the common ends in two lists of ends, and how many pairs of tokens overlap."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    ranks = np.array(gallop(short.tolist(), long.tolist()))
    common = long[ranks] == short
    # The token of an end overlaps from the rank of the end before (its next one, if that end is common) to its own rank.
    first = np.concatenate([[0], ranks[:-1] + common[:-1]])
    overlaps = int((ranks - first + 1).sum())
    mine, theirs = np.flatnonzero(common), ranks[common]
    return (mine, theirs, overlaps) if short is a else (theirs, mine, overlaps)


class Words(dict):
    """The tokens of the words of a text, by both tokenizers, each different word encoded once.

    A word is a space and what follows up to the next space behind a character that is none, or the end. No token of either side reaches over such a
    place: the pattern of A starts a new token there, and ``Aligner`` looks that no piece of B has a space after another character.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.tokenizers, self.ids, self.ends, self.whole = (a, b), (array("i"), array("i")), (array("q", [0]), array("q", [0])), array("b")

    def __missing__(self, word: str) -> int:
        found = [self.tokenizers[0].encode(" " + word), self.tokenizers[1].encode(word)]
        data = b" " + word.encode()
        self.whole.append(all(b"".join(map(t.bytes.__getitem__, f)) == data for t, f in zip(self.tokenizers, found)))
        for ids, ends, f in zip(self.ids, self.ends, found):
            ids.extend(f)
            ends.append(len(ids))
        self[word] = len(self.whole) - 1
        return self[word]

    def tokens(self, side: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words numbered ``words``, one after another, and how many each has."""
        ids, ends = np.array(self.ids[side], np.int64), np.array(self.ends[side], np.int64)
        sizes = ends[words + 1] - ends[words]
        before = np.cumsum(sizes) - sizes
        return ids[np.repeat(ends[words] - before, sizes) + np.arange(int(sizes.sum()))], sizes


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sums of ``values`` up to each of ``ends``, with that up to none before them."""
    return np.concatenate([[0], np.cumsum(values)])[np.concatenate([[0], ends])]


class Aligner:
    """Both tokenizers in one task."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.lengths = [np.array([len(x) for x in t.bytes], np.int64) for t in (self.a, self.b)]
        self.base = len(self.b.bytes)
        # Each id as text and a comma, or the sign that ends its side of a group; six bytes are enough for five digits.
        sides = ((len(self.a.bytes), "|"), (self.base, ";"))
        texts = [f"{i}{sign}".encode() for n, end in sides for i in range(n) for sign in (",", end)]
        self.text_sizes = np.array([len(x) for x in texts])
        self.texts = np.array(texts).view(np.uint8).reshape(len(texts), -1)
        self.apart = self.a.usual and not any(re.search(rb"[^ ] ", x) for x in self.b.bytes)
        self.words = Words(self.a, self.b)

    def align(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """For each text numbers of A tokens, B tokens, groups and overlaps, and the groups as text; then pairs, times, and their ends by text."""
        if len(self.words.ids[0]) > POOL:
            self.words = Words(self.a, self.b)
        numbered = [list(map(self.words.__getitem__, BETWEEN.split(t) if self.apart else [t])) if t else [] for t in texts]
        whole = self.words.whole
        numbered = [n if all(map(whole.__getitem__, n)) else [] for n in numbered]
        words, last = np.array([w for n in numbered for w in n], np.int64), np.cumsum([len(n) for n in numbered])
        (a, in_a), (b, in_b) = (self.words.tokens(k, words) for k in (0, 1))
        start_a, start_b = _sums(in_a, last), _sums(in_b, last)
        end_a, end_b = np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b])
        at_a, at_b, overlaps = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(texts), np.int64)
        for k in np.flatnonzero(np.diff(start_a)):
            x, y, overlaps[k] = meet(end_a[start_a[k] : start_a[k + 1]], end_b[start_b[k] : start_b[k + 1]])
            at_a.append(x + start_a[k]), at_b.append(y + start_b[k])
        groups = np.zeros(len(texts), np.int64)
        groups[np.diff(start_a) > 0] = [len(x) for x in at_a[1:]]
        at_a, at_b = np.concatenate(at_a), np.concatenate(at_b)
        text = np.repeat(np.arange(len(texts)), groups)
        span = len(self.a.bytes) * self.base
        found, times = np.unique(text * span + a[at_a] * self.base + b[at_b], return_counts=True)
        ends = np.searchsorted(found, np.arange(len(texts) + 1) * span)
        written = self._written(a, b, at_a, at_b, start_a + start_b)
        return [np.diff(start_a), np.diff(start_b), groups, overlaps], written, found % span, times, ends

    def _written(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The groups of each text: a group's A tokens follow all B tokens of the groups before it, its B tokens all A tokens so far."""
        group_a, group_b = np.repeat(np.arange(len(at_a)), np.diff(at_a, prepend=-1)), np.repeat(np.arange(len(at_b)), np.diff(at_b, prepend=-1))
        before = np.concatenate([[0], at_b + 1])
        signs_a, signs_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        signs_a[at_a], signs_b[at_b] = 1, 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + before[group_a]] = 2 * a + signs_a
        codes[np.arange(len(b)) + at_a[group_b] + 1] = 2 * (len(self.a.bytes) + b) + signs_b
        sizes = self.text_sizes[codes]
        flat = self.texts[codes][np.arange(self.texts.shape[1]) < sizes[:, None]].tobytes()
        ends = _sums(sizes, starts[1:]).tolist()
        return [flat[s : max(s, e - 1)] for s, e in zip(ends, ends[1:])]


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each of ``docs``: numbers of tokens, groups and overlaps, ``groups`` as text, and pair codes with times linked."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for rows in batches:
            # Long texts are worked a few at a time, as their tokens take more room than they do.
            size, at = np.cumsum([0, *(len(x.as_py() or "") for x in rows.column(1))]), 0
            while at < rows.num_rows:
                n = max(1, int(np.searchsorted(size, size[at] + BATCH_LETTERS, "right")) - 1 - at)
                b, at = rows.slice(at, n), at + n
                numbers, groups, pairs, times, ends = aligner.align(b.column(1).to_pylist())
                ends = pa.array(ends.astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (pairs, times.astype(np.int32))]
                columns = [b.column(0), *map(pa.array, numbers), pa.array(groups, pa.binary()).cast(pa.string()), *lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_overlaps", "groups", "pairs", "times"])

    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_overlaps bigint, groups string, pairs array<bigint>, times array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def pair_counts(linked: DataFrame, base: int) -> DataFrame:
    """Rows (pair, n, best): links in the corpus, and whether no other pair of the same B id has more."""
    counts = linked.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("n"))
    counts = stage(counts)
    most = counts.groupBy((F.col("pair") % base).alias("b")).agg(F.max("n").alias("most"))
    # One row for each B id at most: bounded by the vocabulary.
    return stage(counts.join(F.broadcast(most), F.col("pair") % base == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def heavy_from(counts: DataFrame, most: int) -> int:
    """The smallest count from which on at most ``most`` pairs are as frequent; found on a histogram of powers of 2 ** (1/8)."""
    step = F.floor(F.log2("n") * 8)
    sizes = counts.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.max("n").alias("top"), F.min("n").alias("low")).collect()
    total, low = 0, None
    for r in sorted(sizes, key=lambda r: -r["step"]):
        total += r["pairs"]
        if total > most:
            break
        low = r["low"]
    return low if low is not None else (max(r["top"] for r in sizes) + 1 if sizes else 1)


def link_statistics(docs: DataFrame, a_path: str, b_path: str, heavy: int = HEAVY) -> DataFrame:
    """Each row of ``docs`` with its alignment and what its links count for in the whole corpus."""
    rows = align(docs, a_path, b_path).withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()))
    counts = pair_counts(rows, _pieces(b_path))
    low = heavy_from(counts, heavy)
    links = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    frequent, rare = F.broadcast(counts.where(F.col("n") >= low)), counts.where(F.col("n") < low)
    common = links.join(frequent, "pair")
    other = links.join(frequent, "pair", "left_anti").join(rare, "pair")
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum")]
    each = [part.groupBy("row").agg(*sums) for part in (common, other)]
    total = each[0].unionByName(each[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    numbers = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_best", "count_sum")]
    return rows.join(total, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", F.coalesce(F.aggregate("times", F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0)).alias("n_links"),
        *numbers, "groups_sha256", "n_overlaps",
    )


def _pieces(path: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
