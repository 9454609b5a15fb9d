"""Quality rules: a learned decision list over text statistics.

``statistics`` gives the figures of each whole text. ``learn`` grows rules by sequential covering on a
bounded sample of labelled rows: conditions (a statistic at most or at least a threshold) are
added while they raise the information gain, pruned from the end on held-back rows, and a rule is kept
if it is precise there; what it covers is taken away (laid aside while growing, if it is not kept) and the next rule is sought. The list becomes
one ordered Spark conditional expression, so applying it costs no Python.

A row counts as bad if its quality label is 0 or its toxic label is 1. Since toxic words are in no
list, ``marked_words`` learns them: words and beginnings of words that occur in enough labelled bad rows and in hardly
any good one. How many a text has, their share of its words, and the largest share of bad rows that one of them was found in, are
statistics like the others; each half of the sample is counted with words learned from the other half, so rules know how far to trust them.

Defined results: a null or empty text has zero statistics and fails the base; labels that are null count as
unknown and are not learned from, as are ids with contradicting labels; without labels the list is empty
and keeps what passes the base. Equal rows get equal verdicts. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.llm.common import bound_batches, utf8
from logkiln.staging import stage

#: Labelled rows that rules and marked words are learned from, at most; those with the smallest hashes of their ids.
SAMPLE_ROWS = 12_000
MAX_WORDS, MAX_RULES, MAX_CONDITIONS, THRESHOLDS = 400, 16, 4, 48
PRECISION = 0.95
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_SPLIT = re.compile("[\x20\x09-\x0d]+")
#: Lengths of the beginnings of words that may be marked; a whole word is marked as itself and a blank.
STARTS = range(4, 9)
_EDGES = ".,;:!?\"'()[]#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What rules are made of: ratios per word or character, so that length matters only where it is meant.
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "mark_ratio", "digit_ratio", "distinct_ratio", "end_ratio", "marked_words", "mark_support", "mark_density")


def repeat_words(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in some window of three that occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    x = ids.astype(np.int64)
    if kinds < 1 << 20:
        grams = (x[:-2] * kinds + x[1:-1]) * kinds + x[2:]
    else:
        _, pairs = np.unique(x[:-1] * kinds + x[1:], return_inverse=True)
        grams = pairs[:-1] * kinds + x[2:]
    _, where, counts = np.unique(grams, return_inverse=True, return_counts=True)
    hit = counts[where] > 1
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= hit
    return int(covered.sum())


def _mark(word: str, marked: Mapping[str, float]) -> float:
    """The share that goes with a word or one of its beginnings, or 0."""
    for k in STARTS:
        if len(word) > k and (share := marked.get(word[:k])):
            return share
    return marked.get(word + " ", 0.0)


def text_statistics(text: str, marked: Mapping[str, float] = {}) -> tuple:
    """The counts of ``COUNTS``, then the figures of ``FEATURES``."""
    words = [w for w in _SPLIT.split(text) if w]
    n = len(words)
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    lines, before, dup = 0, set(), 0
    for line in text.split("\n"):
        if line and line.strip(" \t\n\r\x0b\x0c"):
            lines += 1
            dup += line in before
            before.add(line)
    chars = sum(map(len, words))
    symbols = len(_SYMBOLS.findall(text))
    repeats = repeat_words(ids, len(seen))
    per, perc = max(n, 1), max(chars, 1)
    hits = [_mark(w.lower().strip(_EDGES), marked) for w in seen] if marked else []
    flagged = [x for x in hits if x]
    among = sum(map(bool, map(hits.__getitem__, ids.tolist()))) if flagged else 0
    head = (n, chars, symbols, dup, repeats)
    return head + (
        float(n), chars / per, symbols / per, dup / max(lines, 1), repeats / per, sum(map(str.isupper, words)) / per,
        (text.count("!") + text.count("?")) / per, sum(map(str.isdigit, words)) / per, len(seen) / math.sqrt(per),
        text.count(".") / per, float(len(flagged)), max(flagged, default=0.0), among / per,
    )


def statistics(docs: DataFrame, marked: Mapping[str, float] = {}) -> DataFrame:
    """Rows (doc_id, COUNTS as bigint, features as a struct ``f`` of doubles)."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", f struct<" + ", ".join(f"{c}:double" for c in FEATURES) + ">"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [text_statistics(x.as_py().decode("utf-8", "replace"), marked) for x in b.column(1)]
            columns = list(zip(*rows)) if rows else [()] * (len(COUNTS) + len(FEATURES))
            counts = [pa.array(c, pa.int64()) for c in columns[: len(COUNTS)]]
            features = pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in columns[len(COUNTS) :]], list(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, features], ["doc_id", *COUNTS, "f"])

    return docs.select("doc_id", utf8().alias("b")).mapInArrow(run, schema)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


# --- learning -------------------------------------------------------------------------------


def labelled_sample(labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, bad): ids with one clear verdict, those with the smallest hashes, ``rows`` at most."""
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 0)
    one = labels.select("doc_id", bad.alias("bad")).where("bad IS NOT NULL AND doc_id IS NOT NULL")
    clear = one.groupBy("doc_id").agg(F.min("bad").alias("bad"), F.max("bad").alias("most")).where("bad = most").select("doc_id", "bad")
    return clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def term_counts(texts: DataFrame, least: int = 5) -> DataFrame:
    """Rows (t, b0, n0, b1, n1): bad rows and all rows of (text, bad, half) with a word or beginning of one, by half.

    Only terms of ``least`` or more bad rows. Written once, as all sets of marked words come from it.
    """
    words = F.array_distinct(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "[\x20\x09-\x0d]+"), lambda w: F.btrim(w, F.lit(_EDGES))))

    def terms(w: Column) -> Column:
        return F.array(*[F.when(F.length(w) > k, F.substring(w, 1, k)) for k in STARTS], F.when(w != "", F.concat(w, F.lit(" "))))

    each = texts.select("bad", "half", F.explode(F.array_distinct(F.flatten(F.transform(words, terms)))).alias("t")).where("t IS NOT NULL")
    by_half = [f(F.when(F.col("half") == h, F.col("bad"))).alias(f"{c}{h}") for h in (0, 1) for c, f in (("b", F.sum), ("n", F.count))]
    counted = each.groupBy("t").agg(*by_half).fillna(0)
    return stage(counted.where(F.col("b0") + F.col("b1") >= least))


def marked_words(counts: DataFrame, bad: list[int], halves: tuple[int, ...] = (0, 1), least: int = 5, purity: float = 0.93, most: int = MAX_WORDS) -> dict[str, float]:
    """Words and beginnings of words that ``least`` or more bad rows of these halves hold, and hardly any good row.

    ``counts`` are those of ``term_counts``, ``bad`` the numbers of bad rows by half. With each term goes the share of
    bad rows that hold it. A beginning stands for the longer terms that start with it.
    """
    b, n = (sum((F.col(f"{c}{h}") for h in halves), F.lit(0)) for c in "bn")
    pure = counts.select("t", b.alias("b"), n.alias("n")).where((F.col("b") >= least) & (F.col("b") >= purity * F.col("n")))
    part = F.explode(F.array(*[F.when(F.length(F.rtrim("t")) > k, F.substring("t", 1, k)) for k in STARTS]))
    inner = pure.select("t", part.alias("o")).join(pure.select(F.col("t").alias("o")), "o", "left_semi").select("t").distinct()
    found = pure.join(inner, "t", "left_anti").orderBy(F.desc("b"), "t").limit(most).collect()
    rows = sum(bad[h] for h in halves)
    return {r["t"]: r["b"] / rows for r in found}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v >= self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        v = F.col("f")[self.feature]
        return v >= self.threshold if self.above else v <= self.threshold


def _covered(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> tuple[Condition, ...]:
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(x), bool)
    while len(rule) < MAX_CONDITIONS and not bad[inside].all():
        p, n = bad[inside].sum(), inside.sum()
        best, choice = 1e-9, None
        for j, name in enumerate(FEATURES):
            values = x[inside, j]
            own = bad[inside]
            cuts = np.unique(np.concatenate([np.quantile(values, np.linspace(0, 1, THRESHOLDS), method="nearest"), np.quantile(values[own], np.linspace(0, 1, THRESHOLDS), method="nearest")]))
            for above in (True, False):
                hit = values[:, None] >= cuts if above else values[:, None] <= cuts
                pos, total = hit[own].sum(axis=0), hit.sum(axis=0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pos > 0, pos * (np.log2(pos / total) - math.log2(p / n)), 0)
                k = int(np.argmax(gain))
                if gain[k] > best:
                    best, choice = gain[k], Condition(name, above, float(cuts[k]))
        if choice is None:
            break
        rule += (choice,)
        inside &= choice.holds(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, seed: int = 7, precision: float = PRECISION) -> list[tuple[Condition, ...]]:
    """An ordered list of rules for bad rows."""
    order = np.random.default_rng(seed).random(len(x))
    held = order < 1 / 3
    rules: list[tuple[Condition, ...]] = []
    left, aside = np.ones(len(x), bool), np.zeros(len(x), bool)
    for _ in range(2 * MAX_RULES):
        grow, prune = left & ~held & ~aside, left & held
        if bad[grow].sum() < 5 or len(rules) == MAX_RULES:
            break
        rule = _grow(x[grow], bad[grow])

        def worth(r: tuple[Condition, ...]) -> float:
            c = _covered(r, x[prune])
            p, n = bad[prune][c].sum(), (~bad[prune][c]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        c = _covered(rule, x[prune])
        if not rule:
            break
        if not c.any() or bad[prune][c].mean() < precision:
            aside |= _covered(rule, x)
            continue
        rules.append(rule)
        left &= ~_covered(rule, x)
    return rules


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The list as one ordered conditional: true if the text is kept."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def describe(rules: list[tuple[Condition, ...]]) -> list[str]:
    return [" and ".join(f"{c.feature} {'>=' if c.above else '<='} {c.threshold:g}" for c in r) for r in rules]


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], list[tuple[Condition, ...]]]:
    """Marked words and rules from a bounded sample of labelled rows."""
    sample = labelled_sample(labels, rows)
    # At most ``rows`` ids and flags are broadcast. Their texts are
    # written once, so that what follows reads the sample and not the documents.
    half = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)).cast("int").alias("half")
    texts = stage(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("*", half))
    terms, bad = term_counts(texts), [0, 0]
    for r in texts.groupBy("half").agg(F.sum("bad").alias("bad")).collect():
        bad[r["half"]] = r["bad"]
    marked = marked_words(terms, bad)
    # Each half is counted with the words of the other, so that rules trust marked words as far as new texts bear them out.
    counted = [statistics(texts.where(F.col("half") == h), marked_words(terms, bad, (1 - h,))) for h in (0, 1)]
    figures = counted[0].unionByName(counted[1]).join(F.broadcast(texts.select("doc_id", "bad").distinct()), "doc_id").select("bad", "f.*").toPandas()
    if not len(figures):
        return marked, []
    figures = figures.sort_values(list(figures.columns))
    return marked, learn(figures[list(FEATURES)].to_numpy(float), figures["bad"].to_numpy() == 1)


def judge(docs: DataFrame, marked: Mapping[str, float], rules: list[tuple[Condition, ...]]) -> DataFrame:
    """(doc_id, COUNTS, base_failed, kept)."""
    figures = statistics(docs, marked)
    return figures.select("doc_id", *COUNTS, base_failed().alias("base_failed"), (~base_failed() & verdict(rules)).alias("kept"))
