"""Stages of the pipeline against plain versions."""

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from logkiln.llm import neardup, templates


def jaccard(a, b):
    def cut(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    a, b = cut(a), cut(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_survivors(rows):
    """One row of each group of linked rows: the smallest id (null last), of those any text."""
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and jaccard(rows[i][1], rows[j][1]) >= 0.8:
                group = [group[i] if g == group[j] else g for g in group]
    heads = {}
    for g, (i, _) in zip(group, rows):
        heads.setdefault(g, []).append((i is None, i or 0))
    return sorted(min(x) for x in heads.values())


def edited(rng, words, n):
    out = list(words)
    for at in rng.choice(len(out), n, replace=False):
        out[at] = f"new{rng.integers(1 << 40)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def near_rows():
    rng = np.random.default_rng(5)
    rows, number = [], 0
    for size in (60, 150, 400, 900):
        for edits in (0.002, 0.005, 0.01, 0.02, 0.022, 0.024, 0.03):
            for _ in range(2):
                words = [f"w{x}" for x in rng.integers(0, 4000, size)]
                for text in (" ".join(words), edited(rng, words, max(1, round(size * edits)))):
                    rows.append((number, text))
                    number += 1
    return rows


def test_near_copies_like_brute_force(spark, near_rows):
    docs = spark.createDataFrame(near_rows, "doc_id bigint, text string").repartition(4)
    got = corpus_pipeline.one_of_each_group(spark, docs, None)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in got.collect()) == plain_survivors(near_rows)


def test_near_copies_that_are_all_joined(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text), (2, text + " more"), (3, "less " + text), (4, "other words"), (5, None)], "doc_id bigint, text string")
    calls = []
    monkeypatch.setattr(neardup, "components", lambda edges, of=neardup.components: calls.append(edges) or of(edges))
    assert sorted(r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, None).collect()) == [1, 4, 5]
    # Of buckets and of their links; nothing is left to be compared.
    assert len(calls) == 2


def test_near_copies_in_blocks(spark, monkeypatch):
    """A chain of copies of copies, and many that only the pairwise round can join."""
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in range(200)]
    rows = [(0, " ".join(words))]
    for i in range(1, 40):
        near = rows[int(rng.integers(0, i))][1].split()
        rows.append((i, edited(rng, near, int(rng.integers(2, 6)))))
    monkeypatch.setattr(neardup, "BLOCK_NODES", 4)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted((False, r.doc_id) for r in corpus_pipeline.one_of_each_group(spark, docs, None).collect()) == plain_survivors(rows)


def test_survivor_is_chosen_by_component(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (1, c), (1, d), (2, c), (None, d), (3, ""), (4, None), (5, "x y"), (5, "x y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in corpus_pipeline.one_of_each_group(spark, docs, None).collect())
    assert got == sorted([("None", a), ("None", b), ("1", c), ("1", d), ("3", ""), ("5", "x y")])
    assert corpus_pipeline.one_of_each_group(spark, docs.where("false"), None).count() == 0


#: Names that the stages and operators use for columns of their own.
NAMES = "node _node head root places n_dropped_lines _row _line_key key score lang_pred bits_per_byte document _letter _bytes b link u v".split()


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_of_any_name_stay(spark, tmp_path, stage):
    text = "the old house by the river stood empty\nuntil the spring came and the road was mended"
    other = "la vieille maison au bord de la rivière était vide\nmais le printemps est revenu cette année"
    rows = [(i, f"{t} {i * 'x'}", l, "s", len(t)) for i, (t, l) in enumerate([(text, "en"), (other, "fr")] * 20)] + [(None, None, None, None, None), (90, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    spark.createDataFrame([(1, "what is the height of the tower in the middle of the old town")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    plain = stage(spark, docs, str(tmp_path))
    more = docs.select("*", *[F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in NAMES])
    got = stage(spark, more, str(tmp_path))
    assert got.columns == more.columns
    key = lambda r: (str(r.doc_id), str(r.text))
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))
    assert all(r[c] == f"{c} {-1 if r.doc_id is None else r.doc_id}" for r in got.collect() for c in NAMES)
    assert stage(spark, more.where("false"), str(tmp_path)).count() == 0


def test_count_of_dropped_lines_takes_the_place_of_another(spark):
    docs = spark.createDataFrame([(1, "a shared line of words\nx", "own"), (2, "a shared line of words\ny", "own")], "doc_id bigint, text string, n_dropped_lines string")
    got = {r.doc_id: (r.text, r.n_dropped_lines) for r in templates.drop_repeated_lines(docs).collect()}
    assert got == {1: ("a shared line of words\nx", 0), 2: ("y", 1)}


@pytest.mark.parametrize("seed", [2012, 16221])
def test_near_copies_at_the_limit_are_candidates(spark, seed):
    """Pairs of similarity 0.8 to the digit that 30 bands left in no common bucket."""
    rng = np.random.default_rng(seed)
    words = [f"w{x}" for x in rng.integers(0, 1 << 30, 49)]
    text = " ".join(words)
    words[24] = "new"
    assert jaccard(text, " ".join(words)) == 0.8
    docs = spark.createDataFrame([(1, text), (2, " ".join(words))], "doc_id bigint, text string")
    assert [r.doc_id for r in corpus_pipeline.one_of_each_group(spark, docs, None).collect()] == [1]
