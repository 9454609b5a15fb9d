"""Line templates: fields of a repeating vocabulary, equal lines and short ones."""

import numpy as np
import pytest

from logkiln.llm import templates

NAMES, CITIES = [f"n{x}" for x in "abcdefgh"], [f"c{x}" for x in "abcdef"]


def left(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    return {r.doc_id: r.text for r in templates.drop_repeated_lines(docs).collect()}


def letter(rng, skewed):
    first, last, city = (v[min(int(rng.geometric(0.5)) - 1, len(v) - 1)] if skewed else rng.choice(v) for v in (NAMES, NAMES, CITIES))
    return f"Please contact our agent {first} {last} in {city} for all further details about your order today"


@pytest.mark.parametrize("skewed", [False, True])
@pytest.mark.parametrize("n", [10, 400])
def test_fields_with_values_that_recur(spark, n, skewed):
    rng = np.random.default_rng(n)
    got = left(spark, [(i, letter(rng, skewed)) for i in range(n)])
    assert [i for i, t in got.items() if t] == [0]


def test_two_templates_of_one_leaf(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(90):
        a, b = rng.choice(NAMES, 2)
        kinds = (f"we are sorry that {a} could not come to the great meeting {b}", f"we are sorry but {a} has lost two old books about history {b}", f"we are sorry if {a} saw nobody near that green river house {b}")
        rows.append((i, kinds[i % 3]))
    lone = [(100 + i, "we are sorry " + " ".join(f"u{x}" for x in "abcdefghij"[i:] + "klmnopqrst"[:i])) for i in range(2)]
    got = left(spark, rows + lone)
    assert sorted(i for i, t in got.items() if t) == [0, 1, 2, 100, 101]


def test_equal_and_short_lines(spark):
    passage = " ".join(f"word{'abcdefghijklmnopqrstuvwxyz'[i % 26]}{'xyz'[i // 26]}" for i in range(60))
    rows = [(i, f"Read more\n7\n{'Share this' if i < 9 else 'Rare one'}\n" + (passage if i in (3, 8) else "")) for i in range(12)]
    got = left(spark, rows)
    assert [i for i, t in got.items() if passage in t] == [3] and [i for i, t in got.items() if "Read more" in t] == [0]
    assert all("7" in t for t in got.values()) and sum("Share this" in t for t in got.values()) == 9
