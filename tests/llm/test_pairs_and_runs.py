"""Token alignment, fast sketches and periodic runs against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from logkiln.llm import alignment, periodic, queries, sketches

A_PATH = B_PATH = None
try:
    import public_tokenizers

    A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
except ModuleNotFoundError:
    pass
with_tokenizers = pytest.mark.skipif(A_PATH is None, reason="the vocabulary files are not here")
CLASHING = "doc_id bigint, text string, node string, b int, k1 int, key string, part int, digest string, words int, n int, a int, p int, h int, row int, pair int, runs string, times string, best string, least string, size int"


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)] + ["Café", "naïve", "日本語", "🙂", "tokens", "running"]
    out = []
    for i in range(120):
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 150)))))
    for i in range(120, 220):  # near copies of some texts, and copies of those
        base = split(out[rng.randrange(0, 20)][1]) or ["x"]
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        out.append((i, " ".join(base).upper() if rng.random() < 0.2 else "  ".join(base)))
    out += [(220 + i, " ".join(base)) for i in range(30)]
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "a"), (304, "A"), (305, "one two three"), (306, "x " * 5000), (307, "ab cd " * 300)]
    out += [(308, "<|endoftext|> and <s> here</s> <unk>"), (309, "an ▁ underline"), (310, "\u0000 zero \r\n lines\n\n\n"), (311, "    four  spaces ")]
    out += [(None, "nameless words that stand here alone"), (None, None), (5, out[5][1]), (6, "another text with the id of six"), (7, out[8][1]), (1230, "a b c d " * 40), (5530, "z y " * 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, "n", 1, 1, "k", 1, "d", 1, 1, 1, 1, 1, 1, 1, "r", "t", "b", "l", 1) for i, t in rows]
    return spark.createDataFrame(full, CLASHING).repartition(4).cache()


def plain_alignment(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a_model.encode_special_tokens = True
    letters = alignment.byte_letters()
    found, counts = [], Counter()
    for i, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a_model.id_to_token(t)) for t in a]
        bytes_b = [bytes([b_model.id_to_piece(t)[3:5] and int(b_model.id_to_piece(t)[3:5], 16)]) if b_model.is_byte(t) else b_model.id_to_piece(t).replace("▁", " ").encode() for t in b]
        if not text or b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
            found.append((i, [], [], [], [], 0))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        links = [(a[j], b[ends_b.index(e)]) for j, e in enumerate(ends_a) if e in set(ends_b)]
        groups, p, q = [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            r, s = ends_a.index(e) + 1, ends_b.index(e) + 1
            groups.append(",".join(map(str, a[p:r])) + "|" + ",".join(map(str, b[q:s])))
            p, q = r, s
        overlaps = sum(max(x - len(m), y - len(n)) < min(x, y) for x, m in zip(ends_a, bytes_a) for y, n in zip(ends_b, bytes_b))
        counts.update(links)
        found.append((i, a, b, groups, links, overlaps))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(
        (
            (i, len(a), len(b), len(g), len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links),
             hashlib.sha256(";".join(g).encode()).hexdigest() if a else "", o)
            for i, a, b, g, links, o in found
        ),
        key=str,
    )


@with_tokenizers
@pytest.mark.parametrize("heavy", [0, 20, 1 << 16])
def test_alignment_equals_plain_version(docs, rows, heavy):
    short = [(i, t) for i, t in rows if len(t or "") < 3000]
    few = docs.where("text is null or length(text) < 3000")
    got = alignment.link_statistics(few, A_PATH, B_PATH, heavy)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_alignment(short)


@with_tokenizers
def test_alignment_of_special_strings_and_empty_table(spark, docs):
    got = {r.doc_id: r for r in alignment.align(docs.where("doc_id >= 300"), A_PATH, B_PATH).collect()}
    assert got[308].n_a > 8 and got[309].n_a == 0 and got[300].n_b == 0 and got[310].n_groups > 0
    assert alignment.link_statistics(docs.where("false"), A_PATH, B_PATH).collect() == []


@with_tokenizers
def test_words_have_the_tokens_of_the_whole_text(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    rng = random.Random(3)
    signs = ["a", "B", "1", "'s", "'", ".", "é", " ", " ", " ", "\n", "\r", "\t", "\x1c", "\x85", "\u00a0", "\u2003", "\u3000", "🙂", "\u0301", ");", "</s>", "<|endoftext|>"]
    texts = [t for _, t in rows if t] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(3000)]
    aligner, file, pieces = alignment.Aligner(A_PATH, B_PATH), Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    file.encode_special_tokens = True
    assert aligner.apart
    for t in texts:
        numbers = np.array([aligner.words[w] for w in alignment.BETWEEN.split(t)])
        assert aligner.words.tokens(0, numbers)[0].tolist() == file.encode(" " + t, add_special_tokens=False).ids
        assert aligner.words.tokens(1, numbers)[0].tolist() == pieces.encode(t)


@with_tokenizers
def test_batches_and_other_tokenizers(rows, monkeypatch):
    texts = [t for _, t in rows if len(t or "") < 3000]
    aligner = alignment.Aligner(A_PATH, B_PATH)

    def each(groups):
        out = []
        for g in groups:
            numbers, written, pairs, times, ends = aligner.align(g)
            out += [(*(int(n[k]) for n in numbers), written[k], pairs[ends[k] : ends[k + 1]].tolist(), times[ends[k] : ends[k + 1]].tolist()) for k in range(len(g))]
        return out

    expected = each([texts])
    monkeypatch.setattr(alignment, "POOL", 50)
    assert each([[t] for t in texts]) == expected
    aligner.apart = False  # whole texts, as for tokenizers whose tokens may reach over spaces
    assert each([texts[:50], texts[50:]]) == expected


def test_gallop_finds_ranks():
    rng = random.Random(2)
    for _ in range(300):
        last = rng.randint(1, 400)
        short, long = ([*sorted(rng.sample(range(1, last), min(last - 1, rng.randint(0, 300)))), last] for _ in range(2))
        assert alignment.gallop(short, long) == [sum(y < x for y in long) for x in short]


def plain_groups(rows):
    sets = []
    for _, text in rows:
        w = split(lower(text))
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None and sets[k]:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i is not None and i == c))
    return sorted(out, key=str)


def test_sketches_equal_plain_version(docs, rows):
    got = sketches.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_groups(rows)
    assert sketches.near_duplicates(docs.where("false")).collect() == []


def test_parts_of_a_bucket_are_compared_in_small_blocks(docs, rows, monkeypatch):
    monkeypatch.setattr(sketches, "BLOCK_NODES", 3)
    monkeypatch.setattr(sketches, "BLOCK_SHINGLES", 300)
    monkeypatch.setattr(sketches, "FAN", 2)
    assert sorted((tuple(r) for r in sketches.near_duplicates(docs).collect()), key=str) == plain_groups(rows)


def test_links_that_the_smallest_of_a_bucket_does_not_have(spark):
    """A chain of texts: each links with the next only, and all stand in common buckets of the first."""
    base = [f"word{i}" for i in range(200)]
    texts = []
    for k in range(40):
        texts.append((k, " ".join(base)))
        base[(k * 17) % 200 : (k * 17) % 200 + 4] = [f"new{k}-{j}" for j in range(4)]
    rows = texts[::-1]
    got = sketches.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_groups(rows)


def test_sketch_fills_each_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 100, 3000, 40_000):
        s = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        full = sketches.sketch(s)
        assert (full != np.iinfo(np.uint64).max).all()
        # One round at a time, as the definition has it.
        step, sketches.STEP = sketches.STEP, 1
        try:
            if n <= 100:
                assert (sketches.sketch(s) == full).all()
        finally:
            sketches.STEP = step
    errors = []
    for _ in range(60):
        common, own = rng.integers(0, 1 << 63, 850, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 75), dtype=np.uint64)
        a, b = (sketches.sketch(np.unique(np.concatenate([common, o]))) for o in own)
        errors.append((a == b).mean() - 0.85)
    assert abs(np.mean(errors)) < 0.01 and max(map(abs, errors)) < 0.09


def plain_runs(words):
    out, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            seg = words[start : i + q]
            if len(seg) >= max(6, 4 * q) and not any(seg[d:] == seg[:-d] for d in range(1, q)):
                out.append((start, len(seg), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_periodic(rows):
    out = []
    for i, text in rows:
        words, h = split(text), zlib.crc32(b"" if i is None else str(i).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = plain_runs(words)
        drop = {k for s, length, q in runs for k in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else (None,) * 3
        digests = ["".join(f"{a},{b},{c}\n" for a, b, c in runs), " ".join(w for k, w in enumerate(words) if k not in drop)]
        out.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *(hashlib.sha256(x.encode()).hexdigest() for x in digests)))
    return sorted(out, key=str)


def test_periodic_runs_equal_plain_version(spark, docs, rows, tmp_path):
    rng = random.Random(9)
    more = []
    for i in range(400, 520):
        base = [f"{rng.randrange(4)}" for _ in range(rng.randint(1, 30))]
        more.append((i, " ".join(["start"] * rng.randint(0, 9) + base * rng.randint(1, 9) + base[: rng.randint(0, 30)] + ["end"] * rng.randint(0, 7))))
    docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id bigint, text string")).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    expected = plain_periodic(rows + more)
    assert sum(r[1] for r in expected) > 100
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_runs_of_random_texts_equal_plain_version():
    rng = random.Random(1)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            words = []
            for _ in range(rng.randint(0, 6)):
                base = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.randint(1, 14))]
                words += base * rng.randint(1, 7) + base[: rng.randint(0, 9)]
            texts.append((words * rng.randint(1, 5))[:600])
        assert periodic.find_runs(texts) == [plain_runs(w) for w in texts]


def test_runs_of_odd_rows(spark, docs):
    got = {r.doc_id: r for r in periodic.collapse_runs(docs.where("doc_id >= 300")).collect()}
    assert got[300].runs == [] and got[300].text == "" and got[306].runs == [(0, 5000, 1)] and got[306].text == "x"
    assert got[307].text == "ab cd" and got[302].text == ""
    assert periodic.collapse_runs(docs.where("false")).collect() == []
