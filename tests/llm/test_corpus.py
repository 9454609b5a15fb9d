"""Corpus operators against plain versions, and on odd rows."""

import collections
import gzip
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from logkiln.llm import decontaminate, gru, language, lm, packing, pii, repeats, rules, simhash, templates, warc
from logkiln.llm.common import crc_mod

WORDS = "la de the of und der casa house strasse river mountain garden window letter number market person".split()
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, place int, leaf int, fp int, rep int, n int, b int, kind string, spans int, score int, doc int, template int, _row int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    passage = prose(rng, 60)
    out = []
    for i in range(60):
        text = prose(rng, int(rng.integers(5, 200)))
        if i % 6 == 0:
            text += "\n" + passage + "\n" + prose(rng, 20)
        if i % 10 == 3:
            text = out[i - 3][1]
        out.append((i, text))
    out[7], out[8], out[9] = (7, None), (8, ""), (9, " \n\t ")
    out[11] = (11, "mail a.b@c.de, ip 10.0.0.255 and 1.2.3.999, card 4111 1111 1111 1111, call +49 (30) 1234567; IBAN DE89 3704 0044 0532 0130 00")
    out += [(20, out[20][1]), (None, passage), (61, "é" * 500), (62, "ab" * 3000), (63, "Tag 12: Lauf 7 ok"), (64, "x " * 30_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    full = [(i, t, ["en", "de", None][k % 3], [None, "a", "b"][k % 3], None if t is None else len(t), "k", 1, 1, 1, 1, 1, 1, "k", 1, 1, 1, 1, 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS).repartition(4).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def split(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- 1 ---------------------------------------------------------------------------------------


def test_lm_base_scores_and_sum(docs, rows, none):
    got = {(r.doc_id, r.n_tokens): r for r in lm.score_corpus(docs, crc_mod(7) != 2).collect()}
    counts = collections.Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            counts.update(split(lower(t)) + [" "])
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        w = split(lower(t)) + [" "]
        r = got[i, len(w)]
        assert r.n_known == sum(counts[x] > 0 for x in w) and r.train_tokens == n
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0
    assert lm.score_corpus(none, crc_mod(7) != 2).count() == 0


def test_lm_gradients():
    rng = np.random.default_rng(0)
    lanes = gru.Lanes([rng.integers(0, gru.SHORT + 1, n).astype(np.int16) for n in (5, 9, 16, 3)], 2)
    p = gru.unpack(rng.normal(0, 0.3, gru.SIZE))
    at, n, inputs, fresh, targets = next(gru._windows(lanes))
    weight = (np.arange(gru.STEPS)[:, None] < lanes.lengths[None, :n]).astype(float).reshape(-1)
    h = rng.normal(0, 0.5, (n, gru.HIDDEN))
    flat = targets.T.reshape(-1).astype(int)

    def loss():
        s, _ = gru.forward(p, h, inputs, fresh)
        return -(gru.output(p, s.reshape(-1, gru.HIDDEN), flat)[0] * weight).sum()

    s, kept = gru.forward(p, h, inputs, fresh)
    _, grads, ds = gru.output(p, s.reshape(-1, gru.HIDDEN), flat, weight)
    back = gru.backward(p, kept, ds.reshape(s.shape), inputs)
    gates = np.zeros_like(p["gates"])
    gates[back["rows"]] = back["gates"]
    for name, g in {**grads, "u": back["u"], "gates": gates}.items():
        for _ in range(6):
            place = tuple(rng.integers(0, d) for d in g.shape)
            old, step = p[name][place], 1e-5
            p[name][place] = old + step
            up = loss()
            p[name][place] = old - step
            down = loss()
            p[name][place] = old
            assert (up - down) / 2 / step == pytest.approx(g[place], abs=1e-6)


def test_lm_learns_order_and_is_a_distribution():
    docs = [np.array([1, 2, 3] * 40 + [0], np.int16) for _ in range(300)]
    flat = gru.start(np.array([300, 12000, 12000, 12000, *[0] * (gru.SHORT - 4), 10]))
    before = gru.score(flat, docs[:1])[0]
    squares = np.full_like(flat, 1e-5)
    for _ in range(6):
        gru.train(flat, docs, squares)
    assert gru.score(flat, docs[:1])[0] > before / 3
    tokens = np.arange(gru.SHORT + 1)
    logs, _, _ = gru.output(gru.unpack(flat), np.tile(np.float32(0.3), (len(tokens), gru.HIDDEN)), tokens)
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


# --- 2 ---------------------------------------------------------------------------------------


def test_archives(spark, tmp_path):
    long = "<p>" + "x" * 200 + "</p>\r\n\r\nWARC/1.1\r\n\r\n"
    pages = spark.createDataFrame(
        [(1, "http://a/ b", long), (2, None, long), (3, "http://c", "short"), (4, "http://c", "short"), (5, "u", None), (6, "u", "é\n" * 80), (2, "u", long), (None, "u", long)],
        "page_id bigint, url string, html string",
    )
    found = warc.archive_pages(spark, pages, f"file://{tmp_path}/x").where("warc_type in ('response', 'revisit')").collect()
    got = collections.Counter((r.headers.get("x-record-key"), r.warc_type, r.headers.get("x-refers-to-key"), r.headers["x-payload-length"]) for r in found)
    n = str(len(long))
    assert got == collections.Counter([("1", "response", None, n), ("2", "revisit", "1", n), ("2", "revisit", "1", n), (None, "revisit", "1", n), ("3", "response", None, "5"), ("4", "response", None, "5"), ("5", "response", None, "0"), ("6", "response", None, "240")])
    for r in found:
        if r.warc_type == "response":
            assert r.headers["warc-payload-digest"] == "sha256:" + hashlib.sha256(warc.split_http(bytes(r.block))[1]).hexdigest()
    assert warc.archive_pages(spark, pages.where("false"), f"file://{tmp_path}/y").where("warc_type <> 'warcinfo'").count() == 0


def test_broken_numbers_and_other_file_names(spark, tmp_path):
    page = b"http://a 1.1.1.1 20240102030405 text/html %s\nabc\n"
    for broken in ("\u00b2", "--5", "-5", "9" * 30, "", "3x"):
        assert [r[11] for r in warc.parse_arc(page % broken.encode())] == ["bad_header"]
        got = list(warc.parse_warc(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: " + broken.encode() + b"\r\n\r\nabc\r\n\r\n"))
        assert [r[8] for r in got] == ["bad_header"]
    (tmp_path / "one.arc").write_bytes(page % b"3")
    (tmp_path / "two.arc.gz").write_bytes(gzip.compress(page % b"3"))
    (tmp_path / "three.arc").write_bytes(page % "\u00b2".encode())
    records = warc.read_arc(spark, str(tmp_path))
    assert sorted(r.error or "good" for r in records.collect()) == ["bad_header", "good", "good"]
    keyed = b"HTTP/1.1 200 OK\r\nX-Record-Key: %s\r\n\r\nabc"
    rows = [("a", k, 1, "http://a", "1.1.1.1", "20240102030405", "text/html", None, None, None, keyed % key, None) for k, key in enumerate([b"--5", "\u00b2".encode(), b"-5", b"9223372036854775807"])]
    values = [bytes(r.value) for r in warc.convert_arc(spark.createDataFrame(rows, warc.RECORD)).collect()]
    # The outer header names the key only where it is a number.
    assert sorted(v.split(b"\r\n\r\n")[0].split(b"X-Record-Key: ")[1:] != [] for v in values) == [False, False, True, True]


def test_arc_header_lines():
    v2 = warc.version_block(2, "n", "20240101000000")
    body = b"\x00\xff line\nhttp://trap 1.1.1.1 2024 text/html 3\n"
    one = warc.arc_line(2, "http://a", "1.2.3.4", "2024", "text/html; charset=x", len(body)) + b"\n" + body + b"\n"
    records = list(warc.parse_arc(v2 + b"\n" + one + b"http://b 1.1.1.1 20240102030405 text/html 200 - - 0 f 9\nabc"))
    assert [r[2] for r in records] == [2, 2, 2] and records[1][10] == body and records[1][6] == "text/html; charset=x"
    assert records[2][11] == "truncated" and records[2][10] == b"abc"
    assert warc.warc_date("2024") == "2024-01-01T00:00:00Z" and warc.warc_date(None) == "1970-01-01T00:00:00Z"
    assert list(warc.parse_arc(b"junk\n"))[0][11] == "bad_header"


# --- 3 ---------------------------------------------------------------------------------------


def test_line_templates(spark, docs, none):
    lines = [f"Printed on day {i} by press" for i in range(4)]
    same = "the quick brown fox jumps over the lazy"
    table = spark.createDataFrame(
        [(i, f"own line {'abcd'[i]} stays here\n{lines[i]}\n{same} {'wxyz'[i]}\n") for i in range(4)] + [(9, None), (8, ""), (0, "own line a stays here\n" + lines[0])],
        "doc_id bigint, text string",
    )
    got = {(r.doc_id, r.n_dropped_lines): r.text for r in templates.drop_repeated_lines(table).collect()}
    assert got[1, 2].startswith("own line b stays here\n") and got[9, 0] is None and got[8, 0] == ""
    assert sum(("day" in (t or "")) for t in got.values()) == 1 and sum(same in (t or "") for t in got.values()) == 1
    kept = templates.drop_repeated_lines(docs)
    assert kept.columns == docs.columns + ["n_dropped_lines"] and kept.count() == docs.count()
    assert templates.drop_repeated_lines(none).count() == 0


# --- 4 ---------------------------------------------------------------------------------------


def plain_repeats(rows):
    seen, out = {}, {}
    order = sorted({((1 << 63) - 1 if i is None else i, (t or "").encode()) for i, t in rows})
    for i, t in order:
        for s in range(len(t) - 99):
            seen.setdefault(t[s : s + 100], (i, s))
    for i, t in order:
        gone = bytearray(len(t))
        for s in range(len(t) - 99):
            if seen[t[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        out[i] = (len(t), sum(gone), sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(bytes(c for c, g in zip(t, gone) if not g)).hexdigest())
    return out


def test_repeats(docs, rows, none):
    got = {(1 << 63) - 1 if r[0] is None else r[0]: tuple(r)[1:] for r in repeats.digest(repeats.remove_repeats(docs)).collect()}
    assert got == plain_repeats(rows)
    assert repeats.remove_repeats(none).count() == 0


def test_anchors_agree_in_equal_windows():
    rng = np.random.default_rng(1)
    window = rng.integers(97, 100, 100).astype(np.uint8)
    names = set()
    for _ in range(20):
        text = np.concatenate([rng.integers(97, 100, rng.integers(0, 200)).astype(np.uint8), window, rng.integers(97, 100, 50).astype(np.uint8)])
        at = text.tobytes().index(window.tobytes())
        grams, found = repeats.anchors(text, np.array([len(text)]))
        names.add(min(grams[at : at + 61]))
        assert grams[at : at + 61].min() in grams[[p for p in found if at <= p <= at + 60]]
    assert len(names) == 1


# --- 5 ---------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        total = sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_pii(spark, docs, none):
    rng = np.random.default_rng(5)
    pieces = ["a@b.c", "_x@y.z", "@", ".", "1", "255", "256", "..", " ", "-", "+1", "(2) ", "4111111111111111", "4111-1111-1111-1111", "é", "𝄞", "+49 30 1234567", "1.2.3.4", "\n", "a.b", "5500 0000 0000 0004"]
    texts = ["".join(rng.choice(pieces, rng.integers(1, 14))) for _ in range(1500)] + [None, "", "1 " * 40_000, "a" * 50_000, "1.1." * 3000]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    for r in pii.find_pii(table).collect():
        text = texts[r.doc_id] or ""
        want = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if right(k, m[0])]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in BASE] == want
        assert all(text[s.start : s.end] == s.match and s.score >= pii.THRESHOLD for s in r.spans)
    got = {r.doc_id: r for r in pii.find_pii(docs).select("*", pii.span_text(F.col("spans")).alias("t")).collect()}
    assert [s.kind for s in got[11].spans] == ["email", "ip", "card", "phone", "iban"] and got[7].t == ""
    redacted = docs.where("doc_id = 11").join(pii.find_pii(docs).withColumnRenamed("spans", "found"), "doc_id").select(pii.redact(F.col("text"), F.col("found"))).first()[0]
    assert redacted == "mail [email], ip [ip] and 1.2.3.999, card [card], call [phone]; IBAN [iban]"
    assert pii.find_pii(none).count() == 0


def test_pii_in_linear_steps_with_words_on_both_sides(spark):
    rng = np.random.default_rng(6)
    lists = [rng.integers(0, 9, n).tolist() for n in (1, 2, 3, 4, 5, 9, 10, 17, 1000)]
    sums = spark.createDataFrame([(x,) for x in lists], "x array<int>").select("x", pii.running_sums(F.col("x")).alias("sums"))
    assert all(r.sums == np.cumsum(r.x).tolist() for r in sums.collect())
    many = " ".join(f"a{i}@b.c" for i in range(40_000))
    told = ["123-45-6789 is the social security number", "no 123-45-6789 there", "ssn 123-45-6789", "123-45-6789" + " " * 60 + "ssn"]
    table = spark.createDataFrame(list(enumerate([many, *told])), "doc_id bigint, text string")
    begin = time.time()
    got = {r.doc_id: r.spans for r in pii.find_pii(table).collect()}
    # Copying all spans at each match took two minutes.
    assert time.time() - begin < 60
    assert [(s.start, s.end) for s in got[0]] == [m.span() for m in re.finditer(r"\S+", many)]
    assert [[s.kind for s in got[i]] for i in range(1, 5)] == [["ssn"], [], ["ssn"], []]


# --- 6 ---------------------------------------------------------------------------------------


def test_code_lengths_are_those_of_a_plain_context_tree():
    n = language.SYMBOLS
    rng = np.random.default_rng(2)
    text = rng.integers(0, 4, 400)
    counts = np.zeros((n,) * 4)
    for i in range(3, len(text)):
        counts[tuple(text[i - 3 : i + 1])] += 1
    bits = language.code_lengths(counts.reshape(-1)).reshape((n,) * 4)

    def plain(context, symbol):
        own = counts.sum(axis=tuple(range(3 - len(context)))) if len(context) < 3 else counts
        own = own[tuple(context)]
        total, kinds = own.sum(), (own > 0).sum()
        if own[symbol]:
            return -math.log2(own[symbol] / (total + kinds))
        lower_ = math.log2(n) if not len(context) else plain(context[1:], symbol)
        return lower_ - (math.log2(kinds / (total + kinds)) if kinds else 0)

    for _ in range(200):
        c, s = rng.integers(0, 6, 3), int(rng.integers(0, 6))
        assert bits[(*c, s)] == pytest.approx(plain(list(c), s))


def test_language(spark, docs, none):
    rng = np.random.default_rng(4)
    own = {"aa": "alba costa mira solana rio verde".split(), "bb": "zwisch krumm schrank wurzel knecht".split()}
    table = spark.createDataFrame([(i, " ".join(rng.choice(own[k], 40)), k) for i in range(60) for k in own], "doc_id bigint, text string, lang string")
    model = language.learn(table.where("doc_id % 2 = 0"))
    held = language.predict(table.where("doc_id % 2 = 1"), model, keep=("lang",))
    assert held.where("lang <> lang_pred").count() == 0
    odd = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (7, 8, 9)) and 0 <= odd[1].score <= 1
    assert language.predict(docs, language.learn(none)).where("lang_pred <> 'und'").count() == 0
    small = spark.createDataFrame([(200, "òtra lenga pichona amb quauques mots", "cc"), (201, "", "dd"), (202, None, "ee")], table.schema)
    model = language.learn(table.where("doc_id % 2 = 0").unionByName(small))
    assert model.languages == ("aa", "bb", "cc")
    more = spark.createDataFrame([(300, "quauques mots pichona lenga", "cc")], table.schema).unionByName(table.where("doc_id % 2 = 1"))
    assert language.predict(more, model, keep=("lang",)).where("lang <> lang_pred").count() == 0


def test_softmax_without_division():
    """Row maxima are those of numpy at any number of rows; where only targets count, the same logarithms come without the probabilities of all."""
    rng = np.random.default_rng(4)
    for n in (0, 1, 511, 512, 1300):
        x, target = rng.normal(0, 9, (n, 33)).astype(np.float32), rng.integers(0, 33, n)
        assert n == 0 or (gru._largest(x) == x.max(axis=1, keepdims=True)).all()
        logs, shares = gru._softmax(x.copy(), target)
        assert (gru._softmax(x.copy(), target, False)[0] == logs).all()
        assert n == 0 or abs(shares.sum(axis=1) - 1).max() < 1e-5


def test_every_language_is_learned(spark, monkeypatch):
    """More languages than are sent out at once: none is left out, and slices give what one table gives."""
    names = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(language.AT_ONCE + 3)]
    rows = [(i, name, f"{name} {name}{name} " * (3 + i % 5)) for i, name in enumerate(names)]
    rows += [(900, None, None), (901, None, "12"), (902, None, names[0] * 4 + " " + names[1] * 4)]
    table = spark.createDataFrame(rows, "doc_id bigint, lang string, text string").repartition(3)
    model = language.learn(table)
    assert model.rest is not None
    got = {r.doc_id: r for r in language.predict(table, model).collect()}
    assert [got[i].lang_pred for i in range(len(names))] == names
    assert (got[900].lang_pred, got[901].lang_pred, got[900].score) == ("und", "und", 0)
    monkeypatch.setattr(language, "AT_ONCE", 100)
    whole = language.learn(table)
    assert whole.rest is None and whole.languages == tuple(names)
    for r in language.predict(table, whole).collect():
        assert r.lang_pred == got[r.doc_id].lang_pred and abs(r.score - got[r.doc_id].score) < 1e-6


# --- 7 ---------------------------------------------------------------------------------------


def test_packing(docs, rows, none):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    file = path("word_bpe_49k.json")
    plain, parts, sequences = Tokenizer.from_file(file), collections.defaultdict(list), collections.defaultdict(list)
    for p in packing.pack(docs, file).collect():
        parts[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for i, t in dict(rows).items():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        copies = 2 if i == 20 else 1
        assert sum(p.length for p in parts[i]) == copies * len(ids)
        for p in parts[i]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    sizes = []
    for k in sorted(sequences):
        end = 0
        for o, n in sorted(sequences[k]):
            assert o == end
            end += n
        sizes.append(end)
    assert sorted(sequences) == list(range(len(sequences))) and all(s & (s - 1) == 0 and s <= 2048 for s in sizes)
    assert packing.pack(none, file).count() == 0


def test_schedule_keeps_to_the_mixture():
    totals = {"a": 30_000, "b": 20_000, "c": 11}
    plan, seen = packing.phases(totals, {"a": 1, "b": 3, "c": 0}, 100), collections.Counter()
    for s, n in totals.items():
        for run in packing.place(s, 0, n, plan, 100):
            for _, k, q, _ in packing.cut(*run, sum(totals.values()), 100):
                seen[q, s] += k
    assert all(abs(seen[q, "b"] - 75) <= 3 for q in range(200)) and all(sum(seen[q, s] for s in totals) == 100 for q in range(500))


def test_word_tokens_are_those_of_the_file(tmp_path):
    import json

    from public_tokenizers import path
    from tokenizers import Tokenizer

    file = path("word_bpe_49k.json")
    texts = ["a<|endoftext|>b", "It's 12\u00bd \u00b2x \u00c0\u00c9 \u00df \u00b5", "na\u00efv\u00e9 e\u0301", "x\x85y\xa0z", "\x00 a\x00b\x1cc", "\u65e5\u672c \u01c5 \u0130stanbul", "'S 'LL a'SB",
             "", "  ", "<|startoftext|>", "a\u200bb\u3000 c", "--''s's", "\u00aa\u00ba \u00bc\u00be \xadx\xad", " tail \n", "word, word. " * 300]
    plain, fast = Tokenizer.from_file(file), packing.WordTokens(file)
    assert fast.merges is not None
    for _ in range(2):
        got = [np.frombuffer(x, fast.kind).tolist() for x in fast.batch(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    # A file of another kind is left to its own tokenizer.
    with open(file, encoding="utf-8") as f:
        other = json.load(f)
    other["normalizer"]["normalizers"].pop()
    (tmp_path / "cased.json").write_text(json.dumps(other))
    cased = packing.WordTokens(str(tmp_path / "cased.json"))
    assert cased.merges is None
    assert np.frombuffer(cased.batch(["Big Words"])[0], cased.kind).tolist() == cased.tokenizer.encode("Big Words", add_special_tokens=False).ids


def test_documents_are_cut_as_one_by_one():
    rng = np.random.default_rng(7)
    for weights in (None, {"a": 1, "b": 5, "c": 2, None: 1}):
        sources = [("a", "b", "c", None)[k] for k in rng.choice(4, 300, p=[0.6, 0.2, 0.15, 0.05])]
        n, held, at = rng.integers(1, 400, 300), collections.Counter(), []
        for s, k in zip(sources, n.tolist()):
            at.append(held[s])
            held[s] += k
        total = sum(held.values())
        plan = packing.phases(dict(held), weights, 64)
        assert plan[-1].begin < total
        want = []
        for i, (s, k, a) in enumerate(zip(sources, n.tolist(), at)):
            want += [(i, *x) for run in packing.place(s, a, k, plan, 64) for x in packing.cut(*run, total, 64)]
        some = rng.permutation(300)[:250]  # documents need not follow each other
        got = packing.cut_documents([sources[i] for i in some], n[some], np.array(at)[some], plan, total, 64)
        got = sorted((int(some[i]), *x) for i, *x in zip(*(x.tolist() for x in got)))
        assert got == sorted(x for x in want if x[0] in set(some.tolist()))
        taken = sorted((q, o, k) for _, _, k, q, o in want)
        ends: dict = {}
        for q, o, k in taken:  # gapless from 0, to the length or a power of two
            assert ends.get(q, 0) == o
            ends[q] = o + k
        assert sum(ends.values()) == total and all(e == 64 or e & (e - 1) == 0 for e in ends.values())
    big = packing.Fraction(10**13 + 7, 3 * 10**13 + 1)
    assert packing._floor(10**10, 5, 2048, big).tolist() == [w * 2048 * big.numerator // big.denominator for w in range(10**10, 10**10 + 5)]


# --- 8 ---------------------------------------------------------------------------------------


def test_decontamination(spark, docs, rows, none):
    rng = np.random.default_rng(8)
    item = " ".join(f"w{k}" for k in rng.permutation(60)[:50])
    words = item.split()
    edited, far = words.copy(), words.copy()
    edited[25] = "other"
    far[10] = far[20] = far[30] = far[40] = "other"
    own = spark.createDataFrame(
        [(1, f"Before. {item.upper()}! after " + "z " * 5000), (2, "x " + " ".join(edited) + " y"), (3, " ".join(far)), (4, None), (5, ""), (6, "three words only"), (1, f"Before. {item}")], "doc_id bigint, text string"
    )
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "three words only"), (14, item)], "item_id bigint, text string")
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.find_matches(own, bench).collect())
    assert got == {(1, 10): 2, (1, 14): 2, (2, 10): 1, (2, 14): 1, (6, 13): 1}
    assert sorted(r.doc_id for r in decontaminate.clean(own, bench).collect()) == [3, 4, 5]
    assert decontaminate.clean(docs, bench).count() == docs.count() and decontaminate.find_matches(none, bench).count() == 0
    assert decontaminate.find_matches(own, bench.where("false")).count() == 0


# --- 9 ---------------------------------------------------------------------------------------


def plain_components(fps, ids):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(ids))]


def test_simhash(docs, rows, none):
    got = simhash.near_duplicates(docs).collect()
    mask = (1 << 64) - 1
    assert sorted(r.fp for r in got) == sorted(simhash.fingerprint((t or "").encode()) for _, t in rows)
    assert [r.component_id for r in got] == plain_components([r.fp & mask for r in got], [r.doc_id for r in got])
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("bucket", [4096, 8])
def test_links_of_crowded_fingerprints(spark, bucket):
    rng = np.random.default_rng(9)
    fps = {int(rng.integers(-(1 << 63), 1 << 63)) for _ in range(60)}
    for start in list(fps)[:3]:
        x = start
        for _ in range(60):
            for b in rng.integers(0, 63, rng.integers(1, 6)):
                x ^= 1 << int(b)
            fps.add(x)
            if rng.random() < 0.5:
                x = start
    fps = sorted(fps)
    edges = simhash.near_edges(spark.createDataFrame([(f,) for f in fps], "fp bigint"), bucket=bucket)
    root = {r.node: r.root for r in simhash.components(edges).collect()}
    mask = (1 << 64) - 1
    want = plain_components([f & mask for f in fps], fps)
    assert [root.get(f, f) for f in fps] == want


def test_components_end_at_stars(spark, monkeypatch):
    rng = np.random.default_rng(10)
    edges = [tuple(map(int, rng.integers(0, 120, 2))) for _ in range(70)] + [(i + 1, i) for i in range(200, 240)]
    edges += edges[:5] + [(v, u) for u, v in edges[5:10]] + [(300, 300)]
    root = {n: n for e in edges for n in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = simhash.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()
    assert sorted((r.node, r.root) for r in got) == sorted((n, r) for n, r in root.items() if n != r)
    written = []
    monkeypatch.setattr(simhash, "stage", lambda df, stage=simhash.stage: written.append(df) or stage(df))
    again = simhash.components(spark.createDataFrame(got, "u bigint, v bigint")).collect()
    assert sorted(again) == sorted(got) and len(written) == 1


# --- 10 --------------------------------------------------------------------------------------


def test_rules(spark, docs, rows, none):
    for text in [t or "" for _, t in rows] + ["a b c a b c d", "x\nx\n \nx", "#a $$\nb|<>"]:
        w = split(text)
        grams, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
        for i in range(len(w) - 2):
            if grams[tuple(w[i : i + 3])] > 1:
                covered |= {i, i + 1, i + 2}
        lines = [x for x in text.split("\n") if split(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert rules.text_statistics(text)[:5] == want
    rng = np.random.default_rng(10)
    x = rng.random((3000, len(rules.FEATURES)))
    bad = (x[:, 2] > 0.8) & (x[:, 5] < 0.5) | (x[:, 10] > 0.95)
    found = rules.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in found:
        hit |= rules._covered(r, x)
    assert (hit == bad).mean() > 0.97
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(i, 0, None) for i in range(30, 60)] + [(1, 0, 1), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    marked, list_ = rules.fit(docs, labels)
    judged = rules.judge(docs, marked, list_)
    assert judged.count() == docs.count() and judged.where("kept and base_failed").count() == 0
    assert rules.fit(docs, labels.where("false"))[1] == [] and rules.judge(none, marked, list_).count() == 0


def test_marked_words(spark):
    texts = [("Vile vilest day", 1, 0), ("vile, vile day", 1, 1), ("a vilely day", 1, 0), ("day of rest", 0, 1), ("", 0, 0), (None, 1, 1), ("vile day", 1, 1), ("VILE!", 1, 0)]
    want: dict[str, list[int]] = {}
    for text, bad, half in texts:
        words = {w.lower().strip(rules._EDGES) for w in (text or "").split()}
        for t in {w[:k] for w in words for k in rules.STARTS if len(w) > k} | {w + " " for w in words}:
            row = want.setdefault(t, [0, 0, 0, 0])
            row[2 * half] += bad
            row[2 * half + 1] += 1
    counts = rules.term_counts(spark.createDataFrame(texts, "text string, bad int, half int"), 1)
    got = {r.t: [r.b0, r.n0, r.b1, r.n1] for r in counts.collect()}
    assert got == {t: c for t, c in want.items() if c[0] + c[2] >= 1}
    marked = rules.marked_words(counts, [3, 3], least=2)
    # The beginning "vile" stands for "viles" and "vilel"; not for "vile" itself; "day" is in a good row.
    assert marked == {"vile": 2 / 6, "vile ": 4 / 6}
    assert rules._mark("vilest", marked) == marked["vile"] and rules._mark("day", marked) == 0


def test_language_histogram_has_a_row_a_byte(spark, monkeypatch):
    """Not a column for each of 256 bytes, which made the plans and the code that the driver holds."""
    from pyspark.sql.classic.dataframe import DataFrame
    from pyspark.sql.group import GroupedData

    from logkiln.llm import language

    widths = []
    for kind in (DataFrame, GroupedData):
        monkeypatch.setattr(kind, "agg", lambda self, *exprs, agg=kind.agg: widths.append(len(exprs)) or agg(self, *exprs))
    docs = spark.createDataFrame([("en", "the house"), ("fr", "la maison"), ("", ""), (None, "x")], "lang string, text string")
    assert language.learn(docs).languages == ("en", "fr")
    assert max(widths) <= 2
    assert language.learn(docs.where("text = ''")).languages == ()


def test_language_has_contexts_of_all_bytes(spark):
    """Languages that differ in rare bytes only are told apart; texts have the code lengths of a plain tree over bytes, also in pieces and slices."""
    from logkiln.llm import language

    rng = np.random.default_rng(9)
    words = "quick brown fox jumps over the lazy dog while 0123456789 vexed zebras".split()
    texts = {"aa": "é", "bb": "ö", "cc": "жы"}
    rows = [(i, " ".join(f"{w}{letter}" if j % 3 == 0 else w for j, w in enumerate(rng.choice(words, 40))), name) for i in range(20) for name, letter in texts.items()]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    model = language.learn(table.where("doc_id % 2 = 0"))
    held = language.predict(table.where("doc_id % 2 = 1"), model, keep=("doc_id", "lang", "text"))
    assert held.where("lang <> lang_pred").count() == 0

    def grams(text):
        data = b"   " + bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
        return [data[i - 3 : i + 1] for i in range(3, len(data))]

    seen = {name: collections.Counter() for name in texts}
    for i, text, name in rows:
        if i % 2 == 0:
            seen[name].update(g[d:] for g in grams(text) for d in range(4))
    contexts = {name: collections.defaultdict(list) for name in texts}
    for name, counts in seen.items():
        for gram, n in counts.items():
            contexts[name][gram[:-1]].append(n)

    def plain(name, gram):
        own = contexts[name].get(gram[:-1], [])
        if gram in seen[name]:
            return -math.log2(seen[name][gram] / (sum(own) + len(own)))
        lower_ = plain(name, gram[1:]) if len(gram) > 1 else 8
        return lower_ - (math.log2(len(own) / (sum(own) + len(own))) if own else 0)

    odd = [rows[5][1], "Ünknown Wörter, 東京", "x", "ж", "\x00\x7f", "The Lazy dogé " * 9000]
    for text, bits in zip(odd, language.texts_bits([t.encode() for t in odd], model)):
        assert bits == pytest.approx([sum(plain(name, g) for g in grams(text)) for name in model.languages], rel=1e-5)


def test_language_slices_by_size(spark, monkeypatch):
    """Tables past the numbers that are sent out at once make slices of fewer languages, with the same results."""
    from logkiln.llm import language

    rows = [(i, f"{c * 3} {c}{c} word{i} {chr(200 + i)}", f"l{i}") for i, c in enumerate("abcdefgh")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = {r.doc_id: r for r in language.predict(table, language.learn(table)).collect()}
    monkeypatch.setattr(language, "NUMBERS", 100)
    model = language.learn(table)
    sizes = [len(part.languages) for part in model.slices()]
    assert sum(sizes) == 8 and len(sizes) > 2
    got = {r.doc_id: r for r in language.predict(table, model).collect()}
    for i, _, name in rows:
        assert got[i].lang_pred == whole[i].lang_pred == name and abs(got[i].score - whole[i].score) < 1e-6
