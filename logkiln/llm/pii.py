"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

All of it is SQL expressions on the row of a document: no shuffle and no Python. The expression of a kind
is anchored where the last match ended and takes the gap before the match along, so that lengths
of gaps and matches give the offsets, in code points. Repetitions are possessive where that cannot
change a match, so a text without a match costs one pass, however long.

Base kinds (email, ip, card, phone) have priors that pass by themselves; the further kinds pass
by checksum (iban) or by a context word nearby (ssn). A card or phone near such a word scores higher.

Defined results: a null or empty text has no spans; equal rows give equal results, each its own;
an empty table gives an empty one; of the other columns only those asked for are kept. Offsets are running
sums of lengths, taken by blocks: for n matches of one kind in one text at the cost of n times the root of n.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Characters before and behind a match, up to the next one of its kind, that are searched for context words.
CONTEXT = 40
THRESHOLD = 0.6


@dataclass(frozen=True)
class Kind:
    name: str
    hint: str  # a cheap test that every text with a match passes
    pattern: str
    prior: float
    context: str
    bonus: float = 0.3


KINDS = (
    Kind("email", "@", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++", 0.7, "mail|contact|correo|courriel"),
    Kind("ip", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", 0.6, "ip|host|server|address|adresse"),
    Kind("card", r"[0-9](?:[ -]?[0-9]){12}", r"(?<![0-9])[0-9](?:[ -]?+[0-9])++", 0.6, "card|visa|credit|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax"),
    Kind("iban", "[A-Z]{2}[0-9]{2}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", 0.7, "iban|account|konto|compte|cuenta"),
    Kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])", 0.3, "ssn|social security"),
)
BASE = ("email", "ip", "card", "phone")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a right Luhn check digit."""
    def value(c, i):
        n = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(n > 9, n - 9).otherwise(n)

    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: value(F.when(c == "", "0").otherwise(c), i))
    return F.aggregate(each, F.lit(0), lambda a, n: a + n) % 10 == 0


def mod97(text: Column) -> Column:
    """Whether an account number has the right two check digits: moved to the end, letters as 10 to 35, remainder 1."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    def add(a, c):
        code = F.ascii(c)
        return F.when(code < 58, (a * 10 + code - 48) % 97).otherwise((a * 100 + code - 55) % 97)

    chars = F.filter(F.split(moved, ""), lambda c: c != "")
    return F.aggregate(chars, F.lit(0), add) == 1


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    if kind == "iban":
        return mod97(m)
    return F.lit(True)


_SPAN = "array<struct<kind:string,start:int,end:int,match:string,score:double>>"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _rest(items: Column) -> Column:
    return F.slice(items, 2, F.size(items))


def _sums(numbers: Column) -> Column:
    """0 and the running sums of a short array; copies what it has at each step."""
    return F.aggregate(numbers, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))


def running_sums(numbers: Column) -> Column:
    """The running sums of an array that is not empty, by blocks of the square root of its size, so that no step copies more than one block."""
    def blocks(all_: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(all_))).cast("int")
        return _bind(width, lambda w: F.transform(F.sequence(F.lit(1), F.size(all_), w), lambda at: _sums(F.slice(all_, at, w))))

    def join(parts: Column) -> Column:
        # The last of these stands before no block, so its own sums are null.
        before = _sums(F.transform(parts, lambda p: F.element_at(p, -1)))
        return F.flatten(F.transform(F.arrays_zip(parts.alias("own"), before.alias("before")), lambda p: F.transform(_rest(F.coalesce(p["own"], F.array(F.lit(0)))), lambda n: n + p["before"])))

    return _bind(_bind(numbers, blocks), join)


def _spans(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind, in order."""
    whole = F.lit(rf"(?s)\G(.*?)({kind.pattern})")
    empty = F.array().cast(_SPAN)
    near = rf"\b(?:{kind.context})"

    def place(p: Column) -> Column:
        sizes = F.zip_with(p["gaps"], p["found"], lambda g, m: F.length(g) + F.length(m))
        return F.struct(p["gaps"].alias("gaps"), p["found"].alias("found"), running_sums(sizes).alias("ends"))

    def judge(p: Column) -> Column:
        # What follows a match is the gap before the next one, or the text behind the last.
        tail = F.substr(text, F.element_at(p["ends"], -1) + 1, F.lit(CONTEXT))
        after = F.concat(_rest(p["gaps"]), F.array(tail))
        pieces = F.arrays_zip(p["gaps"].alias("gap"), p["found"].alias("match"), p["ends"].alias("end"), after.alias("after"))

        def span(x: Column) -> Column:
            told = F.lower(F.right(x["gap"], F.lit(CONTEXT))).rlike(near) | F.lower(F.left(x["after"], F.lit(CONTEXT))).rlike(near)
            score = F.round(F.lit(kind.prior) + F.when(told, F.lit(kind.bonus)).otherwise(0.0), 3)
            start = x["end"] - F.length(x["match"])
            return F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), x["end"].alias("end"), x["match"].alias("match"), score.alias("score"))

        return F.filter(F.transform(pieces, span), lambda x: (x["score"] >= THRESHOLD) & _valid(kind.name, x["match"])).cast(_SPAN)

    found = F.struct(F.regexp_extract_all(text, whole, F.lit(1)).alias("gaps"), F.regexp_extract_all(text, whole, F.lit(2)).alias("found"))
    hint = F.contains(text, F.lit("@")) if kind.hint == "@" else text.rlike(kind.hint)
    judged = _bind(found, lambda p: F.when(F.size(p["found"]) > 0, _bind(place(p), judge)).otherwise(empty))
    return F.when(hint, judged).otherwise(empty)


def find_pii(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """``keep`` and ``spans``: all spans by kind, then start, with match and score."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(*keep, F.concat(*[_spans(body, k) for k in kinds]).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span's characters replaced by its kind in brackets; overlaps are replaced together."""
    order = F.array_sort(spans, lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    def step(acc, s):
        fresh = s["start"] >= acc["at"]
        gap = F.substr(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    return F.concat(done["out"], F.substr(text, done["at"] + 1))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
