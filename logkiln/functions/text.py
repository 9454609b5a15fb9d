"""Search predicates over log columns.

A text is a sequence of tokens: the lower-case runs of letters and digits in it. Token tests are
written as one regular expression behind a plain substring test, so texts without the word are
passed over cheaply and no token list is built per row.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from logkiln import catalog as C

# What a token is made of.
TOKEN_CHAR = r"[\p{L}\p{N}]"
SEPARATORS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Tokens of a text, in order, as an array."""
    return F.filter(F.split(F.lower(text), SEPARATORS), lambda t: t != "")


def split_query(text: str) -> list[str]:
    """Tokens of a search text."""
    kept = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text.lower())
    return kept.split()


def _has_tokens(text: Column, words: list[str]) -> Column:
    folded = F.lower(text)
    pattern = f"(?<!{TOKEN_CHAR})" + SEPARATORS.join(re.escape(w) for w in words) + f"(?!{TOKEN_CHAR})"
    quick = reduce(lambda a, b: a & b, [folded.contains(w) for w in dict.fromkeys(words)])
    return F.coalesce(quick & folded.rlike(pattern), F.lit(False))


def phrase(words: str, fields: Iterable[str] = C.DEFAULT_SEARCH_FIELDS) -> Column:
    """The tokens of ``words`` one after the other, in any of the fields."""
    parts = split_query(words)
    if not parts:
        return F.lit(False)
    return any_of(*[_has_tokens(F.col(f), parts) for f in fields])


def term(word: str, fields: Iterable[str] = C.DEFAULT_SEARCH_FIELDS) -> Column:
    """A token equal to ``word`` up to case, in any of the fields."""
    return phrase(word, fields)


def _literal(field: C.Field, value) -> Column:
    if field.storage in C.TIME_STORAGE and isinstance(value, datetime):
        moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
        since = moment - datetime(1970, 1, 1, tzinfo=timezone.utc)
        return F.timestamp_micros(F.lit((since.days * 86_400 + since.seconds) * 1_000_000 + since.microseconds))
    if field.name == "cap_effective":
        return F.lit(Decimal(value)).cast(field.spark_type)
    return F.lit(value)


def field_eq(name: str, value) -> Column:
    """Whole-value equality; for text columns, a token or phrase in the column."""
    field = C.BY_NAME[name]
    if field.storage == C.TEXT:
        return phrase(value, (name,))
    return F.col(name) == _literal(field, value)


def field_range(name: str, lo=None, hi=None) -> Column:
    """Both ends included; either may be left open. Numbers and instants."""
    field = C.BY_NAME[name]
    if field.storage in (C.STRING, C.TEXT):
        raise ValueError(f"{name} has no range")
    tests = []
    if lo is not None:
        tests.append(F.col(name) >= _literal(field, lo))
    if hi is not None:
        tests.append(F.col(name) <= _literal(field, hi))
    return all_of(*tests)


def match_all() -> Column:
    return F.lit(True)


def all_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a & b, tests, match_all()) if len(tests) != 1 else tests[0]


def any_of(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def none_of(*tests: Column) -> Column:
    """No test holds; a test on a missing value does not hold."""
    return ~F.coalesce(any_of(*tests), F.lit(False))
