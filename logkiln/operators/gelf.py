"""GELF bodies: the JSON text to one text column per known key, and to the general message form.

The JSON step runs in Arrow batches: Spark's JSON readers lose what the rules turn on (12 and
12.0, a number and its text, null and absent, text after the object), and asking a VARIANT for
the type of each of over ninety keys takes several times as long. The step only takes apart and
checks JSON types; every conversion of a value is a column expression.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logkiln import catalog as C
from logkiln.functions.columns import settle
from logkiln.operators.packets import MAX_BODY, bound_batches, map_bodies

_KEYS = C.gelf_keys()
_SOURCES = {s.key: (f, s) for f in C.FIELDS for s in f.gelf}
#: What a value of the wrong JSON type is called, by key; text-only keys take no numbers.
_WRONG_TYPE = {
    k: {"float_sec_to_usec": "not_seconds", "hex_to_uint": "not_hex", "syslog_timestamp": "not_stamp"}.get(
        s.conversion, {C.STRING: "not_string", C.TEXT: "not_string", C.I64: "not_i64"}.get(f.storage, "not_u64")
    )
    for k, (f, s) in _SOURCES.items()
}
_TEXT_ONLY = {k for k, reason in _WRONG_TYPE.items() if reason in ("not_string", "not_stamp")}
_RESULT = T.StructType([T.StructField(k, T.StringType()) for k in (*_KEYS, "json_reason", "type_reason")])


class _Number(str):
    """A JSON number as written."""


class _Object(list):
    """Members of a JSON object, repeats included."""


def _refuse(name: str):
    raise ValueError(name)


_decoder = json.JSONDecoder(
    object_pairs_hook=_Object, parse_float=_Number, parse_int=_Number, parse_constant=_refuse
)


def _encode_all(value) -> None:
    """Raise where some key or text within a JSON value cannot be written as UTF-8."""
    if isinstance(value, str):
        value.encode()
    elif isinstance(value, _Object):
        for key, member in value:
            key.encode()
            _encode_all(member)
    elif isinstance(value, list):
        for member in value:
            _encode_all(member)


def _take_apart(body: bytes) -> tuple[dict[str, str], str | None, str | None]:
    """Texts of the known keys, what is wrong with the JSON, and the first value of a wrong type."""
    try:
        text = body.decode("utf-8")
    except UnicodeDecodeError:
        return {}, "bad_utf8", None
    try:
        members = _decoder.decode(text)
        if not isinstance(members, _Object):
            return {}, "bad_json", None
        if "\\u" in text:
            # Half of a surrogate pair is not a character.
            _encode_all(members)
    except (ValueError, RecursionError):
        return {}, "bad_json", None
    values = dict(members)
    if len(values) < len(members):
        names = [k for k, _ in members if k in C.REQUIRED_GELF_KEYS]
        if len(names) > len(set(names)):
            return {}, "required:repeated", None
    for key in C.REQUIRED_GELF_KEYS:
        if type(values.get(key)) is not str:
            return {}, f"required:{key}", None
    texts, wrong = {}, None
    for key, value in values.items():
        if key not in _WRONG_TYPE:
            continue
        kind = type(value)
        if kind is str:
            texts[key] = value
        elif kind is _Number and key not in _TEXT_ONLY:
            # A number is no hexadecimal text but a value of its own; past 20 digits it fits no field.
            is_hex = _WRONG_TYPE[key] == "not_hex"
            texts[key] = (format(int(value), "x") if value.isdigit() and len(value) <= 20 else "-") if is_hex else value
        elif wrong is None:
            wrong = f"{_SOURCES[key][0].name}:{key}:{_WRONG_TYPE[key]}"
    return texts, None, wrong


def _columns_of(bodies: list[bytes | None]) -> dict[str, pa.Array]:
    """The texts of each known key and the two reasons, a row for each body; a missing body has nulls only."""
    n = len(bodies)
    columns: dict[str, list] = {}
    for i, body in enumerate(bodies):
        if body is None:
            continue
        texts, json_reason, type_reason = _take_apart(body)
        if json_reason is not None:
            columns.setdefault("json_reason", [None] * n)[i] = json_reason
        if type_reason is not None:
            columns.setdefault("type_reason", [None] * n)[i] = type_reason
        for key, text in texts.items():
            if key not in columns:
                columns[key] = [None] * n
            columns[key][i] = text
    absent = pa.nulls(n, pa.string())
    return {name: pa.array(columns[name], pa.string()) if name in columns else absent for name in _RESULT.names}


@F.arrow_udf(_RESULT)
def _take_apart_batch(bodies: pa.Array) -> pa.Array:
    made = _columns_of(bodies.to_pylist())
    return pa.StructArray.from_arrays(list(made.values()), names=list(made))


_DECODED = T.StructType(
    [
        T.StructField("inflate_reason", T.StringType()),
        T.StructField("gelf", T.StructType([T.StructField(k, T.StringType()) for k in _KEYS])),
        T.StructField("json_reason", T.StringType()),
        T.StructField("type_reason", T.StringType()),
    ]
)


def decode_gelf_packets(df: DataFrame, payload: str = "payload", max_bytes: int = MAX_BODY) -> DataFrame:
    """Classified packets, opened and taken apart in one step: what ``inflate`` and ``decode_gelf_json`` add, but for ``body``.

    Bodies never leave the Python worker; batches are bounded by the bytes of the bodies in them, and a body of more than ``max_bytes`` is
    refused with the ``inflate_reason`` ``too_large``.
    """
    def columns(bodies: list, reasons: list) -> list[pa.Array]:
        made = _columns_of(bodies)
        gelf = pa.StructArray.from_arrays([made[k] for k in _KEYS], names=list(_KEYS))
        no_body = pa.array(["no_body" if b is None else None for b in bodies], pa.string())
        return [pa.array(reasons, pa.string()), gelf, pc.coalesce(made["json_reason"], no_body), made["type_reason"]]

    bound_batches(df.sparkSession)
    return map_bodies(df, _DECODED, columns, payload, max_bytes)


def decode_gelf_json(df: DataFrame, body: str = "body") -> DataFrame:
    """Decode a binary JSON body.

    Adds ``gelf`` (a struct with the text of each known key, null where absent), ``json_reason``
    (null where the body is a usable message) and ``type_reason`` (a known key of a JSON type
    that its column never takes). The body must be UTF-8 and exactly one JSON object.
    """
    # Marked as not repeatable so that no filter or projection above runs it a second time.
    parsed = df.withColumn("gelf", _take_apart_batch.asNondeterministic()(F.col(body)))
    return parsed.select(
        *[c for c in df.columns if c not in ("json_reason", "type_reason")],
        "gelf",
        F.coalesce("gelf.json_reason", F.when(F.col(body).isNull(), "no_body")).alias("json_reason"),
        "gelf.type_reason",
    )


def gelf_messages(df: DataFrame, body: str = "body") -> DataFrame:
    """The general message form: ``message`` = version, host, short_message and a map of the rest.

    Takes rows with a good body; ``other`` holds every additional key, known or not.
    """
    parsed = settle(df.withColumn("_v", F.try_parse_json(F.col(body).cast("string"))), "_v")
    v = F.col("_v")
    entries = F.map_filter(v.cast("map<string,variant>"), lambda k, _: ~k.isin(*C.REQUIRED_GELF_KEYS))
    text = [F.try_variant_get(v, f"$.{k}", "string").alias(k) for k in C.REQUIRED_GELF_KEYS]
    return parsed.withColumn("message", F.struct(*text, entries.alias("other"))).drop("_v")
