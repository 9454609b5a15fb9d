"""Chunked messages that are chunks again, found on arrival facts; contents stay where they are.

Whether a message is a chunk, and which, is told by the first bytes of its pieces, which each arrival carries as ``head``, with
the ``length`` of its content. A message that is one becomes an arrival itself, with the arrivals that it is made of as
``parts``; its content hash is made of theirs. ``unfold`` puts the parts in the place of such an arrival, so contents are joined to
plain chunks only, once, whatever the depth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.operators import chunks as K
from logkiln.operators.packets import CHUNK_MAGIC, HEADER_BYTES, byte_at
from logkiln.staging import stage

#: Columns that tell arrivals apart; equal ones have equal contents.
ARRIVAL = ("k", "t", "seqno", "count", "src_ip", "src_port", "h")
FACTS = (*ARRIVAL, "head", "length", "inner")
#: Headers right behind each other that a head holds; what lies deeper is looked up.
STACKED = 64
_AT = ("at_k", "at_t", "at_seqno", "at_count", "at_ip", "at_port", "at_h")


def with_facts(chunks: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows (``FACTS``, content) of classified chunk rows. A head has the first header's bytes, and more where headers follow each other."""
    content = F.col("content")
    first = F.hex(F.substring(content, 1, HEADER_BYTES * STACKED))
    magic, more = CHUNK_MAGIC.hex().upper(), 2 * (HEADER_BYTES - len(CHUNK_MAGIC))
    headers = F.unhex(F.regexp_extract(first, f"^(?:{magic}[0-9A-F]{{{more}}})*[0-9A-F]{{0,{2 * HEADER_BYTES}}}", 0))
    head = F.when(F.substring(content, 1, 2) == F.lit(CHUNK_MAGIC), headers).otherwise(F.substring(content, 1, HEADER_BYTES))
    length = F.octet_length(content).cast("bigint")
    return K.arrivals_of(chunks, key, head.alias("head"), length.alias("length"), F.lit(False).alias("inner"), "content")


def _may_begin(head: Column) -> Column:
    """Whether a packet of which ``head`` is known may be a chunk."""
    short = (F.octet_length(head) == 0) | ((F.octet_length(head) == 1) & (head == F.lit(CHUNK_MAGIC[:1])))
    return short | (F.substring(head, 1, 2) == F.lit(CHUNK_MAGIC))


def _same(rows: DataFrame, names: tuple[str, ...], others: DataFrame, prefix: str) -> Column:
    same = F.lit(True)
    for name, c in zip(names, ARRIVAL):
        other = others[f"{prefix}{c}"]
        same = same & (rows[name].eqNullSafe(other) if c in ("src_ip", "src_port") else rows[name] == other)
    return same


def inner_chunks(pieces: DataFrame, facts: DataFrame, key: tuple[str, ...], contents: DataFrame, before: DataFrame | None = None) -> DataFrame | None:
    """Complete messages among ``pieces`` that are chunks, as facts, with the group (of, scope, n) and its ``parts``.

    ``facts`` are those of the arrivals, ``before`` the inner chunks among them, ``contents`` the plain ones. None if there can be none.
    """
    openers = stage(facts.where((F.col("seqno") == 0) & _may_begin(F.col("head"))).select("k").distinct())
    if openers.isEmpty():
        return None
    known = facts.join(openers, "k", "left_semi").groupBy(*ARRIVAL).agg(F.max("head").alias("head"), F.max("length").alias("length"), F.max("inner").alias("inner"))
    known = known.select(*[F.col(c).alias(f"f_{c}") for c in ARRIVAL], "head", "length", "inner")
    full = pieces.where(F.col("status") == K.COMPLETE).join(openers, "k", "left_semi").drop("copies", "status", "opened", "present", "size")
    parts = F.array_sort(F.collect_set(F.struct("slot", "t", "count", "src_ip", "src_port", "h", "length", "inner", "head")))
    full = full.join(known, _same(full, ("k", "t", "slot", "count", "src_ip", "src_port", "h"), known, "f_"))
    groups = full.groupBy(F.col("k").alias("of"), "scope", "n", "closed", "closed_ip", "closed_port").agg(parts.alias("parts"))

    def further(done: Column, part: Column) -> Column:
        return F.struct(
            F.when(done["open"], F.concat(done["bytes"], part["head"])).otherwise(done["bytes"]).alias("bytes"),
            (done["open"] & (F.octet_length(part["head"]) == part["length"])).alias("open"),
        )

    begin = F.aggregate("parts", F.struct(F.lit(b"").alias("bytes"), F.lit(True).alias("open")), further, lambda done: done["bytes"])
    zero = F.lit(0).cast("bigint")

    def size(parts: Column) -> Column:
        return F.aggregate(parts, zero, lambda done, part: done + part["length"])

    placed = F.transform("parts", lambda part, i: F.struct(
        *[part[c].alias(c) for c in ("slot", "t", "count", "src_ip", "src_port", "h", "length", "inner")], size(F.slice("parts", 1, i)).alias("at")
    ))
    found = groups.select("of", "scope", "n", "closed", "closed_ip", "closed_port", begin.alias("begin"), size(F.col("parts")).alias("total"), placed.alias("parts"))
    unsure = F.octet_length("begin") < HEADER_BYTES
    chunk = _may_begin(F.col("begin")) & (F.col("total") >= HEADER_BYTES) & (unsure | (byte_at(F.col("begin"), HEADER_BYTES) >= K.MIN_COUNT))
    found = stage(found.where(chunk))
    if not found.where(unsure).isEmpty():
        looked_up = _looked_up(found.where(unsure), contents, before)
        found = stage(found.where(~unsure).unionByName(looked_up.select(*found.columns)).where(chunk))
    number = found.select(
        "of", "scope", "n", "parts", "begin", F.substring("begin", 3, 8).alias("chunk_id"), F.col("closed").alias("t"), F.timestamp_micros("closed").alias("recv_ts"),
        byte_at(F.col("begin"), 11).alias("seqno"), byte_at(F.col("begin"), 12).alias("count"), F.col("closed_ip").alias("src_ip"), F.col("closed_port").alias("src_port"),
        F.xxhash64(F.transform("parts", lambda part: part["h"])).alias("h"), (F.col("total") - HEADER_BYTES).alias("length"),
    )
    head = F.substring("begin", HEADER_BYTES + 1, HEADER_BYTES * STACKED)
    return number.select(K.chunk_key(key).alias("k"), *ARRIVAL[1:], head.alias("head"), "length", F.lit(True).alias("inner"), "of", "scope", "n", "parts")


def _looked_up(groups: DataFrame, contents: DataFrame, before: DataFrame | None) -> DataFrame:
    """``groups`` with ``begin`` read from the contents: heads of many small pieces may be known too short."""
    group, first = ["of", "scope", "n"], 2 * HEADER_BYTES
    rows = groups.select(*group, F.explode("parts").alias("p")).where(F.col("p.at") < first).select(
        *group, *[F.col(c).alias(name) for name, c in zip(_AT, ("of", "p.t", "p.slot", "p.count", "p.src_ip", "p.src_port", "p.h"))],
        F.col("p.at").alias("pos"), F.lit(0).cast("bigint").alias("skip"), F.col("p.inner").alias("inner"),
    )
    rows = unfold(rows, before).where(F.col("pos") < first)
    held = contents.select(*[F.col(c).alias(f"c_{c}") for c in ARRIVAL], "content")
    bytes_of = F.substr(F.col("content"), F.col("skip") + 1, F.lit(first).cast("bigint"))
    parts = rows.join(held, _same(rows, _AT, held, "c_")).groupBy(*group).agg(F.array_sort(F.collect_set(F.struct("pos", bytes_of.alias("bytes")))).alias("found"))
    whole = F.aggregate("found", F.lit(b""), lambda done, part: F.concat(done, part["bytes"]))
    return groups.drop("begin").join(parts.select(*group, F.substring(whole, 1, first).alias("begin")), group)


def unfold(rows: DataFrame, inner: DataFrame | None) -> DataFrame:
    """``rows`` with the plain arrivals that hold their bytes in the place of each ``inner`` chunk, to any depth.

    Rows name an arrival (``at_``...), where its bytes go (``pos``), how many of the first are left out (``skip``) and whether it may be an inner one.
    """
    kept = [c for c in rows.columns if c not in (*_AT, "pos", "skip", "inner")]
    done = rows.where("NOT inner")
    if inner is None:
        return rows.drop("inner")
    made = stage(inner.dropDuplicates(list(ARRIVAL)).select(*[F.col(c).alias(f"i_{c}") for c in ARRIVAL], F.col("of").alias("i_of"), F.col("parts").alias("i_parts")))
    # In the place of the parts of what is no inner chunk.
    none = F.array(F.lit(None).cast(made.schema["i_parts"].dataType.elementType))
    rows = rows.where("inner")
    while True:
        joined = rows.join(made, _same(rows, _AT, made, "i_"), "left").withColumn("p", F.explode(F.coalesce("i_parts", none)))
        opened, base = F.col("i_parts").isNotNull(), F.col("skip") + HEADER_BYTES
        # A part that ends with the header goes with it; the last one stays, so that nothing at all is a row too.
        last = F.element_at("i_parts", -1)["slot"] == F.col("p.slot")
        joined = joined.where(~opened | last | (F.col("p.at") + F.col("p.length") > base))
        names = ("i_of", "p.t", "p.slot", "p.count", "p.src_ip", "p.src_port", "p.h")
        joined = stage(joined.select(
            *kept, *[F.when(opened, F.col(c)).otherwise(F.col(name)).alias(name) for name, c in zip(_AT, names)],
            F.when(opened, F.col("pos") + F.greatest(F.col("p.at") - base, F.lit(0))).otherwise(F.col("pos")).alias("pos"),
            F.when(opened, F.greatest(base - F.col("p.at"), F.lit(0))).otherwise(F.col("skip")).cast("bigint").alias("skip"),
            (opened & F.col("p.inner")).alias("inner"),
        ))
        done, rows = done.unionByName(joined.where("NOT inner")), joined.where("inner")
        if rows.isEmpty():
            return done.drop("inner")


def unfolded_rows(rows: DataFrame, inner: DataFrame) -> DataFrame:
    """Rows of ``winners`` for ``assembled``, with the parts of inner chunks in their place."""
    names = ("k", "t", "slot", "count", "src_ip", "src_port", "h")
    # Of a message only its bytes come out, so the senders of its pieces need not travel.
    done = F.col("status") == K.COMPLETE
    own = {c: F.when(~done, F.col(c)).alias(c) for c in ("t", "count", "src_ip", "src_port")}
    kept = [own.get(c, F.col(c)) for c in rows.columns if c != "h"]
    zero = F.lit(0).cast("bigint")
    return unfold(rows.select(*kept, *[F.col(c).alias(a) for a, c in zip(_AT, names)], zero.alias("pos"), zero.alias("skip"), F.lit(True).alias("inner")), inner)
