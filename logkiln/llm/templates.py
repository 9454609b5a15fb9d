"""Line deduplication by a log-template tree, in DataFrame operations only.

Equal lines, words with digits counting as ``<*>``, are one kind. A kind of ``MIN_WORDS`` words or more is dropped from the second
document on; a shorter one with a letter in it, once it stands in ``SHORT_DOCS`` documents.

Kinds that differ go down a tree: first by their number of words, then by their leading ``DEPTH`` words. A leaf is
refined top-down, a round for all leaves at a time. At a place of a group the word that at least half of its documents
hold is constant, whatever their number. If at least ``ALIKE`` of the places are constant, the lines that agree with as many of them are a template and
leave the group; what is left is a group again. A group without template is split by the words of the place that most agree on below one
half; words that are rare next to the most frequent one stay together. Templates that occur in ``MIN_DOCS`` or more documents are
dropped. The first line of each kind and template (smallest doc_id, then place) stays, so that no content is lost.

Leaves that too few documents reach are left out before any word is looked at, and equal lines are one row with
their number of documents, so a line with a million copies costs a row per task. All joins are by
hash of group, template or document and may be split by Spark.

Defined results: null texts stay null; an empty text stays empty; lines without letters of fewer than ``MIN_WORDS`` words stay; rows that
are equal in id and text get the same result, and count as one document; a null id comes last; an empty table
gives an empty one; all other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.functions.columns import settle
from logkiln.staging import stage

MIN_DOCS, MIN_WORDS, DEPTH, ALIKE = 3, 3, 3, 0.7
#: Documents from which on equal lines go: of MIN_WORDS words and more, and shorter ones.
EQUAL_DOCS, SHORT_DOCS = 2, 10
#: A split gives a group of its own to words with at least this share of the most frequent one's documents.
NEXT_TO = 0.25
_ANY = "<*>"
_SPACE = "[\x20\x09-\x0d]+"


def masked(line: Column) -> Column:
    """The line with single blanks and its words with digits as ``<*>``."""
    odd = F.contains(line, F.lit("  "))
    for c in "\t\r\x0b\x0c":
        odd = odd | F.contains(line, F.lit(c))
    plain = F.btrim(F.when(odd, F.regexp_replace(line, _SPACE, " ")).otherwise(line))
    return F.when(plain.rlike("[0-9]"), F.regexp_replace(plain, "(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", _ANY)).otherwise(plain)


def _row_key(doc: str = "doc_id", text: str = "text") -> Column:
    return F.xxhash64(F.col(doc), F.col(text))


def line_table(docs: DataFrame) -> DataFrame:
    """Rows (key, doc, place, leaf, line_hash, short): every line that may be dropped, with the hash of its masked form."""
    lines = docs.where("text IS NOT NULL").select(
        _row_key().alias("key"), F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("place", "raw")
    )
    # Settled, so that filters below do not repeat the masking.
    cut = settle(lines.select("key", "doc", "place", masked(F.col("raw")).alias("line")), "line")
    words = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    counted = settle(cut.where(F.col("line") != "").withColumn("words", words), "words")
    short = F.col("words") < MIN_WORDS
    counted = counted.where(~short | F.col("line").rlike(r"\p{L}"))
    leaf = F.xxhash64("words", F.substring_index("line", " ", DEPTH))
    return counted.select("key", "doc", "place", leaf.alias("leaf"), F.xxhash64("line").alias("line_hash"), short.alias("short"))


def _words(docs: DataFrame, different: DataFrame, min_docs: int) -> DataFrame:
    """Rows (group, leaf, line_hash, docs, at, word) of leaves with several kinds of lines and enough documents.

    Words are looked at for one line of each kind only; those are fetched from their documents.
    """
    long = different.where(~F.col("short"))
    several = long.groupBy("leaf").agg(F.count("*").alias("n"), F.sum("docs").alias("all")).where((F.col("n") > 1) & (F.col("all") >= min_docs)).select("leaf")
    wanted = long.join(several, "leaf").select("leaf", "line_hash", "docs", "first.key", "first.place")
    by_text = wanted.groupBy("key").agg(F.collect_list(F.struct("leaf", "line_hash", "docs", "place")).alias("wanted"))
    texts = docs.where("text IS NOT NULL").select(_row_key().alias("key"), "text").join(by_text, "key").dropDuplicates(["key"])
    raw = texts.select(F.split("text", "\n").alias("raw"), F.explode("wanted").alias("w")).select("w.leaf", "w.line_hash", "w.docs", F.col("raw")[F.col("w.place")].alias("raw"))
    words = raw.select("leaf", "line_hash", "docs", F.posexplode(F.split(masked(F.col("raw")), " ")).alias("at", "word"))
    return words.select(F.col("leaf").alias("group"), "*")


def line_templates(docs: DataFrame, different: DataFrame, min_docs: int = MIN_DOCS, alike: float = ALIKE) -> DataFrame:
    """Rows (leaf, line_hash, template): the template, as a hash, of each kind of line that has one with others."""
    words, done = stage(_words(docs, different, min_docs)), []
    while True:
        held = words.groupBy("group", "at", "word").agg(F.sum("docs").alias("held"))
        top = F.max(F.when(F.col("word") != _ANY, F.struct("held", "word")))
        places = held.groupBy("group", "at").agg(top.alias("top"), F.sum("held").alias("all")).where(F.col("all") >= min_docs)
        fixed = F.coalesce(2 * F.col("top.held") >= F.col("all"), F.lit(False))
        places = stage(places.select("group", "at", "all", "top.held", F.col("top.word").alias("most"), fixed.alias("fixed")))
        splits = (F.col("held") >= min_docs) & (F.col("held") < F.col("all"))
        pick = F.max(F.when(splits, F.struct((~F.col("fixed")).alias("low"), "held", (-F.col("at")).alias("before"))))
        groups = places.groupBy("group").agg(F.count("*").alias("n"), F.count_if("fixed").alias("n_fixed"), pick.alias("pick"))
        agreed = words.join(places.select("group", "at", "most", "fixed"), ["group", "at"]).groupBy("group", "leaf", "line_hash").agg(
            F.count_if(F.col("fixed") & (F.col("word") == F.col("most"))).alias("agreed")
        )
        enough = (F.col("n_fixed") >= alike * F.col("n")) & (F.col("agreed") >= alike * F.col("n"))
        lines = stage(agreed.join(groups, "group").select("group", "leaf", "line_hash", enough.alias("enough"), "pick"))
        done.append(lines.where("enough").select("leaf", "line_hash", F.xxhash64("group", F.lit("template")).alias("template")))
        found = stage(lines.where("enough").select("group").distinct())
        rest = lines.where("NOT enough").join(found, "group", "left_semi").select("leaf", "line_hash", F.xxhash64("group", F.lit("rest")).alias("next"))
        split = lines.where("pick IS NOT NULL").join(found, "group", "left_anti")
        split = split.select("group", "leaf", "line_hash", (-F.col("pick.before")).alias("at"), F.col("pick.held").alias("most"))
        own = F.greatest(F.lit(min_docs), NEXT_TO * F.col("most"))
        here = split.join(words.select("leaf", "line_hash", "at", "word"), ["leaf", "line_hash", "at"]).join(held, ["group", "at", "word"])
        word = F.when((F.col("word") != _ANY) & (F.col("held") >= own), F.col("word")).otherwise(_ANY)
        parts = here.select("leaf", "line_hash", F.xxhash64("group", "at", word).alias("next"))
        going = rest.unionByName(parts)
        words = stage(words.join(going, ["leaf", "line_hash"]).select(F.col("next").alias("group"), "leaf", "line_hash", "docs", "at", "word"))
        if words.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, alike: float = ALIKE) -> DataFrame:
    """Rows (key, place) of lines to be dropped."""
    lines = stage(line_table(docs))
    order = F.struct(F.col("doc").isNull().alias("none"), "doc", "key", "place")
    each = lines.groupBy("leaf", "line_hash", "short", "key").agg(F.min(order).alias("first"))
    different = stage(each.groupBy("leaf", "line_hash", "short").agg(F.min("first").alias("first"), F.count("*").alias("docs")))
    same = (F.col("first.key") == F.col("key")) & (F.col("first.place") == F.col("place"))
    equal = different.where(F.col("docs") >= F.when(F.col("short"), SHORT_DOCS).otherwise(EQUAL_DOCS)).select("leaf", "line_hash", "first")
    gone = lines.join(stage(equal), ["leaf", "line_hash"]).where(~same).select("key", "place")
    templates = stage(line_templates(docs, different, min_docs, alike))
    placed = stage(lines.join(templates, ["leaf", "line_hash"]).select("key", "doc", "place", "template"))
    spread = placed.select("template", "key").distinct().groupBy("template").agg(F.count("*").alias("docs")).where(F.col("docs") >= min_docs)
    first = placed.groupBy("template").agg(F.min(order).alias("first"))
    # Staged, so that the join below deals out both sides anew and a hot template may be split.
    recurring = stage(spread.join(first, "template").select("template", "first"))
    # The first line of a template is the first of its kind too, so it stays.
    return gone.unionByName(placed.join(recurring, "template").where(~same).select("key", "place")).distinct()


def drop_repeated_lines(docs: DataFrame, min_docs: int = MIN_DOCS, alike: float = ALIKE, count: str | None = "n_dropped_lines") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; n_chars follows if there is one.

    ``count`` names a column for the number of lines dropped, in place of one that ``docs`` has; without a name there is none.
    """
    places = repeated_lines(docs, min_docs, alike).groupBy("key").agg(F.collect_set("place").alias("places"))
    # The columns of docs travel as one, so that their names meet no others.
    joined = docs.select(F.struct("*").alias("document"), "text", _row_key().alias("key")).join(places, "key", "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("places", i))
    text = F.when(F.col("places").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.coalesce(F.size("places"), F.lit(0)))
    columns = []
    for c in docs.columns:
        made = text if c == "text" else F.length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col("document")[c]
        if c != count:
            columns.append(made.alias(c))
    return joined.select(*columns, *([n.cast("bigint").alias(count)] if count else []))
