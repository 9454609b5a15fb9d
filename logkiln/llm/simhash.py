"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: 64 bits, each the majority over the XXH64 of all word shingles. Links: fingerprints
with at most ``RADIUS`` differing bits. Candidates: each bit gets a non-zero vector of RADIUS + 1
bits; table v (each non-zero vector) keeps the bits whose vector has odd product with v. Four
differing bits give four equations in five unknowns, so some table ignores them all: every
pair within the radius shares a bucket of some table.

Equal fingerprints are one node before anything is dealt out. A bucket of two is checked in place;
a bucket of up to ``BUCKET`` nodes is searched breadth-first in one task and gives only the edges of
a spanning forest; a larger one is cut by the same construction on the bits that it does not fix yet,
again and again, which again keeps every pair within the radius together somewhere. So
no pair is lost and no bucket gives its square. Components come from large-star and small-star rounds.

Defined results: a null or empty text has fingerprint zero and links like any other; texts of
fewer words than a shingle have one shingle; rows with the same id keep their rows; a component
of null ids only has a null id; an empty table gives an empty one. Other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.llm.common import bound_batches, lower_words, utf8
from logkiln.staging import stage

RADIUS = 4
#: Nodes of a bucket that one task compares with each other; larger ones are cut further.
BUCKET = 4096


def fingerprint(data: bytes, size: int = 4, seed: int = 42) -> int:
    """The SimHash of one text as a signed 64-bit number."""
    import xxhash

    words = lower_words(data)
    if not words:
        return 0
    if len(words) < size:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in shingles), np.uint64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """Rows (doc_id, fp)."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(x.as_py(), size) for x in b.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps], ["doc_id", "fp"])

    return docs.select("doc_id", utf8().alias("b")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def covering_masks(radius: int = RADIUS, turn: int = 0) -> list[int]:
    """The tables' masks as signed numbers; another ``turn`` deals the vectors to other bits."""
    n = 2 ** (radius + 1) - 1
    step = (5, 7, 11, 13, 17, 19, 23, 29)[turn % 8]
    vectors = [1 + ((i * step + turn) % 64 * 37 + i // 31) % n for i in range(64)]
    masks = []
    for v in range(1, n + 1):
        m = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return masks


def _dealt(rows: DataFrame, masks: list[int], fixed: Column) -> DataFrame:
    """Rows (fp) into buckets (mask, key): the bits that are fixed already and those of each table."""
    options = F.array(*[F.lit(m).cast("bigint") for m in masks])
    dealt = rows.select("fp", F.explode(F.array_distinct(F.transform(options, lambda m: m.bitwiseOR(fixed)))).alias("mask"))
    return dealt.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")


def spanning_edges(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among some fingerprints; breadth-first, a row of distances a node."""
    left, edges = fps.astype(np.uint64), []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            x = frontier.pop()
            near = np.bitwise_count(left ^ x) <= radius
            reached = left[near]
            if len(reached):
                edges += [(int(np.int64(x.view(np.int64))), int(y)) for y in reached.view(np.int64)]
                frontier += list(reached)
                left = left[~near]
    return edges


def near_edges(nodes: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) over distinct fingerprints ``nodes`` (fp) whose components are those of all links."""
    spark = nodes.sparkSession

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = [e for x in b.column(0) for e in spanning_edges(np.array(x.as_py(), np.int64).view(np.uint64), radius)]
            u, v = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    parts: list[DataFrame] = []
    rows, fixed, turn = nodes, F.lit(0).cast("bigint"), 0
    while True:
        dealt = _dealt(rows, covering_masks(radius, turn), fixed)
        sizes = dealt.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
        sizes = stage(sizes)
        near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius
        parts.append(sizes.where((F.col("n") == 2) & near).select("u", "v"))
        several = sizes.where(F.col("n").between(3, bucket)).select("mask", "key")
        lists = dealt.join(several, ["mask", "key"]).groupBy("mask", "key").agg(F.collect_list("fp").alias("fps"))
        parts.append(lists.select("fps").mapInArrow(search, "u bigint, v bigint"))
        large = sizes.where(F.col("n") > bucket).select("mask", "key")
        if large.isEmpty():
            break
        rows = stage(dealt.join(large, ["mask", "key"]).select("fp", F.col("mask").alias("done")))
        fixed, turn = F.col("done"), turn + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _both(a: Column, b: Column, c: Column, d: Column) -> Column:
    """The edges (a, b) and (c, d) of a row, as two rows of one scan."""
    return F.explode(F.array(F.struct(a.alias("u"), b.alias("v")), F.struct(c.alias("u"), d.alias("v"))))


def _stars(edges: DataFrame) -> bool:
    """Whether each node is either the larger end of one edge or the root, at smaller ends only."""
    over = F.struct(F.col("u").alias("node"), F.when(F.col("u") > F.col("v"), 1).otherwise(2).alias("over"), F.lit(0).alias("under"))
    under = F.struct(F.col("v").alias("node"), F.lit(0).alias("over"), F.lit(1).alias("under"))
    ends = edges.select(F.explode(F.array(over, under)).alias("end")).select("end.*")
    ends = ends.groupBy("node").agg(F.sum("over").alias("over"), F.max("under").alias("under"))
    return not ends.where("over > 1 OR over > 0 AND under > 0").agg(F.count("*")).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with u > v to (node, root): root is the smallest node that can be reached.

    Alternating large-star and small-star rounds until all that is left are stars, which no round changes; each half of one is written
    to the shared folder, so that plans stay small. A node with very many edges is reduced by partial minima, and the joins may be split by Spark.
    """
    edges, u, v, m = stage(edges), F.col("u"), F.col("v"), F.col("m")
    while not _stars(edges):
        both = edges.select(_both(u, v, v, u).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("a")).select("u", F.least("u", "a").alias("m"))
        large = stage(both.join(least, "u").where("v > u").select(v.alias("u"), m.alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(_both(v, m, u, m).alias("e")).select("e.*")
        edges = stage(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return edges.select(u.alias("node"), v.alias("root"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Rows (doc_id, fp, component_id): the smallest doc_id that links can reach."""
    fps = stage(fingerprints(docs, size))
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(near_edges(nodes.select("fp"), radius, bucket))
    rooted = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
