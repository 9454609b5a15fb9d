"""MinHash near-duplicates by fast similarity sketching: rounds of hashed placement into bins.

A document is the set of its different shingles of ``WORDS`` words. Its sketch has ``BINS`` coordinates. In round r each shingle is
hashed once, to a bin and a fraction; the value of a bin is the least (round, fraction) that fell into it. Rounds go on until each
bin has a value; from round ``BINS`` on, round ``BINS`` + j puts all shingles into bin j, so no coordinate stays empty even for one
shingle. As a document with many shingles fills its bins in two or three rounds, a sketch costs little more than its
shingles, and the share of equal coordinates is concentrated about the similarity at least as well as with independent minima.

``BANDS`` bands of ``ROWS`` coordinates give the buckets: a pair of similarity s meets with probability 1 - (1 - s**ROWS)**BANDS, which
leaves out 8 in ten million at 0.85. Documents of equal sets are one node. Links are confirmed on the full sets, as 64-bit hashes:
first each node with the smallest of its buckets, which joins large groups at one pair a node and bucket. In the buckets that
still hold several parts, every node outside the largest part is compared with all nodes of the others, in blocks of bounded
size that are dealt out over the tasks; a task emits at most a spanning forest. So no link that buckets propose is lost.

Defined results: A-Z count as a-z; a text of fewer words than a shingle has one shingle; null texts and texts without words have
no set and link with nothing, not even with each other; rows with the same id keep their rows; a component of null ids only has a
null id and none of it is kept, beside numbered ones null ids are not kept; an empty table gives an empty one. Only
``doc_id`` and ``text`` are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logkiln.llm.common import bound_batches, lower_words, utf8
from logkiln.llm.simhash import components
from logkiln.staging import stage

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union.
PERCENT = 85
BANDS, ROWS = 45, 8
BINS = BANDS * ROWS
#: Hashed values that one step of a sketch holds.
STEP = 1 << 14
#: Shingles and nodes of a block; a task compares two blocks.
BLOCK_SHINGLES, BLOCK_NODES = 1 << 17, 512
#: Links that one copy of a node's set is compared for.
FAN = 512


def shingle_set(data: bytes) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    import xxhash

    words = lower_words(data)
    if not words:
        return np.zeros(0, np.uint64)
    each = map(b" ".join, zip(*(words[i:] for i in range(WORDS)))) if len(words) >= WORDS else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(hashes: np.ndarray, bins: int = BINS) -> np.ndarray:
    """``bins`` values, round in the upper 16 bits and fraction below; rounds are worked several at a time, which changes no minimum."""
    values, done, n = np.full(bins, np.iinfo(np.uint64).max), 0, len(hashes)
    while done < 2 * bins and (values == np.iinfo(np.uint64).max).any():
        # Later rounds of a step cannot change what an earlier one filled, as the round comes first in a value.
        rounds = np.arange(done, min(done + max(1, min(STEP, 4 * bins) // n), bins if done < bins else 2 * bins), dtype=np.uint64)
        for at in range(0, n, STEP):
            h = _mix(hashes[None, at : at + STEP] + (rounds[:, None] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
            value = (rounds[:, None] << np.uint64(48)) | (h >> np.uint64(16))
            if done < bins:
                # Another mixture than that of the fraction, so bin and fraction are independent.
                bin_of = (((_mix(h) >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)).astype(np.int64)
                np.minimum.at(values, bin_of.ravel(), value.ravel())
            else:
                own = rounds.astype(np.int64) - bins
                values[own] = np.minimum(values[own], value.min(axis=1))
        done += len(rounds)
    return values


def band_keys(values: np.ndarray) -> np.ndarray:
    """One bucket a band, made of the number and the values of the band."""
    rows = values.reshape(-1, ROWS)
    key = np.arange(1, len(rows) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for row in rows.T:
        key = _mix(key ^ row) + np.uint64(0x9E3779B97F4A7C15)
    return key.view(np.int64)


def _row_keys() -> list[Column]:
    """Name a row by its id and text; rows that agree in both have the same set."""
    return [F.xxhash64("doc_id").alias("id_key"), F.xxhash64("b").alias("k1"), F.xxhash64(F.lit(1), "b").alias("k2")]


def _signed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, id_key, k1, k2, n_shingles, digest, bands); digest names the set, null if there is none."""
    bound_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py()) for x in b.column(4)]
            bands = [band_keys(sketch(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            ends = pa.array(np.cumsum([0, *map(len, bands)], dtype=np.int32))
            digests = [hashlib.md5(s.tobytes()).digest() if len(s) else None for s in sets]
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *bands]))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(ends, flat)],
                ["doc_id", "id_key", "k1", "k2", "n_shingles", "digest", "bands"],
            )

    rows = docs.select("doc_id", utf8().alias("b")).select("doc_id", *_row_keys(), "b")
    return rows.mapInArrow(run, f"doc_id {kind}, id_key bigint, k1 bigint, k2 bigint, n_shingles bigint, digest binary, bands array<bigint>")


def _set_table(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, hashes) for the nodes of ``wanted`` (node, id_key, k1, k2), from one text each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py()).view(np.int64) for x in b.column(1)]
            ends = pa.array(np.cumsum([0, *map(len, sets)], dtype=np.int32))
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, flat)], ["node", "hashes"])

    keys = ["id_key", "k1", "k2"]
    texts = docs.select("doc_id", utf8().alias("b")).select(*_row_keys(), "b")
    return texts.join(wanted, keys).dropDuplicates(keys).select("node", "b").mapInArrow(run, "node bigint, hashes array<bigint>")


def _enough(n_a, n_b):
    """Sizes that allow a link."""
    return 100 * F.least(n_a, n_b) >= PERCENT * F.greatest(n_a, n_b)


def linked_to(i: int, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Which sets are linked with set i: ``flat`` numbers the shingles of all sets, ``present`` is scratch space."""
    mine = flat[starts[i] : starts[i] + sizes[i]]
    present[mine] = True
    both = np.add.reduceat(present[flat], starts, dtype=np.int64)
    present[mine] = False
    return 100 * both >= PERCENT * (sizes + sizes[i] - both)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between nodes of different parts in each pair of blocks; those that earlier ones make superfluous are left out."""
    for b in batches:
        u, v = [], []
        for members in b.column(0):
            m = members.values
            nodes, outside = m.field("node").to_numpy(), m.field("outside").to_numpy(zero_copy_only=False)
            _, roots = np.unique(m.field("part").to_numpy(), return_inverse=True)
            lists = m.field("hashes")
            sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
            _, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            starts, present = np.cumsum(sizes) - sizes, np.zeros(len(flat) + 1, bool)
            for i in np.flatnonzero(outside):
                near = np.flatnonzero(linked_to(i, flat, starts, sizes, present) & (roots != roots[i]))
                for j in near:
                    if roots[i] != roots[j]:
                        u.append(int(max(nodes[i], nodes[j]))), v.append(int(min(nodes[i], nodes[j])))
                        roots[roots == roots[j]] = roots[i]
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _confirmed(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """The edges (u, v) that are links. A node with very many edges has its set copied, one copy for ``FAN`` of them."""
    many = edges.groupBy("v").agg(F.ceil(F.count("*") / FAN).cast("int").alias("copies"))
    b = sets.join(many, F.col("node") == F.col("v")).select("v", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("hashes").alias("b"))
    a = sets.select(F.col("node").alias("u"), F.col("hashes").alias("a"))
    dealt = edges.join(many, "v").withColumn("copy", F.pmod(F.xxhash64("u"), F.col("copies")).cast("int")).drop("copies")
    both = F.size(F.array_intersect("a", "b"))
    return dealt.join(a, "u").join(b, ["v", "copy"]).where(100 * both >= PERCENT * (F.size("a") + F.size("b") - both)).select("u", "v")


def _parts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (node, part) for all ``nodes``."""
    joined = components(links)
    return nodes.join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("part"))


def _rest(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (u, v) between different parts of a bucket; ``members`` is (key, node, part, size)."""
    parts = members.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    most = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    sides = parts.join(most, "key").withColumn("outside", F.col("part") != F.col("most.part"))
    blocks = F.greatest(F.ceil(F.sum("total") / BLOCK_SHINGLES), F.ceil(F.sum("n") / BLOCK_NODES), F.lit(1)).cast("int")
    cut = sides.groupBy("key").agg(F.first("most.part").alias("main"))
    sized = sides.groupBy("key", "outside").agg(blocks.alias("k"))
    cut = cut.join(sized.where("outside").select("key", F.col("k").alias("k_out")), "key").join(sized.where("not outside").select("key", F.col("k").alias("k_main")), "key")
    dealt = members.join(cut, "key").withColumn("outside", F.col("part") != F.col("main"))
    # Outside blocks are numbered from 0, main ones from k_out on. An outside block meets itself, other outside blocks and all main ones.
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("outside"), F.col("k_out")).otherwise(F.col("k_main"))).cast("int")
    dealt = dealt.withColumn("block", F.when(F.col("outside"), spread).otherwise(F.col("k_out") + spread))
    with_out = F.transform(F.sequence(F.lit(0), F.col("k_out") - 1), lambda i: F.struct(F.least(i, "block").alias("i"), F.greatest(i, "block").alias("j")))
    with_main = F.transform(F.sequence(F.col("k_out"), F.col("k_out") + F.col("k_main") - 1), lambda j: F.struct(F.col("block").alias("i"), j.alias("j")))
    meets = F.when(F.col("outside"), F.concat(with_out, with_main)).otherwise(with_out)
    met = dealt.select("key", "node", "part", "outside", F.explode(meets).alias("at")).join(sets, "node")
    lists = met.groupBy("key", "at").agg(F.collect_list(F.struct("node", "part", "outside", "hashes")).alias("members"))
    return lists.select("members").mapInArrow(_forest, "u bigint, v bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept): the smallest doc_id that links can reach."""
    rows = stage(_signed(docs))
    each = rows.where(F.col("digest").isNotNull()).groupBy("digest").agg(
        F.min("doc_id").alias("least"), F.min(F.struct("id_key", "k1", "k2")).alias("at"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands")
    )
    nodes = stage(each.withColumn("node", F.monotonically_increasing_id()))
    dealt = nodes.select("node", "size", F.explode("bands").alias("key"))
    # Buckets of the same nodes are one: number and two sums of hashes name their members.
    buckets = dealt.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("v"), F.max(F.struct("node", "size")).alias("last"), F.min(F.struct("node", "size")).alias("first"),
        *(F.sum(F.xxhash64("node", F.lit(k)).cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)),
    ).where("n > 1").dropDuplicates(["n", "v", "h1", "h2"])
    buckets = stage(buckets.select("key", "n", "first", "last"))
    pairs = buckets.where("n = 2").select(F.col("last.node").alias("u"), F.col("last.size").alias("a"), F.col("first.node").alias("v"), F.col("first.size").alias("b"))
    members = stage(dealt.join(buckets.where("n > 2").select("key", "first"), "key"))
    stars = members.where("node <> first.node").select(F.col("node").alias("u"), F.col("size").alias("a"), F.col("first.node").alias("v"), F.col("first.size").alias("b"))
    edges = stage(pairs.unionByName(stars).where(_enough(F.col("a"), F.col("b"))).select("u", "v").distinct())
    asked = edges.select(F.explode(F.array("u", "v")).alias("node")).unionByName(members.select("node")).distinct()
    sets = stage(_set_table(docs, nodes.join(asked, "node").select("node", "at.*")))
    links = stage(_confirmed(edges, sets))
    parts = _parts(members.select("node").distinct(), links)
    placed = stage(members.select("key", "node", "size").join(stage(parts), "node"))
    found = components(links.unionByName(_rest(placed, sets)).distinct())
    rooted = nodes.join(found, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(smallest, "root").select("digest", "component_id")
    ids = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = rows.drop("bands").join(named, "digest", "left").select("doc_id", "n_shingles", ids.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
