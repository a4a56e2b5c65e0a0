"""SimHash near-duplicates: pigeonhole blocks over 64-bit fingerprints, Hamming check, components.

Steps
1. Every whole text gets its fingerprint; equal fingerprints become one node from here on, so
   exact copies cost nothing further however many there are.
2. Pigeonhole: the 64 bits are cut into six blocks. Two fingerprints at three or fewer
   differing bits agree on at least three blocks, so each node is listed under all 20 choices
   of three blocks, and a pair that links meets under one key at least.
3. Nodes under one key are linked within the key and leave as a star (node, root), never as
   pairs. A key with more than ``KEY_LIMIT`` nodes is listed again under 20 finer keys over its
   free bits; a finer key leaves at most 16 bits free, so it never has more than 65,536 nodes,
   and its links are found by flipping bits, not by comparing all with all. Work and memory of
   a task are bounded whatever the size of a group of near copies.
4. Components of the star edges: alternating large-star and small-star rounds, each written to
   the shared folder.

Defined results: null and empty texts have fingerprint zero and link like any other; texts of
one or two words hash their whole word sequence; very long texts are hashed in runs; a bit set in exactly half of the hashes (a tie) is not set; null ids are members but never name a
component unless all its ids are null; repeated rows are repeated in the result; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_bytes

SEED = 42
SHINGLE = 3
MAX_BITS = 3
#: Widths of the six pigeonhole blocks, from the low bits.
BLOCKS = (11, 11, 11, 11, 10, 10)
#: A key with more nodes than this is listed again under finer keys.
KEY_LIMIT = 2_000


def _masks(widths: tuple[int, ...], within: int = (1 << 64) - 1, choose: int = 3) -> list[int]:
    """Bit masks of all choices of ``choose`` blocks of the bits set in ``within``."""
    bits = [i for i in range(64) if within >> i & 1]
    blocks, at = [], 0
    for w in widths:
        blocks.append(sum(1 << b for b in bits[at : at + w]))
        at += w
    return [sum(c) for c in itertools.combinations(blocks, choose)]


MASKS = _masks(BLOCKS)


def _finer(mask: int) -> list[int]:
    """Masks of the second listing: ``mask`` and three of six blocks of the bits it leaves free; 16 bits at most stay free."""
    free = ~mask & ((1 << 64) - 1)
    n = free.bit_count()
    widths = tuple(n // 6 + (k < n % 6) for k in range(6))
    return [mask | m for m in _masks(widths, free)]


FINER = [_finer(m) for m in MASKS]


def fingerprints(texts: list[bytes], most: int = 200_000) -> np.ndarray:
    """Fingerprints of whole texts; shingles are hashed in runs of about ``most`` to bound memory."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = text.lower().split()
        n = len(words) - SHINGLE + 1
        if not words:
            continue
        if n < 1:
            out[k] = digest(b" ".join(words), SEED)
            continue
        ones = np.zeros(64, np.int64)
        for at in range(0, n, most):
            run = words[at : min(n, at + most) + SHINGLE - 1]
            hashes = np.array([digest(b"%b %b %b" % t, SEED) for t in zip(run, run[1:], run[2:])], np.uint64)
            ones += _bit_counts(hashes)
        out[k] = _pack(ones * 2 > n)
    return out


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit, low bit first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _pack(bits: np.ndarray) -> np.uint64:
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")[0]


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, text_hash) for every row; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, size in slices(b, "text"):
                fp = fingerprints(text_bytes(b, "text", start, size)).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, size), pa.array(fp), b.column(1).slice(start, size)], ["doc_id", "fp", "text_hash"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return narrow.mapInArrow(run, "doc_id long, fp long, text_hash long")


def _listed(nodes: DataFrame, masks: list[int]) -> DataFrame:
    """Each node under its keys: (mask number, masked bits)."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(k).cast("short").alias("m"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)))
    return nodes.select("fp", F.explode(keys).alias("k")).select("fp", "k.m", "k.key")


def _roots(fp: np.ndarray, free: int) -> np.ndarray:
    """Smallest fingerprint linked with each, among distinct ones that differ only in ``free`` bits."""
    n = len(fp)
    parent = np.arange(n)
    order = np.argsort(fp)
    fp_sorted = fp[order]
    if n <= 256:
        close = np.bitwise_count(fp_sorted[:, None] ^ fp_sorted[None, :]) <= MAX_BITS
        a, b = np.nonzero(np.triu(close, 1))
        pairs = [(a, b)]
    else:
        pairs = _flipped(fp_sorted, free)
    # Label propagation with pointer jumping; labels are positions in sorted order, so the smallest is the root.
    label = parent.copy()
    stored = list(pairs) if n <= 256 else None
    while True:
        before = label.copy()
        for a, b in stored if stored is not None else _flipped(fp_sorted, free):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    out = np.empty(n, fp.dtype)
    out[order] = fp_sorted[label]
    return out


def _flipped(fp: np.ndarray, free: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions among sorted fingerprints: by flips of up to three free bits where that is less work, else row by row."""
    bits = [np.uint64(1 << i) for i in range(64) if free >> i & 1]
    flips = [sum(c) for r in range(1, MAX_BITS + 1) for c in itertools.combinations([int(b) for b in bits], r)] if len(bits) <= 16 else None
    if flips is not None and len(flips) < len(fp):
        for m in flips:
            at = np.searchsorted(fp, fp ^ np.uint64(m))
            at[at == len(fp)] = 0
            a = np.nonzero((fp[at] == fp ^ np.uint64(m)) & (fp < fp ^ np.uint64(m)))[0]
            if len(a):
                yield a, at[a]
    else:
        for i in range(len(fp) - 1):
            b = np.nonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= MAX_BITS)[0]
            if len(b):
                yield np.full(len(b), i), b + i + 1


def _stars(listed: DataFrame, masks: list[int], n_parts: int) -> DataFrame:
    """(fp, root) for nodes that link with a smaller one under the same key. Keys are small by construction here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at: tuple[int, int] | None = None

        def flush() -> Iterator[pa.RecordBatch]:
            if at is not None and held:
                fp = np.unique(np.concatenate(held))
                if len(fp) > 1:
                    root = _roots(fp, ~masks[at[0]] & ((1 << 64) - 1))
                    moved = root != fp
                    if moved.any():
                        yield pa.RecordBatch.from_arrays([pa.array(fp[moved].view(np.int64)), pa.array(root[moved].view(np.int64))], ["fp", "root"])

        for b in batches:
            fp, m, key = (b.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.nonzero((m[1:] != m[:-1]) | (key[1:] != key[:-1]))[0] + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(fp)]):
                if (now := (int(m[lo]), int(key[lo]))) != at:
                    yield from flush()
                    held, at = [], now
                held.append(fp[lo:hi].astype(np.int64).view(np.uint64))
        yield from flush()

    return listed.repartition(n_parts, "m", "key").sortWithinPartitions("m", "key").mapInArrow(run, "fp long, root long")


def star_edges(nodes: DataFrame) -> DataFrame:
    """Edges whose components are those of all fingerprint pairs at three or fewer differing bits. ``nodes``: distinct fp."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = _listed(nodes, MASKS)
    sizes = listed.groupBy("m", "key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(listed.join(sizes, ["m", "key"]).select("fp", "m", "key", F.when(F.col("n") > KEY_LIMIT, True).otherwise(False).alias("hot")), "keys")
    small = _stars(shared.where("NOT hot").select("fp", "m", "key"), MASKS, parts)
    masks = [m for ms in FINER for m in ms]
    signed = F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))
    finer = (
        shared.where("hot").select("fp", F.explode(F.sequence(F.col("m") * 20, F.col("m") * 20 + 19)).alias("m"))
        .select("fp", F.col("m").cast("short").alias("m"), F.col("fp").bitwiseAND(F.element_at(signed, F.col("m") + 1)).alias("key")).distinct()
    )
    return small.unionByName(_stars(finer, masks, parts)).distinct()


def components(edges: DataFrame, label: str = "edges") -> DataFrame:
    """(node, root) for all nodes of ``edges`` (fp, root): alternating large-star and small-star until nothing changes.

    Each round is written to the shared folder. A round's neighbours are reduced to their
    minimum by aggregation, never gathered into one row, so a node with very many edges is not collected in one task.
    """
    now = materialise(edges.select(F.greatest("fp", "root").alias("a"), F.least("fp", "root").alias("b")).where("a <> b").distinct(), label)
    while True:
        large = _large_star(now)
        after = materialise(_small_star(large), label)
        before = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1099511627689).alias("h")).first()
        then = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1099511627689).alias("h")).first()
        now = after
        if before == then:
            return now.select(F.col("a").alias("fp"), F.col("b").alias("root"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the node's smallest neighbour (itself included)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is joined to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def component_table(fps: DataFrame) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint, named by its smallest fingerprint."""
    nodes = fps.select("fp").distinct()
    roots = components(star_edges(nodes))
    return materialise(nodes.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs``."""
    fps = materialise(fingerprint_table(docs), "fingerprints")
    rooted = component_table(fps)
    ids = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")).join(rooted, "fp").groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component, that with the smallest id, all columns as they came.

    Null ids come last; among rows of one id the text with the smallest hash stays, and rows repeated with id and text leave one row.
    What goes is listed first, as (id, text hash): under Spark's broadcast threshold texts stay where they are, above it they move once.
    Only rows of a kept text that stands there twice are brought together to leave one.
    """
    fps = materialise(fingerprint_table(docs), "fingerprints")
    rooted = component_table(fps)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    rows = fps.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("n")).join(rooted, "fp")
    first = rows.groupBy("root").agg(F.min(rank).alias("rank"))
    fate = rows.join(first, "root").select("doc_id", "text_hash", "n", F.col("rank.doc_id").eqNullSafe(F.col("doc_id")).alias("same_id"), (F.col("rank.text_hash") == F.col("text_hash")).alias("same_text"))
    marked = fate.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), (F.col("same_id") & F.col("same_text")).alias("__stays"), F.col("n").alias("__n"))
    marked = materialise(marked.where("NOT __stays OR __n > 1"), "fates")  # what goes, and what stays but stands there twice
    hashed = docs.withColumn("__row_hash", F.xxhash64("text"))
    same = lambda other: hashed["doc_id"].eqNullSafe(other["__id"]) & (hashed["__row_hash"] == other["__hash"])
    once = hashed.join(marked, same(marked), "left_anti")
    twice = marked.where("__stays")
    if not twice.limit(1).count():
        return once.drop("__row_hash")
    return once.unionByName(hashed.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", "__row_hash"])).drop("__row_hash")
