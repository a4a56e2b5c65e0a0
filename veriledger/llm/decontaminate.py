"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions alone.

A test item counts as leaked into a document when the document holds at least ``threshold`` of
the item's distinct word shingles. Items are short and documents long, so the sketch is the
item's: the minimum hashes of its shingles. Items are partitioned by size so that all of a partition need
the same number of minimum hashes: of n shingles at most floor((1 - threshold) n) may be missing, so any
floor((1 - threshold) n) + 1 of them include one that a leaking document holds; partition k holds the sizes n for which that
is k. All shingles of a document are looked up, so the search
misses no leak. Every candidate is then verified by exact containment over the
shingles' text.

Item shingles of at most ``broadcast_rows`` rows are broadcast, their hashes for the search and their text for verification.
Larger sets are joined by a shuffle of shingle hashes; either way documents are read once for the search. Documents
are never joined with each other.

Defined results: texts are lower-cased A-Z and cut at ASCII white space; an item of fewer words
than a shingle is one shingle of all its words and is sought among runs of that many words;
items of null or empty text match nothing; null and empty documents hold nothing; very long texts are searched whole, as arrays of
a row's words; an item held to exactly ``threshold`` (a tie) is a leak; rows that share
a doc_id or an item_id are searched each and reported once with the largest share; a null doc_id
is reported as null; items without an id are not reported, but documents that hold one are
dropped; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, fold_case, materialise

SHINGLE = 5
THRESHOLD = 0.8
#: Most rows of item shingles that are broadcast.
BROADCAST_ROWS = 500_000


def words(text: str) -> Column:
    return F.regexp_extract_all(fold_case(text), F.lit(f"({WORD_PATTERN})"))


def shingle_texts(word_array: str, size: int) -> Column:
    """Distinct runs of ``size`` words, joined by one space; none where the text is shorter."""
    w = F.col(word_array)
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (size - 1)), lambda i: F.array_join(F.slice(w, i, size), " "))
    return F.when(F.size(w) >= size, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def shingle_hashes(word_hashes: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, from the words' own hashes."""
    h = F.col(word_hashes)
    parts = lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(size)))
    return F.when(F.size(h) >= size, F.transform(F.sequence(F.lit(0), F.size(h) - size), parts)).otherwise(F.array().cast("array<bigint>"))


def item_shingles(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, width, n, hash, text): the distinct shingles of each item; ``width`` is their number of words."""
    items = benchmark.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    items = items.withColumn("width", F.least(F.size("w"), F.lit(shingle)))
    by_width = [items.where(F.col("width") == k).withColumn("text", F.explode(shingle_texts("w", k))) for k in range(1, shingle + 1)]
    rows = by_width[0]
    for more in by_width[1:]:
        rows = rows.unionByName(more)
    rows = rows.select("item_id", "width", "text").distinct()
    counted = rows.groupBy("item_id", "width").agg(F.count("*").alias("n"))
    # The same hash of word hashes that documents get.
    hashed = F.split("text", " ")
    word_hash = F.transform(hashed, lambda w: F.xxhash64(w))
    of_width = F.coalesce(*(F.when(F.col("width") == k, F.xxhash64(*(F.get(word_hash, F.lit(j)) for j in range(k)))) for k in range(1, shingle + 1)))
    return rows.join(counted, ["item_id", "width"]).withColumn("hash", of_width)


def sketches(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The minimum hashes of each item, as many as its size partition needs."""
    from pyspark.sql import Window

    parted = items.withColumn("partition", F.col("n") - needed(threshold) + 1)
    place = F.row_number().over(Window.partitionBy("item_id", "width").orderBy("hash", "text"))
    return parted.withColumn("place", place).where(F.col("place") <= F.col("partition")).select("item_id", "width", "hash", "partition")


def needed(threshold: float) -> Column:
    """How many of an item's n shingles reach the threshold."""
    return F.ceil(F.col("n") * F.lit(threshold) - 1e-9)


def _document_words(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")


def _small(df: DataFrame, rows: int, broadcast_rows: int) -> DataFrame:
    """Broadcast a table of a checked number of rows; leave a larger one to a shuffle."""
    return F.broadcast(df) if rows <= broadcast_rows else df


def candidates(docs: DataFrame, sketch: DataFrame, widths: list[int], n_rows: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, text_hash, item_id): documents that hold at least one sketch hash of an item."""
    hashed = _document_words(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), F.transform(words("text"), lambda w: F.xxhash64(w)).alias("h"))
    found = None
    for width in widths:
        shingles = hashed.select("doc_id", "text_hash", F.explode(shingle_hashes("h", width)).alias("hash"))
        hits = shingles.join(_small(sketch.where(F.col("width") == width).select("item_id", "hash"), n_rows, broadcast_rows), "hash").select("doc_id", "text_hash", "item_id")
        found = hits if found is None else found.unionByName(hits)
    return found.distinct()


def verified(docs: DataFrame, found: DataFrame, items: DataFrame, widths: list[int], n_rows: int, broadcast_rows: int, threshold: float = THRESHOLD) -> DataFrame:
    """Exact containment of the candidates: shared shingles are counted over their text."""
    rows = _document_words(docs).withColumn("text_hash", F.xxhash64("text"))
    pairs = found.select("doc_id", "text_hash").distinct().withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = rows.join(pairs, rows["doc_id"].eqNullSafe(pairs["_id"]) & (rows["text_hash"] == pairs["_hash"]), "left_semi")
    rows = rows.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", words("text").alias("w"))
    counts = None
    for width in widths:
        shingles = rows.select("doc_id", "text_hash", F.explode(shingle_texts("w", width)).alias("shingle"))
        of_width = items.where(F.col("width") == width).select("item_id", "n", F.col("text").alias("shingle"))
        hits = shingles.join(_small(of_width, n_rows, broadcast_rows), "shingle").groupBy("doc_id", "text_hash", "item_id", "n").agg(F.count("*").alias("n_shared"))
        counts = hits if counts is None else counts.unionByName(hits)
    kept = counts.where(F.col("n_shared") >= needed(threshold))
    return kept.join(found, [kept["doc_id"].eqNullSafe(found["doc_id"]), kept["text_hash"] == found["text_hash"], kept["item_id"] == found["item_id"]], "left_semi")


def _search(docs: DataFrame, texts: DataFrame, threshold: float, shingle: int, broadcast_rows: int) -> DataFrame:
    """(doc_id, text_hash, item_id, n, n_shared) of every leak of ``texts``, whose item_id is not null and names one text."""
    items = materialise(item_shingles(texts, shingle), "items")
    shape = items.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()  # one row, at most ``shingle`` widths
    widths = sorted(shape["widths"]) or [shingle]
    found = materialise(candidates(docs, sketches(items, threshold), widths, shape["n"], broadcast_rows), "candidates")
    return verified(docs, found, items, widths, shape["n"], broadcast_rows, threshold)


def _item_texts(benchmark: DataFrame) -> DataFrame:
    """Each distinct text of the items once, under its hash as item_id."""
    return benchmark.where("text IS NOT NULL").select(F.xxhash64("text").alias("item_id"), "text").distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared, containment for every leak of an item with an id; texts are not carried along."""
    named = benchmark.where("item_id IS NOT NULL")
    found = _search(docs, _item_texts(named), threshold, shingle, broadcast_rows).withColumnRenamed("item_id", "item_key")
    ids = named.select(F.xxhash64("text").alias("item_key"), "item_id").distinct()
    share = F.col("n_shared") / F.col("n")
    best = found.join(ids, "item_key").groupBy("doc_id", "item_id").agg(F.max(F.struct(share.alias("containment"), "n_shared", "n")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.n").alias("n_item_shingles"), "b.n_shared", "b.containment")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Documents that hold no benchmark item, with an id or without; all columns as they came. Rows go by doc_id and text.

    The list of leaks is written first, so that Spark knows its size: under its threshold texts stay where they are, above it they move once.
    """
    found = _search(docs, _item_texts(benchmark), threshold, SHINGLE, broadcast_rows)
    bad = materialise(found.select(F.col("doc_id").alias("__bad_id"), F.col("text_hash").alias("__bad_hash")).distinct(), "leaks")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad_id"]) & (F.xxhash64(docs["text"]) == bad["__bad_hash"]), "left_anti")
