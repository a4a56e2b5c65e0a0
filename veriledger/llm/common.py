"""Shared pieces of the training-data operators: tables, scratch space, text access."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise, path as scratch_path  # noqa: F401  shared by the operators

#: ASCII white space; words are maximal runs of anything else. ``bytes.split()`` cuts at exactly these six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark alone so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(batch: pa.RecordBatch, column: str, start: int, size: int) -> list[bytes]:
    """UTF-8 bytes of rows of a string column; null reads as empty."""
    part = batch.column(batch.schema.get_field_index(column)).slice(start, size)
    return [b"" if x is None else x for x in part.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Cut a batch into runs of rows of about ``most_bytes`` of text, a row at least."""
    lengths = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    start = total = 0
    for i, x in enumerate(lengths):
        total += len(x.as_buffer()) if x.is_valid else 0
        if total >= most_bytes:
            yield start, i + 1 - start
            start, total = i + 1, 0
    if start < batch.num_rows:
        yield start, batch.num_rows - start


def fold_case(text: str | Column) -> Column:
    """Lower-case A-Z alone; null becomes empty."""
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_bucket(doc_id: str | Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; the fold that fixes held-out rows. Null ids read as empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus


def bounded_sample(docs: DataFrame, picked: DataFrame, max_bytes: int) -> DataFrame:
    """One document row for each id of ``picked`` (doc_id and more, a bounded number of ids), in hash order of the ids until ``max_bytes`` of text are reached.

    An id that stands on many rows gives one of them, that whose text has the least hash. The first row is taken whatever its size.
    """
    hashed = docs.withColumn("_hash", F.coalesce(F.xxhash64("text"), F.lit(0)))
    joined = hashed.join(F.broadcast(picked.select("doc_id")), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min(F.struct("_hash", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"))).alias("r"))
    up_to = F.sum("r.size").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))  # over the picked ids alone
    chosen = one.select("doc_id", F.col("r._hash").alias("_hash"), up_to.alias("_up_to"), F.col("r.size").alias("_size")).where((F.col("_up_to") <= max_bytes) | (F.col("_up_to") == F.col("_size"))).drop("_up_to", "_size")
    rows = hashed.join(F.broadcast(chosen.join(picked, "doc_id")), ["doc_id", "_hash"])
    return rows.dropDuplicates(["doc_id"]).drop("_hash")
