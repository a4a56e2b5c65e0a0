"""Sharding by a Hilbert curve, in DataFrame functions alone.

Several metadata dimensions are quantised to equal-depth steps, each row gets its place on the
Hilbert curve through those steps, rows are put in curve order and the order is cut into runs.
Rows near each other in all dimensions then share a shard, so minimum and maximum statistics
of every dimension prune files. The law kept is ``rows``: shard counts are at most one apart.

Steps are of equal depth over all rows: numbers and times by mergeable quantile sketches, strings by
the exact counts of their distinct values in sorted order, whole strings compared. Either way fifteen
bounds a dimension are all that is broadcast.

Order: curve index, checksum of the text (copies lie together), doc_id. A total rank is made
without a single sorting task: range partitions are sorted, written with their task number and
place, and the tasks' counts (one row a task) are added up.

Defined results: null text has size 8 and checksum 0; null metadata share the first step of their
dimension; null ids are placed; repeated rows are placed each, and rows alike in all four keys (ties) in any order,
which changes no result; very long texts are read once for size and checksum and not carried; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

STEP_BITS = 4


def order_value(column: str, dtype: str) -> Column:
    """What a dimension is ordered by: numbers and times as doubles, anything else as whole strings."""
    col = F.col(column)
    if dtype == "date":
        return F.unix_date(col).cast("double")
    if dtype in ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "timestamp") or dtype.startswith("decimal"):
        return col.cast("double")
    return col.cast("string")


def hilbert_index(df: DataFrame, coords: list[str], bits: int, name: str) -> DataFrame:
    """Add the place on the Hilbert curve of integer coordinates of ``bits`` bits each.

    From the high bit down, the curve's orientation is undone by conditional exchanges and
    reversals of lower bits; a Gray code and the interleaving of bits then give the place.
    """
    n = len(coords)
    x = [f"_x{i}" for i in range(n)]
    df = df.withColumns({x[i]: F.col(coords[i]).cast("long") for i in range(n)})
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            is_set = F.col(x[i]).bitwiseAND(F.lit(1 << level)) != 0
            swap = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(F.lit(low))
            first = F.when(is_set, F.col(x[0]).bitwiseXOR(F.lit(low))).otherwise(F.col(x[0]).bitwiseXOR(swap))
            other = F.when(is_set, F.col(x[i])).otherwise(F.col(x[i]).bitwiseXOR(swap))
            df = df.withColumns({x[0]: first, x[i]: other} if i else {x[0]: first})
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(F.lit(1 << level)) != 0, F.lit((1 << level) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_turn", turn)
    place = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col("_turn")), level).bitwiseAND(F.lit(1))
            place = place.bitwiseOR(F.shiftleft(bit, level * n + n - 1 - i))
    return df.withColumn(name, place).drop(*x, "_turn")


def string_bounds(df: DataFrame, column: str, steps: int, name: str) -> DataFrame:
    """One row: the sorted values at which the rows, in order of ``column``, pass from one of ``steps`` equal parts to the next.

    Values are counted by aggregation and added up along range partitions, a row a partition for what lies before; no task sorts all values.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    ordered = materialise(counts.repartitionByRange(parts, "value").sortWithinPartitions("value").withColumn("_id", F.monotonically_increasing_id()), "values").withColumn("_part", F.shiftright("_id", 33))
    sums = ordered.groupBy("_part").agg(F.sum("n").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_total"))
    running = F.sum("n").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, 0))
    at = ordered.withColumn("_up_to", running).join(F.broadcast(bases), "_part").withColumn("_up_to", F.col("_base") + F.col("_up_to"))
    passes = F.expr(f"(_up_to - n) * {steps} div _total < least(_up_to * {steps} div _total, {steps - 1})")
    return at.where(passes).agg(F.sort_array(F.collect_list("value")).alias(name))  # fewer than ``steps`` values


def quantised(df: DataFrame, columns: list[str], bits: int = STEP_BITS) -> DataFrame:
    """Add ``<column>_q``: the equal-depth step, 0 to 2^bits - 1, of each column: how many bounds are less than its value."""
    steps, kinds = 1 << bits, dict(df.dtypes)
    shares = [k / steps for k in range(1, steps)]
    for c in columns:
        bounds = string_bounds(df, c, steps, f"{c}_b") if kinds[c] == "string" else df.agg(F.percentile_approx(c, shares, 2000).alias(f"{c}_b"))
        df = df.crossJoin(F.broadcast(bounds))  # one row
    return df.withColumns({f"{c}_q": F.expr(f"size(filter(coalesce({c}_b, array()), b -> b < {c}))") for c in columns}).drop(*(f"{c}_b" for c in columns))


def hilbert_shards(docs: DataFrame, n_shards: int = 24, dimensions: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = STEP_BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve index and rank for every row."""
    kinds = dict(docs.dtypes)
    text = F.coalesce("text", F.lit(""))
    codes = [f"_c{i}" for i in range(len(dimensions))]
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        *(order_value(d, kinds[d]).alias(c) for d, c in zip(dimensions, codes)),
    )
    narrow = materialise(narrow, "shard-keys")  # texts are read once
    placed = hilbert_index(quantised(narrow, codes, bits), [f"{c}_q" for c in codes], bits, "curve").select("doc_id", "size", "text_crc32", "curve")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = placed.repartitionByRange(parts, "curve", "text_crc32", "doc_id").sortWithinPartitions("curve", "text_crc32", "doc_id", "size")
    ordered = materialise(ordered.withColumn("_id", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("_id", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row a range partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias("_total"))
    ranked = ordered.withColumn("_part", part).join(F.broadcast(bases), "_part").withColumn("rank", F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    shard = F.expr(f"(rank * {n_shards}) div _total")
    first = F.expr(f"(shard * _total + {n_shards - 1}) div {n_shards}")
    return ranked.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve"), "rank"
    )
