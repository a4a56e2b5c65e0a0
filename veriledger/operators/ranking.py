"""Ranks over a whole table without a single sorting task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialise

_PLACE = (1 << 33) - 1


def global_ordinal(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """Number all rows in order.

    Range partitions are sorted and written with their number and each row's place in it; the
    partitions' counts, one row a partition, are then added up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = materialise(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()), "ordinal")
    cut = cut.withColumn("_part", F.shiftright("_id", 33))
    counts = cut.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return cut.join(F.broadcast(bases), "_part").withColumn(name, F.col("_base") + F.col("_id").bitwiseAND(F.lit(_PLACE)) + first).drop("_part", "_base", "_id")
