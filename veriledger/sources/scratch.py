"""Tables written to the shared folder: they cut lineage and fix what depends on how rows met in a task."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: list[str] = []


def root(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``. Where that is unset, a folder of our own in local mode, as in tests; on a cluster executors would not share it."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    if _own is None:
        _own = "file://" + tempfile.mkdtemp(prefix="veriledger-")
    return _own


def path(spark: SparkSession, label: str) -> str:
    at = f"{root(spark)}/veriledger/{label}-{uuid.uuid4().hex}"
    _made.append(at)
    return at


def drop_all(spark: SparkSession) -> None:
    """Delete the tables written so far by this driver; results that still read them have to be stored first."""
    while _made:
        at = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    at = path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
