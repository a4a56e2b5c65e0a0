"""How queries are registered and how they reach their tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its DuckDB twin if SQL can say it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *names: str, by: str | None = None) -> DataFrame:
    """A source view written in SQL that Spark and DuckDB both read; ``{name}`` stands for a table.

    With ``by`` the tables are dealt out by that column of theirs, while their rows are still narrow and few.
    """
    tables = {n: table(spark, sf_dir, n) for n in names}
    return spark.sql(sql, **{n: t.repartition(by) if by else t for n, t in tables.items()})


def plain(sql: str) -> str:
    """The same view for DuckDB, where tables are registered under their names."""
    return sql.replace("{", "").replace("}", "").replace("`", '"')
