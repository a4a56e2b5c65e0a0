"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes all rows that its predecessor kept. Quality rules, toxicity, near-duplicates
and benchmark leaks remove rows and return the columns of ``documents``; packing returns pieces.

Defined results: null and empty texts go with the first stage, as they have fewer than 50 words; rows with a null id are kept or go by
their text like any other, and in a group of near copies an id stays before none; rows repeated with id and text leave one row, those that share an
id alone are judged apart; of near copies the smallest id stays, and of several texts under it the one with the least hash (ties); very long
texts go through every stage whole; extra columns are carried to the last stage; empty tables give no rows, and an empty label or benchmark table removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriledger.llm import decontaminate, divergence_rules, pack_concat, simhash_dedup, subword_toxicity
from veriledger.llm.common import id_bucket, materialise, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return divergence_rules.keep_passing(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = subword_toxicity.train(docs, table(spark, sf_dir, "labels"), id_bucket("doc_id", 5) != 0)
    return subword_toxicity.keep_clean(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_dedup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaking(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Workers hold what earlier stages left, so this one takes less memory and more time than the query of its own.
    return pack_concat.pack(docs, slice_bytes=2_000_000, cached=100_000)


STAGES = [("quality_rules", quality_rules), ("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: The rules, the trained model and the tokenizer have no SQL form; each stage is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
