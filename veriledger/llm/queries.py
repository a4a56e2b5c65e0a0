"""Queries of the training-data operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff_lm, decontaminate, divergence_rules, fm_quality, hilbert_shards, line_block_html, pack_concat, simhash_dedup, subword_toxicity, warc
from .common import table
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_backoff_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff_lm.backoff_scores(table(spark, sf_dir, "documents"))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword_toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"))


def op7_pack_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_concat.pack(table(spark, sf_dir, "documents"))


def op8_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_line_block_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_block_html.extract(table(spark, sf_dir, "pages"))


def op10_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    ours = (
        op1_factorisation_machine, op2_backoff_automaton, op3_divergence_rules, op4_warc_round_trip, op5_subword_toxicity,
        op6_hilbert_shards, op7_pack_concat, op8_simhash_pigeonhole, op9_line_block_html, op10_minhash_containment,
    )
    return {f.__name__: f for f in ours}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
