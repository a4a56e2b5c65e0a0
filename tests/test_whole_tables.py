"""Queries over whole tables leave no row out."""

from __future__ import annotations

from veriledger.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_item_is_searched(spark):
    items = {r.item_id for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    q = registry.queries()
    assert {r.qid for r in q["retrieve_bm25l_all"](spark, SF).select("qid").distinct().collect()} == items
    assert {r.question for r in q["retrieve_multi_query_all"](spark, SF).collect()} == {i // 4 for i in items}


def test_every_document_has_a_window(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("text IS NOT NULL")
    got = registry.queries()["retrieve_parent_window_all"](spark, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in docs.collect())
