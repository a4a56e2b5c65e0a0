"""Readers, sinks and streams."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from veriledger.operators import catalogues
from veriledger.sources import readers, scratch
from veriledger.streaming import rules


def test_ledger_keeps_written_forms(spark, tmp_path):
    (tmp_path / "l.csv").write_text("transaction_id,invoice_number,purchase_order_number,transaction_date,posting_date,amount,currency,counterparty,counterparty_role\nT1,007,,2024-01-01,,1250.50,USD,Acme,buyer\n", encoding="utf-8")
    r = readers.read_ledger(spark, str(tmp_path)).first()
    assert (r.invoice_number, r.amount, r.purchase_order_number) == ("007", "1250.50", None)


def test_pages_to_tokens(spark, tmp_path):
    box = [{"x": 1.0, "y": 2.0}, {"x": 5.0, "y": 2.0}, {"x": 5.0, "y": 4.0}, {"x": 1.0, "y": 4.0}]
    doc = {"pages": [{"page": 1, "width": 10, "height": 10, "source": "s", "preprocessing": {}}], "tokens": [{"id": "a", "page": 1, "text": "é", "bbox": box, "confidence": 0.9}], "engine": "e"}
    (tmp_path / "d.json").write_text(json.dumps(doc), encoding="utf-8")
    r = readers.token_rows(readers.read_ocr(spark, str(tmp_path))).first()
    assert (r.tid, r.text, r.x, r.y, r.w, r.h) == ("a", "é", 1.0, 2.0, 4.0, 2.0)


def test_results_and_traces(spark, tmp_path):
    cells = spark.createDataFrame([(1, "b", None, "missing"), (1, "a", "x", "accepted")], "doc_id long, field string, value string, status string")
    readers.write_results(cells, str(tmp_path / "r"))
    r = spark.read.json(str(tmp_path / "r")).first()
    assert r.schema_version == "2.0" and [f.field for f in r.fields] == ["a", "b"]
    for _ in range(2):
        readers.append_trace(spark.createDataFrame([("secret?", 1)], "question string, ms long"), str(tmp_path / "t"))
    t = spark.read.json(str(tmp_path / "t"))
    assert t.count() == 2 and t.where(F.col("question").contains("secret")).count() == 0


def test_chains_reach_through_others(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.root for r in catalogues.reference_chains(pairs).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 100: 100, 101: 100}


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, i, t, "click") for i, t in enumerate([0, 10, 20, 30, 301, 311])], "user_id long, event_id long, s long, event_type string").withColumn("ts", F.timestamp_seconds("s"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("limited", rules.rate_limit_stream(stream, limit=3), "append"), ("counted", rules.windowed_counts(stream), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").orderBy("event_id").collect()] == [True, True, True, False, True, True]
    assert sorted(r.n for r in spark.table("counted").collect()) == [2, 4]


def test_scratch_tables_can_be_dropped(spark):
    df = scratch.materialise(spark.range(3).withColumnRenamed("id", "n"), "test")
    assert df.count() == 3
    at = df.inputFiles()[0].rsplit("/", 1)[0]
    scratch.drop_all(spark)
    assert not os.path.exists(at.removeprefix("file://"))


def test_scratch_folder_is_named_on_a_cluster(spark, monkeypatch):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077", "getConf": staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.root(Far)
    assert scratch.root(spark)
