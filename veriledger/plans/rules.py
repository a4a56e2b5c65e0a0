"""Queries of passage, caption and page rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import passages as R
from ..sources import pages as P
from . import grounded
from .base import plain, query, table, view

PASSAGES = """
SELECT o_orderkey AS id, CASE o_custkey % 4 WHEN 0 THEN 'Example of revenue' WHEN 1 THEN 'Revenue' WHEN 2 THEN 'Inventories' ELSE 'Leases' END AS title, CASE WHEN o_orderkey % 2 = 0 THEN 'standard' ELSE 'qna' END AS kind, CASE WHEN o_orderkey % 3 = 0 THEN 'K-IFRS' ELSE 'Local' END AS framework,
  CASE o_orderkey % 5 WHEN 0 THEN '12' || chr(10) || 'Cost includes freight.' || chr(10) || 'B3' || chr(10) || 'An asset is not recognised when control is lost.' WHEN 1 THEN 'At the date of initial application an entity may choose.' WHEN 2 THEN '(a) a clipped exception' WHEN 3 THEN 'Intro' || chr(10) || '7' || chr(10) || 'Transfer of control and transaction price.' ELSE 'An entity shall not recognise goods ' || CAST(o_orderkey % 3 AS STRING) END AS text,
  CASE o_orderkey % 7 WHEN 0 THEN 'give an example' WHEN 1 THEN 'what of transition' ELSE 'general rule' END AS question FROM {orders}
"""
_P = f"WITH p AS ({plain(PASSAGES)})"


def passages(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, PASSAGES, "orders")


@query(f"{_P} SELECT id, NOT ((contains(title, 'Example') AND NOT contains(question, 'example')) OR (contains(text, 'initial application') AND NOT contains(question, 'transition')) OR starts_with(text, '(a)')) AS applies FROM p")
def retrieve_applicable(spark: SparkSession, sf: str) -> DataFrame:
    """RT-16."""
    return passages(spark, sf).select("id", R.applicable(F.col("question"), F.col("title"), F.col("text")).alias("applies"))


@query(f"""{_P} SELECT id, 0 AS n, '12' AS paragraph, 'Cost includes freight.' AS text FROM p WHERE id % 5 = 0 UNION ALL SELECT id, 1, 'B3', 'An asset is not recognised when control is lost.' FROM p WHERE id % 5 = 0 UNION ALL SELECT id, 0, NULL, 'Intro' FROM p WHERE id % 5 = 3 UNION ALL SELECT id, 1, '7', 'Transfer of control and transaction price.' FROM p WHERE id % 5 = 3 UNION ALL SELECT id, 0, NULL, text FROM p WHERE id % 5 IN (1, 2, 4)""")
def retrieve_segments(spark: SparkSession, sf: str) -> DataFrame:
    """RT-20."""
    return R.segments(passages(spark, sf))


@query(f"{_P} SELECT id, contains(lower(text), 'control') AND contains(lower(text), 'transaction price') AS rule FROM p")
def retrieve_rule_passage(spark: SparkSession, sf: str) -> DataFrame:
    """RT-29."""
    return passages(spark, sf).select("id", R.holds_all(F.col("text"), ["control", "transaction price"]).alias("rule"))


@query(f"{_P} SELECT 'revenue' AS topic, min(id) AS id FROM p WHERE kind = 'standard' AND framework = 'K-IFRS' AND (contains(lower(title), 'revenue') OR contains(lower(text), 'revenue')) UNION ALL SELECT 'cost', min(id) FROM p WHERE kind = 'qna' AND framework = 'K-IFRS' AND (contains(lower(title), 'freight') OR contains(lower(text), 'freight'))")
def retrieve_principles(spark: SparkSession, sf: str) -> DataFrame:
    """RT-24."""
    topics = spark.createDataFrame([("revenue", "standard", "KIFRS", "revenue"), ("cost", "qna", "KIFRS", "freight")], "topic string, want_kind string, want_framework string, keyword string")
    return R.principles(passages(spark, sf), topics)


@query(f"{_P} SELECT min(id) AS id FROM p WHERE title = 'Revenue' AND (contains(text, 'shall not') OR contains(text, 'is not recognised')) GROUP BY regexp_replace(text, '[\\s\\x0B]+', '', 'g')")
def retrieve_exclusions(spark: SparkSession, sf: str) -> DataFrame:
    """RT-26."""
    p = passages(spark, sf)
    return R.exclusions(p.where("title = 'Revenue'").select("title"), p)


@query("""WITH w AS (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS used FROM conversations WHERE text IS NOT NULL) SELECT conv_id AS context, turn AS part, CAST(used AS BIGINT) AS used FROM w WHERE used <= 1400""")
def retrieve_context_fit(spark: SparkSession, sf: str) -> DataFrame:
    """RT-23: the turns of a conversation that fit its context."""
    d = table(spark, sf, "conversations").where("text IS NOT NULL").select(F.col("conv_id").alias("context"), F.col("turn").alias("part"), F.col("turn").alias("importance"), F.length("text").alias("size"))
    return R.fitted_context(d, 1400).select("context", "part", "used")


CARRIAGE = "SELECT o_orderkey AS doc_id, 1 AS page, n AS tid, CASE n WHEN 0 THEN 'Shipper' WHEN 1 THEN 'Consignee' WHEN 2 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'Vessel' ELSE 'Carrier' END WHEN 3 THEN 'Received in apparent good order' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'surrendered in exchange for delivery' ELSE 'notes' END END AS text FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(n)"


@query("SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 = 0")
def label_carriage_contract(spark: SparkSession, sf: str) -> DataFrame:
    """LB-07."""
    return R.contract_evidence(view(spark, sf, CARRIAGE, "orders"), ["shipper", "consignee", "vessel"], ["apparent good order", "in exchange for delivery"]).select("doc_id")


_TERMS = {"quantity": "quantity", "qty": "quantity", "netweight": "net_weight", "grossweight": "gross_weight", "description": "description"}


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'quantity,net_weight' WHEN 1 THEN 'description,quantity,gross_weight' END AS roles FROM part")
def label_tiled_captions(spark: SparkSession, sf: str) -> DataFrame:
    """LB-02, LB-08 and LB-09: one caption that names several columns."""
    text = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'Quantity / Net Weight' WHEN 1 THEN 'Description Qty Gross Weight' WHEN 2 THEN 'Quantity ordered' ELSE 'Quantity' END")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), R.tiled_caption(text, _TERMS).alias("roles"))


FREIGHT = "SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'PREPAID' ELSE 'COLLECT' END AS column, CASE WHEN l_quantity > 40 THEN CAST(l_quantity AS STRING) ELSE '-' END AS text FROM {lineitem}"


@query(f"WITH f AS ({plain(FREIGHT)}), g AS (SELECT doc_id, \"column\" AS c FROM f WHERE regexp_matches(text, '\\d') GROUP BY ALL) SELECT doc_id, min(c) AS freight_terms FROM g GROUP BY 1 HAVING count(*) = 1".replace("AS column,", 'AS "column",'))
def ground_freight_column(spark: SparkSession, sf: str) -> DataFrame:
    """GE-09."""
    return R.freight_column(view(spark, sf, FREIGHT, "lineitem"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 <> 2 THEN c_name END AS carrier FROM customer")
def ground_postfix_carrier(spark: SparkSession, sf: str) -> DataFrame:
    """GE-25."""
    text = F.concat("c_name", F.expr("CASE c_custkey % 3 WHEN 0 THEN ' (as carrier)' WHEN 1 THEN ' as the Carrier' ELSE ' (as agent)' END"))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), R.postfix_role(text).alias("carrier"))


@query(f"WITH t AS ({plain(P.TOKENS)}) SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND doc_id % 11 <> 0 THEN 'review' ELSE 'accepted' END AS status FROM t WHERE tid = 6")
def ground_declared_basis(spark: SparkSession, sf: str) -> DataFrame:
    """GE-27: the token of field 4 stands in for the basis, placed beside the value."""
    t = grounded.tokens(spark, sf)
    v = t.where("tid = 6")
    basis = v.where("doc_id % 4 = 0 AND doc_id % 11 <> 0").select("doc_id", "page", (F.col("y") + F.col("h")).alias("y"), F.lit("USD per package").alias("text"))
    return R.declared_basis(v, basis).select("doc_id", "status")


@query("SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '30% in advance|70% against documents' WHEN 1 THEN '100% at sight' ELSE '' END AS parts FROM orders")
def ground_instalments(spark: SparkSession, sf: str) -> DataFrame:
    """GE-08."""
    text = F.expr("CASE o_orderkey % 3 WHEN 0 THEN '30% in advance, 70 % against documents' WHEN 1 THEN '100% at sight' ELSE 'open account' END")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(R.instalments(text), "|").alias("parts"))


_CATALOG = [(d, f, k) for d in ("commercial_invoice", "packing_list") for f, k in (("invoice_number", "text"), ("total_amount", "number"), ("issue_date", "date"))]
_VALUES = ", ".join(str(c) for c in _CATALOG)


@query(f"WITH c(document_type, field, kind) AS (VALUES {_VALUES}) SELECT document_type, string_agg(field, '|' ORDER BY field) AS enum FROM c GROUP BY 1")
def label_response_schema(spark: SparkSession, sf: str) -> DataFrame:
    """LB-34."""
    return R.response_schema(spark.createDataFrame(_CATALOG, "document_type string, field string, kind string"))


@query(f"WITH c(document_type, field, kind) AS (VALUES {_VALUES}) SELECT document_type, field, '| ' || field || ' | ' || kind || ' |' AS line FROM c")
def eval_contract_document(spark: SparkSession, sf: str) -> DataFrame:
    """EV-25."""
    return R.contract_document(spark.createDataFrame(_CATALOG, "document_type string, field string, kind string"))
