"""Queries over forms: captions and values beside each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import forms as O
from ..sources import pages as P
from .base import plain, query, view

_T = f"WITH t AS (SELECT *, x + w AS r, y + h AS b, x + w / 2 AS cx, y + h / 2 AS cy, 18.0 AS u FROM ({plain(P.FORMS)}))"


def forms(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, P.FORMS, "orders")


_PAIRS = f"""{_T}, f AS (SELECT doc_id, page, tid AS parent, tid AS child, lower(regexp_extract(text, '(?i)^(quantity|qty) (ordered|shipped)$', 2)) AS role, cy FROM t WHERE regexp_matches(text, '(?i)^(quantity|qty) (ordered|shipped)$')
  UNION ALL SELECT a.doc_id, a.page, a.tid, min(c.tid), min(lower(c.text)), a.cy FROM t a JOIN t c ON c.doc_id = a.doc_id AND lower(a.text) IN ('quantity', 'qty') AND lower(c.text) IN ('ordered', 'shipped') AND c.y > a.y AND c.y - a.y < 1.8 * 18 AND abs(c.cx - a.cx) < 18 GROUP BY a.doc_id, a.page, a.tid, a.cy HAVING count(*) = 1),
paired AS (SELECT DISTINCT f.doc_id, f.page, f.parent, f.child, f.role FROM f JOIN f g ON g.doc_id = f.doc_id AND g.role <> f.role AND abs(g.cy - f.cy) < 18)"""


@query(f"{_PAIRS} SELECT * FROM paired")
def label_quantity_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """LB-10."""
    return O.quantity_qualifiers(forms(spark, sf))


_PACK = """pack AS (SELECT doc_id, page, tid FROM t c WHERE tid = 20 AND doc_id % 4 IN (0, 3) AND EXISTS (SELECT 1 FROM t p WHERE p.doc_id = c.doc_id AND p.text = 'Marks' AND abs(p.cy - c.cy) < 21.6)
  AND EXISTS (SELECT 1 FROM t p WHERE p.doc_id = c.doc_id AND p.text = 'Gross Weight' AND abs(p.cy - c.cy) < 21.6) AND EXISTS (SELECT 1 FROM t v WHERE v.doc_id = c.doc_id AND regexp_full_match(v.text, '[0-9]+ CTNS') AND v.y > c.b AND v.y - c.b < 144 AND greatest(v.x, c.x) < least(v.r, c.r)))"""


@query(f"{_T}, {_PACK} SELECT * FROM pack")
def label_package_captions(spark: SparkSession, sf: str) -> DataFrame:
    """LB-11."""
    return O.package_captions(forms(spark, sf), P.FORM_VOCABULARY)


@query("SELECT o_orderkey AS doc_id, 0 AS evidence FROM orders WHERE o_orderkey % 5 IN (0, 3) AND o_orderkey % 10 <> 3")
def label_terms_only(spark: SparkSession, sf: str) -> DataFrame:
    """LB-13."""
    return O.terms_only(forms(spark, sf))


@query(f"{_T} SELECT doc_id, page, tid FROM t a WHERE text = 'Unit' AND NOT EXISTS (SELECT 1 FROM t d WHERE d.doc_id = a.doc_id AND d.text IN ('Description', 'Quantity', 'Qty') AND abs(d.y - a.y) < 27) AND EXISTS (SELECT 1 FROM t v WHERE v.doc_id = a.doc_id AND regexp_matches(v.text, '[0-9]') AND regexp_matches(v.text, '(PCS|CTNS|KG|CBM)') AND v.y > a.b AND v.y - a.b < 144 AND greatest(v.x, a.x) < least(v.r, a.r))")
def label_repair_bands(spark: SparkSession, sf: str) -> DataFrame:
    """LB-30."""
    return O.repair_bands(forms(spark, sf), P.FORM_VOCABULARY)


#: What a model might answer: right quotes, values that are not there, values that stand there twice, captions that stand there twice.
ANSWERED = "SELECT o_orderkey AS doc_id, 40 AS tid, CASE WHEN o_orderkey % 4 = 2 THEN 'consignee' ELSE 'shipper' END AS field, CASE WHEN o_orderkey % 4 = 2 THEN 'Consignee' ELSE 'shipper' END AS label, CASE o_orderkey % 4 WHEN 2 THEN CASE WHEN o_orderkey % 8 = 2 THEN 'BETA' ELSE 'BETA ' || CAST(o_orderkey AS STRING) END ELSE CASE WHEN o_orderkey % 12 = 0 THEN 'NOWHERE' ELSE 'ACME' END END AS value FROM {orders}"


@query(f"""{_T}, a AS ({plain(ANSWERED)}), c AS (SELECT doc_id, tid, text FROM t WHERE tid = 40 AND doc_id % 4 IN (0, 2)), j AS (SELECT c.*, field, label, value FROM c JOIN a USING (doc_id, tid))
SELECT doc_id, tid, field, strpos(lower(text), lower(label)) - 1 AS label_start, strpos(lower(text), lower(label)) - 1 + length(label) AS label_end, strpos(text, value) - 1 AS value_start, strpos(text, value) - 1 + length(value) AS value_end
FROM j WHERE (length(text) - length(replace(text, value, ''))) = length(value)""")
def label_inline_spans(spark: SparkSession, sf: str) -> DataFrame:
    """LB-31: only quotes that stand in the token, the value once and behind its caption."""
    return O.inline_spans(O.inline_candidates(forms(spark, sf)), view(spark, sf, ANSWERED, "orders"))


@query(f"""{_T}, n AS (SELECT a.doc_id, a.page, a.tid AS title, min(b.text) AS text FROM t a JOIN t b ON b.doc_id = a.doc_id AND a.tid IN (0, 1) AND starts_with(b.text, '# ') AND abs(b.cy - a.cy) < 18 AND b.x - a.r >= -9 AND b.x - a.r < 72
  WHERE regexp_full_match(lower(a.text), '(bill of lading|commercial invoice|packing list)( - terms and conditions|: terms & conditions)?') GROUP BY a.doc_id, a.page, a.tid HAVING count(*) = 1) SELECT doc_id, page, title, substr(text, 3) AS value FROM n""")
def label_title_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """LB-32."""
    return O.title_numbers(forms(spark, sf))


@query(f"""{_PAIRS}, {_PACK}, voc(k, field) AS (VALUES ('quantity', 'quantity'), ('qty', 'quantity'), ('marks', 'marks'), ('gross weight', 'gross_weight'), ('description', 'description'), ('unit', 'unit'))
SELECT doc_id, page, tid, field, 'vocabulary' AS method FROM t JOIN voc ON lower(text) = k UNION ALL SELECT doc_id, page, tid, 'package_count', 'package_caption' FROM pack UNION ALL SELECT doc_id, page, child, 'quantity_' || role, 'paired_quantity' FROM paired""")
def label_structural(spark: SparkSession, sf: str) -> DataFrame:
    """LB-35: every label that needs no model."""
    return O.structural_labels(forms(spark, sf), P.FORM_VOCABULARY)


LITERALS = "SELECT p_partkey AS id, CASE p_partkey % 11 WHEN 0 THEN 'V. 012E' WHEN 1 THEN 'Voyage No. 44/2' WHEN 2 THEN 'Victory 9' WHEN 3 THEN CAST(p_partkey AS STRING) || ' KGS (24 cartons x 50 kgs each)' WHEN 4 THEN CAST(p_partkey AS STRING) || ' KGS (24 cartons x 50 lbs)' WHEN 5 THEN '3.5 CBM (2 boxes x 1.75 cbm)' WHEN 6 THEN '2025-03-04 shipped' WHEN 7 THEN '2025-03-04 to 2025-04-01' WHEN 8 THEN '2025-13-04 shipped' WHEN 9 THEN '2025-03-04 by 2025/04/01' ELSE p_name END AS text FROM {part}"


@query(f"""WITH l AS ({plain(LITERALS)}) SELECT id, id % 11 IN (0, 1) AS voyage, CASE WHEN id % 11 = 3 THEN CAST(id AS VARCHAR) || ' KGS' WHEN id % 11 = 5 THEN '3.5 CBM' END AS measure, CASE WHEN id % 11 = 6 THEN '2025-03-04' END AS day FROM l""")
def label_literals(spark: SparkSession, sf: str) -> DataFrame:
    """LB-36."""
    text = F.col("text")
    return view(spark, sf, LITERALS, "part").select("id", O.is_voyage(text).alias("voyage"), O.explained_measure(text).alias("measure"), O.date_prefix(text).alias("day"))


#: Cells found for a caption: values over two lines, out of reading order, of the wrong kind, of another kind.
CELLS = """
SELECT o_orderkey AS doc_id, field, kind, label, tid, CASE WHEN text = '@' THEN CAST(1 + o_orderkey % 50 AS STRING) ELSE text END AS text, x, cy, 18.0 AS unit
FROM {orders} JOIN (VALUES
  (0, 'gross_weight', 'number', 'Gross Weight', 1, '12.', 20.0, 100.0), (0, 'gross_weight', 'number', 'Gross Weight', 2, '50', 20.0, 120.0), (1, 'hs_code', 'text', 'HS Code', 1, '8481.80', 20.0, 100.0), (1, 'hs_code', 'text', 'HS Code', 2, '9900', 20.0, 120.0),
  (2, 'description', 'text', 'Description', 1, 'hinge', 90.0, 101.0), (2, 'description', 'text', 'Description', 2, 'Brass', 20.0, 100.0), (2, 'description', 'text', 'Description', 3, 'polished', 20.0, 120.0), (3, 'quantity', 'number', 'Quantity', 1, '@', 20.0, 100.0),
  (4, 'quantity', 'number', 'Quantity', 1, '5 / 7', 20.0, 100.0), (5, 'quantity', 'number', 'Quantity', 1, 'none', 20.0, 100.0), (6, 'gross_weight', 'number', 'Weight', 1, '@', 20.0, 100.0), (7, 'gross_weight', 'number', 'Weight (KG)', 1, '@', 20.0, 100.0),
  (8, 'buyer_reference', 'text', 'Reference', 1, 'Our ref: 55', 20.0, 100.0), (9, 'description', 'text', 'Description', 1, 'Contract No.:', 20.0, 100.0), (10, 'mode_of_transport', 'text', 'Mode', 1, 'FOB BUSAN', 20.0, 100.0), (11, 'mode_of_transport', 'text', 'Delivery', 1, 'SEA', 20.0, 100.0),
  (12, 'port_of_loading', 'text', 'Port', 1, '1,200', 20.0, 100.0), (13, 'port_of_loading', 'text', 'Port', 1, '$ 300', 20.0, 100.0), (14, 'port_of_loading', 'text', 'Port', 1, 'Ocean Freight', 20.0, 100.0), (15, 'port_of_loading', 'text', 'Port', 1, 'FREIGHT PREPAID', 20.0, 100.0),
  (16, 'port_of_loading', 'text', 'Port', 1, 'CIF', 20.0, 100.0), (17, 'port_of_loading', 'text', 'Port', 1, 'CY/CFS', 20.0, 100.0), (18, 'port_of_loading', 'text', 'Port', 1, 'BUSAN', 20.0, 100.0)) AS c(m, field, kind, label, tid, text, x, cy) ON o_orderkey % 19 = c.m
"""
_REASONS = "(4, 'multiple_values_in_scalar_cell'), (5, 'value_type_not_resolved'), (6, 'unverified_measure_label_without_unit'), (8, 'nested_reference_caption_is_not_reference_value'), (9, 'document_metadata_is_not_goods_description'), (10, 'trade_term_is_not_transport_mode'), (11, 'delivery_caption_does_not_establish_transport_mode'), (12, 'numeric_value_is_not_named_location'), (13, 'monetary_amount_is_not_named_location'), (14, 'freight_charge_category_is_not_named_location'), (15, 'freight_payment_option_is_not_named_location'), (16, 'trade_term_is_not_named_location'), (17, 'service_mode_is_not_named_location')"


@query(f"""WITH c AS ({plain(CELLS)}), k AS (SELECT o_orderkey AS doc_id, o_orderkey % 19 AS m FROM orders), r(m, reason) AS (VALUES {_REASONS}),
g AS (SELECT c.doc_id, m, field, string_agg(text, '' ORDER BY tid) AS joined, string_agg(text, ' ' ORDER BY CASE WHEN m = 2 THEN [2, 1, 3][CAST(tid AS BIGINT)] ELSE tid END) AS text FROM c JOIN k USING (doc_id) GROUP BY ALL)
SELECT doc_id, field, CASE m WHEN 0 THEN 'wrapped_decimal' WHEN 1 THEN 'wrapped_identifier' ELSE 'layout' END AS method, CASE WHEN m IN (0, 1) THEN joined ELSE text END AS text, reason FROM g LEFT JOIN r USING (m)""")
def ground_selections(spark: SparkSession, sf: str) -> DataFrame:
    """GE-04: reading order, wrapped values, and reasons to withhold."""
    return O.selections(view(spark, sf, CELLS, "orders"))


@query(f"""{_T} SELECT a.doc_id, a.page, CASE a.doc_id % 4 WHEN 1 THEN 'port_of_discharge' ELSE 'port_of_loading' END AS field, a.tid AS "first", b.tid AS second, 'BUSAN ' || a.doc_id % 9 AS value
FROM t a JOIN t b ON b.doc_id = a.doc_id AND a.tid = 50 AND b.tid = 51 WHERE abs(b.x - a.x) < 18 AND a.doc_id % 4 IN (0, 1) AND a.doc_id % 5 <> 0""")
def ground_fragmented_headers(spark: SparkSession, sf: str) -> DataFrame:
    """GE-06."""
    terms = spark.createDataFrame(list(P.TERMS.items()), "field string, term string")
    return O.fragmented_headers(forms(spark, sf), terms)


@query(f"""{_T}, v AS (SELECT a.doc_id, a.page, a.tid AS total, c.tid, c.text FROM t a JOIN t c ON c.doc_id = a.doc_id AND a.tid = 61 AND c.tid IN (62, 63) WHERE a.y > (SELECT max(g.b) FROM t g WHERE g.doc_id = a.doc_id AND g.tid = 60) + 18 AND c.y - a.b >= 0 AND c.y - a.b < 54 AND abs(c.x - (a.x + a.w * 20 / length(a.text))) <= 54)
SELECT doc_id, page, total, split_part(arg_min(text, tid), ' ', 1) AS volume, upper(split_part(arg_min(text, tid), ' ', 2)) AS volume_unit, count(*) > 1 AS ambiguous FROM v GROUP BY doc_id, page, total""")
def ground_footer_volumes(spark: SparkSession, sf: str) -> DataFrame:
    """GE-07."""
    t = forms(spark, sf)
    return O.footer_volumes(t, t.where("tid = 60"))


@query("SELECT o_orderkey AS doc_id, 'weight' AS label, 'kg' AS unit FROM orders WHERE o_orderkey % 3 = 0")
def ground_shared_units(spark: SparkSession, sf: str) -> DataFrame:
    """GE-10: a unit parted over two tokens; two units are none."""
    return O.shared_units(forms(spark, sf).where("tid IN (80, 81)").withColumn("label", F.lit("weight")))
