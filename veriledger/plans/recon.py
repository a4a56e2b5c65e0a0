"""Reconciliation and review queries over the trade document views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reconcile as R
from ..operators import review as V
from ..sources import trade
from .base import plain, query, view

# ---- sources ----------------------------------------------------------------------------


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, trade.LEDGER, "orders")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, trade.DOCUMENTS, "orders")


def incoming(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, trade.INCOMING, "orders")


def dealt(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ledger, documents and items with the tables under them dealt out by transaction: a few numbers a row are moved, and not the texts that the views make of them."""
    return tuple(view(spark, sf, sql, t, by=k) for sql, t, k in ((trade.LEDGER, "orders", "o_orderkey"), (trade.DOCUMENTS, "orders", "o_orderkey"), (trade.ITEMS, "lineitem", "l_orderkey")))


def checks(spark: SparkSession, sf: str) -> DataFrame:
    return R.checks(*dealt(spark, sf)[:2])


def document_checks(spark: SparkSession, sf: str, alike: bool = False) -> DataFrame:
    """Comparisons of documents and presence checks."""
    return R.checks(*dealt(spark, sf)[:2], trade.DOCUMENT_TYPES, alike=alike)


def item_checks(spark: SparkSession, sf: str) -> DataFrame:
    _, documents, items = dealt(spark, sf)
    return R.item_checks(items, documents)


def all_checks(spark: SparkSession, sf: str) -> DataFrame:
    return document_checks(spark, sf).unionByName(item_checks(spark, sf))


def ruled(spark: SparkSession, sf: str) -> DataFrame:
    return V.with_rule_status(all_checks(spark, sf))


# ---- the same sources for DuckDB ----------------------------------------------------------


def _unpivot(fields: list[str]) -> str:
    return "unnest([" + ", ".join(f"{{'field': '{f}', 'value': CAST({f} AS VARCHAR)}}" for f in fields) + "], recursive := true)"


_NUM = lambda c: f"try_cast({c} AS DECIMAL(38,9))"
_SAME = f"CASE WHEN {_NUM('lv')} IS NOT NULL AND {_NUM('rv')} IS NOT NULL THEN {_NUM('lv')} = {_NUM('rv')} ELSE lv = rv END"
_PAIR = lambda of: f"CASE f {' '.join(f'WHEN {m!r} THEN {of}_{m}' for m in trade.ITEM_FIELDS)} END"

#: Rules and areas stand here in full, apart from the operators' own lists, so that a wrong one shows.
SOURCES = f"""
ledger AS ({plain(trade.LEDGER)}), docs AS ({plain(trade.DOCUMENTS)}),
cells AS (SELECT tx, document_type, extraction_status AS st, {_unpivot(trade.DOCUMENT_FIELDS)} FROM docs
  UNION ALL SELECT tx, 'ledger', 'accepted', {_unpivot(trade.LEDGER_FIELDS)} FROM ledger),
kinds(o, a, b) AS (VALUES (1, 'commercial_invoice', 'packing_list'), (2, 'commercial_invoice', 'bill_of_lading'), (3, 'packing_list', 'bill_of_lading')),
rules(rule_no, type, event, left_doc, left_field, right_doc, right_field, lu, ru) AS (
  VALUES (1, 'ledger_invoice_amount_comparison', '', 'ledger', 'amount', 'commercial_invoice', 'total_amount', 'currency', 'currency'), (2, 'ledger_invoice_currency_comparison', '', 'ledger', 'currency', 'commercial_invoice', 'currency', '', ''),
    (3, 'ledger_invoice_counterparty_comparison', 'buyer', 'ledger', 'counterparty', 'commercial_invoice', 'buyer', '', ''), (4, 'ledger_invoice_counterparty_comparison', 'seller', 'ledger', 'counterparty', 'commercial_invoice', 'seller', '', ''),
    (5, 'invoice_transaction_date_review', '', 'ledger', 'transaction_date', 'commercial_invoice', 'issue_date', '', ''), (6, 'invoice_posting_date_review', '', 'ledger', 'posting_date', 'commercial_invoice', 'issue_date', '', ''),
    (7, 'document_gross_weight_comparison', '', 'packing_list', 'gross_weight', 'bill_of_lading', 'gross_weight', 'gross_weight_unit', 'gross_weight_unit'), (8, 'document_net_weight_comparison', '', 'packing_list', 'net_weight', 'bill_of_lading', 'net_weight', 'net_weight_unit', 'net_weight_unit'),
    (9, 'document_package_count_comparison', '', 'packing_list', 'total_packages', 'bill_of_lading', 'total_packages', '', '')
  UNION ALL SELECT 6 + 3 * e.o + k.o, 'cross_document_date_review', e.f, a, e.f, b, e.f, '', '' FROM (VALUES (1, 'shipment_date'), (2, 'on_board_date'), (3, 'departure_date')) AS e(o, f), kinds k
  UNION ALL SELECT 15 + 3 * e.o + k.o, 'reference_' || e.f, '', a, e.f, b, e.f, '', '' FROM (VALUES (1, 'invoice_number'), (2, 'bill_of_lading_number'), (3, 'purchase_order_number'), (4, 'packing_list_number'), (5, 'buyer_reference'), (6, 'document_reference'), (7, 'booking_number')) AS e(o, f), kinds k),
pairs AS (SELECT r.*, 'T' || l.tx AS transaction_id, 'T' || l.tx || ':' || rule_no AS check_id, l.value AS lv, rr.value AS rv, lu_.value AS luv, ru_.value AS ruv, l.st = 'review' OR rr.st = 'review' AS has_review
  FROM rules r JOIN cells l ON l.document_type = left_doc AND l.field = left_field JOIN cells rr ON rr.tx = l.tx AND rr.document_type = right_doc AND rr.field = right_field
  LEFT JOIN cells lu_ ON lu_.tx = l.tx AND lu_.document_type = left_doc AND lu_.field = r.lu LEFT JOIN cells ru_ ON ru_.tx = l.tx AND ru_.document_type = right_doc AND ru_.field = r.ru
  JOIN ledger g ON g.tx = l.tx WHERE r.event NOT IN ('buyer', 'seller') OR g.counterparty_role = r.event),
checks AS (SELECT transaction_id, check_id, lpad(CAST(rule_no AS VARCHAR), 4, '0') AS ord, type, CASE WHEN event IN ('buyer', 'seller') THEN '' ELSE event END AS event, left_doc, left_field, lv AS left_value, right_doc, right_field, rv AS right_value, luv AS left_unit, ruv AS right_unit,
  CASE WHEN has_review THEN 'review' WHEN lv IS NULL OR rv IS NULL OR (lu <> '' AND NOT coalesce(luv = ruv, FALSE)) THEN 'cannot_evaluate' WHEN {_SAME} THEN 'pass' ELSE 'flag' END AS status,
  CASE WHEN has_review THEN 'uncertain_extraction' WHEN lv IS NULL OR rv IS NULL THEN 'required_value_missing' WHEN lu <> '' AND NOT coalesce(luv = ruv, FALSE) THEN 'value_or_unit_missing' WHEN {_SAME} THEN NULL ELSE 'different_values' END AS reason, has_review FROM pairs),
presence AS (SELECT g.transaction_id, k.dt AS document_type, 'document_presence' AS type, CASE WHEN x.entity_id IS NULL THEN 'cannot_evaluate' ELSE 'pass' END AS status, CASE WHEN x.entity_id IS NULL THEN 'required_document_not_linked' END AS reason
  FROM ledger g CROSS JOIN (VALUES ('commercial_invoice'), ('packing_list'), ('bill_of_lading')) AS k(dt) LEFT JOIN docs x ON x.transaction_id = g.transaction_id AND x.document_type = k.dt),
items AS ({plain(trade.ITEMS)}),
told AS (SELECT *, lower(trim(description)) AS told FROM items),
keyed AS (SELECT *, coalesce(product_code, CASE WHEN min(product_code) OVER w = max(product_code) OVER w THEN min(product_code) OVER w END, 'd:' || told, 'd:') AS line FROM told WINDOW w AS (PARTITION BY transaction_id, told)),
line_sides AS (SELECT transaction_id, line, document_type, count(*) AS n, {', '.join(f'min({m}) AS {m}' for m in trade.ITEM_FIELDS)} FROM keyed GROUP BY ALL),
item_pairs AS (SELECT k.n, a, b, x.transaction_id, (x.transaction_id, a) IN (SELECT (transaction_id, document_type) FROM items) AND (x.transaction_id, b) IN (SELECT (transaction_id, document_type) FROM items) AS ok
  FROM (VALUES (0, 'commercial_invoice', 'packing_list'), (1, 'packing_list', 'bill_of_lading')) AS k(n, a, b) JOIN docs x ON x.document_type = a JOIN docs y ON y.document_type = b AND y.transaction_id = x.transaction_id),
met AS (SELECT p.transaction_id, p.n, a, b, c.line, coalesce(l.n = 1 AND r.n = 1, FALSE) AS matched, {', '.join(f'l.{m} AS l_{m}, r.{m} AS r_{m}' for m in trade.ITEM_FIELDS)}
  FROM item_pairs p JOIN (SELECT DISTINCT transaction_id, line FROM line_sides) c USING (transaction_id) LEFT JOIN line_sides l ON l.transaction_id = p.transaction_id AND l.line = c.line AND l.document_type = a
  LEFT JOIN line_sides r ON r.transaction_id = p.transaction_id AND r.line = c.line AND r.document_type = b WHERE ok AND (l.n IS NOT NULL OR r.n IS NOT NULL)),
measured AS (SELECT met.*, m, f, {_PAIR('l')} AS left_value, {_PAIR('r')} AS right_value, CASE WHEN f = 'description' THEN lower(trim(l_description)) ELSE {_PAIR('l')} END AS lv, CASE WHEN f = 'description' THEN lower(trim(r_description)) ELSE {_PAIR('r')} END AS rv,
    f = 'quantity' AND NOT coalesce(l_unit = r_unit, FALSE) AS no_unit
  FROM met, (VALUES (1, 'product_code'), (2, 'description'), (3, 'unit'), (4, 'quantity'), (5, 'package_count'), (6, 'gross_weight'), (7, 'net_weight')) AS v(m, f) WHERE matched),
item_checks AS (
  SELECT transaction_id, transaction_id || ':i' || n || ':' || line || ':' || m AS check_id, '2000:' || line || ':' || n || ':' || m AS ord, 'item_' || f || '_comparison' AS type, '' AS event, line AS item, a AS left_doc, f AS left_field, left_value, b AS right_doc, f AS right_field, right_value,
    CASE WHEN f = 'quantity' THEN l_unit END AS left_unit, CASE WHEN f = 'quantity' THEN r_unit END AS right_unit, CASE WHEN lv IS NULL OR rv IS NULL OR no_unit THEN 'cannot_evaluate' WHEN {_SAME} THEN 'pass' ELSE 'flag' END AS status,
    CASE WHEN lv IS NULL OR rv IS NULL THEN 'required_value_missing' WHEN no_unit THEN 'value_or_unit_missing' WHEN {_SAME} THEN NULL ELSE 'different_values' END AS reason, FALSE AS has_review FROM measured
  UNION ALL BY NAME SELECT transaction_id, transaction_id || ':i' || n || ':' || line || ':0' AS check_id, '2000:' || line || ':' || n || ':0' AS ord, 'unmatched_item' AS type, '' AS event, line AS item, a AS left_doc, b AS right_doc, 'review' AS status, 'no_counterpart' AS reason, FALSE AS has_review FROM met WHERE NOT matched
  UNION ALL BY NAME SELECT transaction_id, transaction_id || ':i' || n AS check_id, '1500:' || n AS ord, 'item_table_unavailable' AS type, '' AS event, a AS left_doc, b AS right_doc, 'cannot_evaluate' AS status, 'item_table_unavailable' AS reason, FALSE AS has_review FROM item_pairs WHERE NOT ok),
all_checks AS (SELECT * FROM checks UNION ALL BY NAME SELECT transaction_id, transaction_id || ':' || document_type AS check_id, '1000:' || document_type AS ord, type, document_type AS event, status, reason, FALSE AS has_review FROM presence UNION ALL BY NAME SELECT * FROM item_checks),
areas_of(type, area) AS (VALUES ('document_presence', 'documents'), ('ledger_invoice_amount_comparison', 'amount'), ('ledger_invoice_currency_comparison', 'amount'), ('ledger_invoice_counterparty_comparison', 'counterparty'), ('invoice_transaction_date_review', 'date'), ('invoice_posting_date_review', 'date'),
  ('cross_document_date_review', 'shipping'), ('document_gross_weight_comparison', 'logistics'), ('document_net_weight_comparison', 'logistics'), ('document_package_count_comparison', 'logistics'), ('item_table_unavailable', 'items'), ('unmatched_item', 'items'),
  ('reference_invoice_number', 'references'), ('reference_bill_of_lading_number', 'references'), ('reference_purchase_order_number', 'references'), ('reference_packing_list_number', 'references'), ('reference_buyer_reference', 'references'), ('reference_document_reference', 'references'), ('reference_booking_number', 'references'),
  ('item_product_code_comparison', 'items'), ('item_description_comparison', 'items'), ('item_unit_comparison', 'items'), ('item_quantity_comparison', 'items'), ('item_package_count_comparison', 'items'), ('item_gross_weight_comparison', 'items'), ('item_net_weight_comparison', 'items')),
scoped AS (SELECT c.*, coalesce(area, 'unmapped') AS area, CASE WHEN status = 'cannot_evaluate' AND reason IN ('required_value_missing', 'value_or_unit_missing') AND NOT has_review AND (
    (bool_or(status = 'pass' AND starts_with(type, 'reference_')) OVER (PARTITION BY transaction_id) AND type IN ('reference_packing_list_number', 'reference_buyer_reference', 'reference_document_reference', 'reference_booking_number'))
    OR (type = 'cross_document_date_review' AND left_value IS NULL AND right_value IS NULL)
    OR (type = 'cross_document_date_review' AND event = 'on_board_date' AND (left_value IS NULL OR right_value IS NULL) AND (left_value IS NOT NULL OR left_doc <> 'bill_of_lading') AND (right_value IS NOT NULL OR right_doc <> 'bill_of_lading'))
    OR (type IN ('item_gross_weight_comparison', 'item_net_weight_comparison', 'item_package_count_comparison') AND (left_value IS NULL OR left_doc = 'commercial_invoice' AND left_value IS NULL) AND (right_value IS NULL OR left_doc = 'commercial_invoice'))
  ) THEN 'supplementary' ELSE 'required' END AS scope FROM all_checks c LEFT JOIN areas_of USING (type)),
ruled AS (SELECT *, CASE WHEN reason = 'required_document_not_linked' THEN 'MISSING' WHEN scope = 'supplementary' THEN 'NOT_APPLICABLE' WHEN area = 'unmapped' THEN 'REVIEW'
  ELSE CASE status WHEN 'pass' THEN 'PASS' WHEN 'flag' THEN 'FAIL' WHEN 'cannot_evaluate' THEN 'MISSING' ELSE 'REVIEW' END END AS rule_status FROM scoped),
ranks(rule_status, rk) AS (VALUES ('NOT_APPLICABLE', 0), ('PASS', 1), ('REVIEW', 2), ('MISSING', 3), ('FAIL', 4)),
area_rows AS (SELECT transaction_id, area, ['NOT_APPLICABLE', 'PASS', 'REVIEW', 'MISSING', 'FAIL'][max(rk) + 1] AS status, count(*) FILTER (rule_status <> 'NOT_APPLICABLE') AS n_checks
  FROM ruled JOIN ranks USING (rule_status) GROUP BY ALL HAVING max(rk) > 0)
"""
WITH = "WITH " + SOURCES

# ---- reconciliation -----------------------------------------------------------------------


@query("""
WITH led AS (SELECT o_orderkey AS tx, CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS amount FROM orders),
inv AS (SELECT o_orderkey AS tx, CASE WHEN o_orderkey % 23 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) + 100 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS total FROM orders WHERE o_orderkey % 31 <> 0)
SELECT CASE WHEN inv.tx IS NULL THEN 'MISSING_DOCUMENT' WHEN amount IS NULL OR total IS NULL THEN 'MISSING' WHEN o_currency <> 'USD' THEN 'MISSING' WHEN amount = total THEN 'PASS' ELSE 'FAIL' END AS outcome, count(*) AS n_transactions,
  CAST(coalesce(sum(CASE WHEN o_currency = 'USD' THEN abs(amount - total) END), 0) AS DOUBLE) AS total_difference
FROM (SELECT *, CASE WHEN tx % 47 = 0 THEN 'EUR' ELSE 'USD' END AS o_currency FROM led) AS l LEFT JOIN inv ON inv.tx = l.tx GROUP BY 1
""")
def recon_amount(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: is each ledger amount supported by its invoice (RC-05)."""
    led = ledger(spark, sf).select("tx", "amount", F.col("currency").alias("unit"))
    inv = documents(spark, sf).where("document_type = 'commercial_invoice'").select("tx", "total_amount", "currency")
    x, y = F.col("amount").cast("decimal(18,2)"), F.col("total_amount").cast("decimal(18,2)")
    known = F.col("unit") == F.col("currency")
    outcome = F.when(F.col("currency").isNull(), "MISSING_DOCUMENT").when(x.isNull() | y.isNull() | ~known, "MISSING").when(x == y, "PASS").otherwise("FAIL")
    joined = led.join(inv, "tx", "left").select(outcome.alias("outcome"), F.when(known, F.abs(x - y)).alias("d"))
    return joined.groupBy("outcome").agg(F.count("*").alias("n_transactions"), F.coalesce(F.sum("d"), F.lit(0)).cast("double").alias("total_difference"))


_LINKS = f"""WITH ledger AS ({plain(trade.LEDGER)}), incoming AS ({plain(trade.INCOMING)}),
l AS (SELECT transaction_id, 'invoice_number' AS rt, invoice_number AS ref FROM ledger UNION ALL SELECT transaction_id, 'purchase_order_number', purchase_order_number FROM ledger),
d AS (SELECT entity_id, document_type, 'invoice_number' AS rt, invoice_number AS ref FROM incoming UNION ALL SELECT entity_id, document_type, 'purchase_order_number', purchase_order_number FROM incoming),
p AS (SELECT entity_id, document_type, transaction_id, count(*) AS n_references FROM l JOIN d USING (rt, ref) GROUP BY ALL),
links AS (SELECT * FROM p WHERE entity_id IN (SELECT entity_id FROM p GROUP BY entity_id HAVING count(*) = 1)
  AND (transaction_id, document_type) IN (SELECT (transaction_id, document_type) FROM p GROUP BY transaction_id, document_type HAVING count(*) = 1))"""


@query(f"{_LINKS} SELECT transaction_id, document_type, entity_id, n_references FROM links")
def recon_links(spark: SparkSession, sf: str) -> DataFrame:
    """RC-02: incoming documents by their references."""
    return R.links(ledger(spark, sf), incoming(spark, sf))


@query(f"{_LINKS} SELECT document_type, count(*) AS n FROM incoming WHERE entity_id NOT IN (SELECT entity_id FROM links) GROUP BY 1")
def recon_unmatched_documents(spark: SparkSession, sf: str) -> DataFrame:
    """RC-02: documents that name no transaction, or two, or one that has another document of their type."""
    docs = incoming(spark, sf)
    return R.unmatched_documents(docs, R.links(ledger(spark, sf), docs)).groupBy("document_type").agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT transaction_id, document_type, type, status, reason FROM presence")
def recon_presence(spark: SparkSession, sf: str) -> DataFrame:
    """RC-04."""
    return R.presence_checks(document_checks(spark, sf))


@query(f"{WITH} SELECT transaction_id, check_id, type, event, left_value, right_value, status, reason FROM checks")
def recon_checks(spark: SparkSession, sf: str) -> DataFrame:
    """RC-05 to RC-11 and RC-14: every comparison of every transaction."""
    return checks(spark, sf).select("transaction_id", "check_id", "type", "event", "left_value", "right_value", "status", "reason")


@query(f"{WITH} SELECT type, status, coalesce(reason, '') AS reason, count(*) AS n FROM checks GROUP BY ALL")
def recon_check_counts(spark: SparkSession, sf: str) -> DataFrame:
    return checks(spark, sf).groupBy("type", "status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{WITH} SELECT transaction_id, check_id, type, item, left_doc, left_value, right_doc, right_value, status, reason FROM item_checks")
def recon_item_checks(spark: SparkSession, sf: str) -> DataFrame:
    """RC-12 and RC-13: lines matched by product code or description, seven measures, leftovers on either side, documents without lines."""
    return item_checks(spark, sf).select("transaction_id", "check_id", "type", "item", "left_doc", "left_value", "right_doc", "right_value", "status", "reason")


@query(f"{WITH} SELECT regexp_replace(type, '_(comparison|review)$', '') || CASE status WHEN 'flag' THEN '_mismatch' WHEN 'review' THEN '_uncertain' ELSE '_incomplete' END AS audit_point, count(*) AS n FROM all_checks WHERE status <> 'pass' GROUP BY 1")
def recon_audit_points(spark: SparkSession, sf: str) -> DataFrame:
    """RC-15."""
    return R.audit_points(all_checks(spark, sf)).groupBy("audit_point").agg(F.count("*").alias("n"))


@query(f"""{WITH}, d AS (SELECT transaction_id, left_unit AS unit, CAST(left_value AS DECIMAL(20,2)) - CAST(right_value AS DECIMAL(20,2)) AS x FROM checks WHERE type = 'ledger_invoice_amount_comparison' AND left_unit = right_unit AND left_value IS NOT NULL AND right_value IS NOT NULL)
SELECT transaction_id, CAST(x AS DOUBLE) AS difference, CASE WHEN x > 0 THEN 'ledger_larger' WHEN x < 0 THEN 'ledger_smaller' ELSE 'equal' END AS direction, unit FROM d""")
def recon_amount_direction(spark: SparkSession, sf: str) -> DataFrame:
    """RV-24."""
    return R.amount_difference(checks(spark, sf))


# ---- review -------------------------------------------------------------------------------


@query(f"{WITH} SELECT transaction_id, check_id, type, scope, rule_status FROM ruled")
def review_rule_status(spark: SparkSession, sf: str) -> DataFrame:
    """RV-04 and RV-06."""
    return ruled(spark, sf).select("transaction_id", "check_id", "type", "scope", "rule_status")


@query(f"""{WITH} SELECT transaction_id, count(*) FILTER (scope = 'supplementary') AS n_supplementary, count(*) FILTER (scope <> 'supplementary' AND status = 'cannot_evaluate') AS n_required_missing FROM scoped GROUP BY 1""")
def review_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """RV-05."""
    extra = F.col("scope") == "supplementary"
    return V.with_scope(all_checks(spark, sf)).groupBy("transaction_id").agg(F.count(F.when(extra, 1)).alias("n_supplementary"), F.count(F.when(~extra & (F.col("status") == "cannot_evaluate"), 1)).alias("n_required_missing"))


@query(f"""{WITH}, g AS (SELECT transaction_id, area, type, event, max(rk) AS rk, list({{'c': check_id, 'l': left_value, 'r': right_value}} ORDER BY ord, check_id) AS rows_ FROM ruled JOIN ranks USING (rule_status) WHERE area <> 'unmapped' GROUP BY ALL)
SELECT transaction_id, area, type || ':' || event AS group_id, ['NOT_APPLICABLE', 'PASS', 'REVIEW', 'MISSING', 'FAIL'][rk + 1] AS status, CAST(len(rows_) AS INTEGER) AS n_checks, array_to_string([x.c for x in rows_], ',') AS check_ids,
  array_to_string(list_filter([v for v in flatten([[x.l, x.r] for x in rows_])], lambda v, i: v IS NOT NULL AND list_position(flatten([[x.l, x.r] for x in rows_]), v) = i), '|') AS "values" FROM g""")
def review_groups(spark: SparkSession, sf: str) -> DataFrame:
    """RV-08: distinct values in the order in which checks show them."""
    return V.groups(ruled(spark, sf))


@query(f"{WITH} SELECT transaction_id, area, status, n_checks FROM area_rows")
def review_areas(spark: SparkSession, sf: str) -> DataFrame:
    """RV-07 and RV-09."""
    return V.areas(ruled(spark, sf))


@query(f"""{WITH} SELECT transaction_id, ['NOT_APPLICABLE', 'PASS', 'REVIEW', 'MISSING', 'FAIL'][max(rk) + 1] AS overall_status, count(*) FILTER (status = 'PASS') AS n_pass, count(*) FILTER (status = 'FAIL') AS n_fail, count(*) FILTER (status = 'REVIEW') AS n_review, count(*) FILTER (status = 'MISSING') AS n_missing
FROM area_rows JOIN ranks ON status = ranks.rule_status GROUP BY 1""")
def review_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """RV-10."""
    return V.transactions(V.areas(ruled(spark, sf)))


@query(f"{WITH} SELECT status, count(*) AS n_areas FROM area_rows GROUP BY 1")
def review_counts(spark: SparkSession, sf: str) -> DataFrame:
    """RV-13."""
    return V.areas(ruled(spark, sf)).groupBy("status").agg(F.count("*").alias("n_areas"))


@query(f"""{WITH}, m AS (SELECT transaction_id, check_id, item, left_doc AS document_type, left_field AS field FROM ruled WHERE rule_status = 'MISSING' AND left_field IS NOT NULL AND left_value IS NULL
  UNION ALL SELECT transaction_id, check_id, item, right_doc, right_field FROM ruled WHERE rule_status = 'MISSING' AND right_field IS NOT NULL AND right_value IS NULL
  UNION ALL SELECT transaction_id, check_id, item, check_id, '' FROM ruled WHERE rule_status = 'MISSING' AND NOT (left_field IS NOT NULL AND left_value IS NULL) AND NOT (right_field IS NOT NULL AND right_value IS NULL))
SELECT transaction_id, document_type, field, item, count(*) AS n_checks, min(check_id) AS first_check FROM m GROUP BY ALL""")
def review_missing_required(spark: SparkSession, sf: str) -> DataFrame:
    """RV-12."""
    return V.missing_required(ruled(spark, sf))


_STATE = f"""{WITH}, st AS (SELECT g.transaction_id, bool_or(s.status IN ('flag', 'review')) AS bad, bool_or(s.status = 'cannot_evaluate') AS gone FROM ledger g LEFT JOIN (SELECT * FROM scoped WHERE scope <> 'supplementary') s USING (transaction_id) GROUP BY 1),
states AS (SELECT transaction_id, CASE WHEN bad THEN 'review' WHEN coalesce(gone, TRUE) THEN 'cannot_evaluate' ELSE 'pass' END AS state FROM st)"""


@query(f"{_STATE} SELECT * FROM states")
def review_transaction_state(spark: SparkSession, sf: str) -> DataFrame:
    """RV-15: the other lattice."""
    return V.transaction_states(V.with_scope(all_checks(spark, sf)), ledger(spark, sf).select("transaction_id"))


@query(f"{_STATE} SELECT count(*) FILTER (state = 'pass') AS pass, count(*) FILTER (state = 'review') AS review, count(*) FILTER (state = 'cannot_evaluate') AS cannot_evaluate FROM states")
def review_state_summary(spark: SparkSession, sf: str) -> DataFrame:
    """RV-17."""
    return review_transaction_state(spark, sf).agg(*(F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("pass", "review", "cannot_evaluate")))


_FINDINGS = f"""{WITH}, f0 AS (SELECT transaction_id, check_id, area, type, item, rule_status AS status, CASE rule_status WHEN 'FAIL' THEN 'value_mismatch' WHEN 'MISSING' THEN 'missing_evidence' WHEN 'REVIEW' THEN 'unresolved_comparison' ELSE 'matched_values' END AS finding_type,
  left_doc, left_value, right_doc, right_value, CASE WHEN left_unit = right_unit THEN try_cast(left_value AS DECIMAL(20,4)) - try_cast(right_value AS DECIMAL(20,4)) END AS d FROM ruled WHERE rule_status <> 'NOT_APPLICABLE'),
found AS (SELECT transaction_id, area, type, item, status, finding_type, left_doc, left_value, right_doc, right_value, CAST(d AS DOUBLE) AS difference, CASE WHEN d > 0 THEN 'left_greater' WHEN d < 0 THEN 'left_less' WHEN d = 0 THEN 'equal' END AS direction,
  min(check_id) AS finding_id, string_agg(check_id, ',' ORDER BY check_id) AS check_ids FROM f0 GROUP BY ALL)"""


def found(spark: SparkSession, sf: str) -> DataFrame:
    of_documents, of_items = (V.with_rule_status(c) for c in (document_checks(spark, sf, alike=True), item_checks(spark, sf)))
    return V.findings(of_documents).unionByName(V.findings(of_items, by_line=True)).withColumn("difference", F.col("difference").cast("double"))


@query(f"{_FINDINGS} SELECT * FROM found")
def review_findings(spark: SparkSession, sf: str) -> DataFrame:
    """RV-20."""
    return found(spark, sf)


_TOP = f"""{_FINDINGS}, t AS (SELECT *, bool_or(status <> 'PASS') OVER (PARTITION BY transaction_id) AS issue FROM found),
u AS (SELECT transaction_id, finding_id, area, status, row_number() OVER (PARTITION BY transaction_id ORDER BY list_position(['FAIL', 'MISSING', 'REVIEW', 'PASS'], status), area, finding_id) AS rank FROM t WHERE NOT issue OR status <> 'PASS')"""


@query(f"{_TOP} SELECT transaction_id, finding_id, area, status, CAST(rank AS INTEGER) AS rank FROM u WHERE rank <= 4")
def review_top_findings(spark: SparkSession, sf: str) -> DataFrame:
    """RV-21."""
    return V.top_findings(found(spark, sf)).select("transaction_id", "finding_id", "area", "status", "rank")


@query(f"""{_FINDINGS}, o AS (SELECT *, list_position(['FAIL', 'MISSING', 'REVIEW', 'PASS'], status) AS so FROM found), g AS (SELECT *, row_number() OVER (PARTITION BY transaction_id, area ORDER BY so, area, finding_id) AS n FROM o)
SELECT transaction_id, area, status, finding_id FROM g WHERE n = 1 ORDER BY so, area, transaction_id LIMIT 16""")
def review_summary_findings(spark: SparkSession, sf: str) -> DataFrame:
    """RV-21, summary form: a top-k report."""
    return V.summary_findings(found(spark, sf)).select("transaction_id", "area", "status", "finding_id")


_TOPIC = """CASE WHEN type LIKE '%currency%' THEN 'currency' WHEN type LIKE '%date%' OR left_field LIKE '%\\_date' ESCAPE '\\' OR right_field LIKE '%\\_date' ESCAPE '\\' THEN 'date'
 WHEN list_has_any([left_field, right_field], ['amount', 'total_amount', 'subtotal', 'tax', 'unit_price']) THEN 'amount' WHEN list_has_any([left_field, right_field], ['quantity', 'gross_weight', 'net_weight', 'total_packages', 'package_count', 'volume']) THEN 'quantity'
 WHEN left_field LIKE '%number%' OR left_field LIKE '%reference%' OR right_field LIKE '%number%' OR right_field LIKE '%reference%' THEN 'identity' ELSE 'other' END"""


@query(f"{WITH} SELECT type, {_TOPIC} AS topic, count(*) AS n FROM checks GROUP BY ALL")
def review_topics(spark: SparkSession, sf: str) -> DataFrame:
    """RV-18."""
    c = checks(spark, sf)
    return c.groupBy("type", V.topic(F.col("type"), F.array("left_field", "right_field")).alias("topic")).agg(F.count("*").alias("n"))


@query(f"""{WITH}, w AS (SELECT transaction_id, {_TOPIC} AS topic, count(*) AS n_checks, min(check_id) AS first_check FROM ruled WHERE rule_status IN ('FAIL', 'REVIEW') GROUP BY ALL)
SELECT *, 'WP-' || lpad(CAST(row_number() OVER (PARTITION BY transaction_id ORDER BY topic) AS VARCHAR), 2, '0') AS workpaper FROM w""")
def review_workpapers(spark: SparkSession, sf: str) -> DataFrame:
    """RV-27."""
    return V.workpapers(ruled(spark, sf))


@query(f"""{WITH}, e AS (SELECT DISTINCT transaction_id, left_doc AS doc, left_field AS field, left_value AS value FROM checks UNION SELECT DISTINCT transaction_id, right_doc, right_field, right_value FROM checks)
SELECT 'e-' || substr(sha256(transaction_id || chr(31) || doc || chr(31) || field || chr(31) || coalesce(value, chr(0))), 1, 24) AS evidence_id, transaction_id, doc, field, value FROM e WHERE value IS NOT NULL""")
def review_evidence_index(spark: SparkSession, sf: str) -> DataFrame:
    """RV-16."""
    sides = F.array(*(F.struct(F.col(f"{s}_doc").alias("doc"), F.col(f"{s}_field").alias("field"), F.col(f"{s}_value").alias("value")) for s in ("left", "right")))
    e = checks(spark, sf).select("transaction_id", F.explode(sides).alias("e")).select("transaction_id", "e.*").where("value IS NOT NULL").distinct()
    return e.withColumn("evidence_id", V.content_id(*(F.col(c) for c in ("transaction_id", "doc", "field", "value"))))


@query(f"""{WITH}, p AS (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY check_id) AS n FROM ruled WHERE rule_status = 'PASS' AND left_value IS NOT NULL AND right_value IS NOT NULL) SELECT transaction_id, check_id, left_value, right_value FROM p WHERE n <= 12""")
def review_report_extract(spark: SparkSession, sf: str) -> DataFrame:
    """RV-32: the first twelve passed checks with observed values."""
    from pyspark.sql import Window

    rows = ruled(spark, sf).where("rule_status = 'PASS' AND left_value IS NOT NULL AND right_value IS NOT NULL")
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("transaction_id").orderBy("check_id"))).where("n <= 12").select("transaction_id", "check_id", "left_value", "right_value")


@query(f"""{WITH} SELECT transaction_id, string_agg(DISTINCT coalesce(left_value, '-') || ' / ' || coalesce(right_value, '-'), '; ' ORDER BY coalesce(left_value, '-') || ' / ' || coalesce(right_value, '-')) FILTER (status IN ('flag', 'review')) AS lines, count(*) FILTER (status = 'pass') AS n_pass, count(*) FILTER (status = 'cannot_evaluate') AS n_missing
FROM checks GROUP BY 1""")
def review_draft_sections(spark: SparkSession, sf: str) -> DataFrame:
    """RV-33."""
    line = F.concat(F.coalesce("left_value", F.lit("-")), F.lit(" / "), F.coalesce("right_value", F.lit("-")))
    lines = F.array_join(F.array_sort(F.collect_set(F.when(F.col("status").isin("flag", "review"), line))), "; ")
    got = checks(spark, sf).groupBy("transaction_id").agg(lines.alias("lines"), F.count(F.when(F.col("status") == "pass", 1)).alias("n_pass"), F.count(F.when(F.col("status") == "cannot_evaluate", 1)).alias("n_missing"))
    return got.withColumn("lines", F.nullif("lines", F.lit("")))


@query(f"{WITH} SELECT transaction_id, {' , '.join(f'count(*) FILTER (status = {s!r}) AS n_{s}' for s in ('pass', 'flag', 'review', 'cannot_evaluate'))} FROM all_checks GROUP BY 1")
def review_report_facts(spark: SparkSession, sf: str) -> DataFrame:
    """RV-14 and QA-18: status counters of each transaction."""
    return all_checks(spark, sf).groupBy("transaction_id").agg(*(F.count(F.when(F.col("status") == s, 1)).alias(f"n_{s}") for s in ("pass", "flag", "review", "cannot_evaluate")))


_UNITS = "('document_gross_weight_comparison', 'document_net_weight_comparison', 'ledger_invoice_amount_comparison')"


@query(f"{WITH} SELECT check_id, CASE WHEN left_unit IS NULL OR right_unit IS NULL THEN coalesce(left_unit, right_unit, '') WHEN left_unit = right_unit THEN left_unit ELSE '' END AS comparison_unit FROM checks WHERE type IN {_UNITS}")
def review_comparison_unit(spark: SparkSession, sf: str) -> DataFrame:
    """RV-02 and RV-03: a unit only when exactly one distinct unit is seen, else the empty string."""
    units = F.array_distinct(F.array_compact(F.array("left_unit", "right_unit")))
    rows = checks(spark, sf).where(f"type IN {_UNITS}")
    return rows.select("check_id", F.when(F.size(units) == 1, F.element_at(units, 1)).otherwise("").alias("comparison_unit"))


@query(f"{WITH} SELECT r.type, a.area, count(*) AS n_checks FROM all_checks r JOIN areas_of a USING (type) GROUP BY ALL")
def review_rule_catalog(spark: SparkSession, sf: str) -> DataFrame:
    """RV-01: the rule dimension joined with the checks it covers; its size is the number of rules."""
    return all_checks(spark, sf).groupBy("type").agg(F.count("*").alias("n_checks")).join(F.broadcast(V.rule_catalog(spark).select("type", "area")), "type")


@query(f"""{WITH}, o AS (SELECT transaction_id, CAST(row_number() OVER (ORDER BY tx) AS INTEGER) AS n, tx FROM ledger)
SELECT transaction_id, CASE WHEN tx % 5 = 0 THEN 'tx ' || n ELSE transaction_id END AS title FROM o""")
def review_titles(spark: SparkSession, sf: str) -> DataFrame:
    """RV-11: the ledger's own name, else the ordinal, made by range partitions rather than one sorting task."""
    from ..operators.ranking import global_ordinal

    named = ledger(spark, sf).withColumn("given", F.when(F.col("tx") % 5 != 0, F.col("transaction_id")))
    n = global_ordinal(named.select("tx", "transaction_id", "given"), ["tx"], "n")
    return n.select("transaction_id", F.coalesce("given", F.concat(F.lit("tx "), F.col("n").cast("string"))).alias("title"))
