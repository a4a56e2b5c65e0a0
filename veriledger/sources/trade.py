"""Trade documents and ledger rows as deterministic views over the order tables.

Each order is a ledger row; an invoice, a packing list and a bill of lading stand beside it.
Moduli of the order key leave documents out, blank values, mark values as uncertain and change
amounts, parties, quantities, weights, units and dates, so every outcome of a check occurs.
The view texts are common to Spark SQL and DuckDB.
"""

from __future__ import annotations

DOCUMENT_TYPES = ("commercial_invoice", "packing_list", "bill_of_lading")

LEDGER = """
SELECT o_orderkey AS tx, 'T' || CAST(o_orderkey AS STRING) AS transaction_id, 'INV-' || CAST(o_orderkey AS STRING) AS invoice_number,
  'PO-' || CAST(o_orderkey AS STRING) AS purchase_order_number,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS transaction_date, CAST(CAST(o_orderdate AS DATE) AS STRING) AS posting_date,
  CASE WHEN o_orderkey % 41 = 0 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS amount,
  CASE WHEN o_orderkey % 47 = 0 THEN 'EUR' ELSE 'USD' END AS currency,
  'CUST-' || CAST(o_custkey AS STRING) AS counterparty, CASE WHEN o_orderkey % 2 = 0 THEN 'buyer' ELSE 'seller' END AS counterparty_role
FROM {orders}
"""

#: One row a document. k is the order key.
DOCUMENTS = """
SELECT k AS tx, 'T' || CAST(k AS STRING) AS transaction_id, dt AS document_type, dt || '-' || CAST(k AS STRING) AS entity_id,
  CASE WHEN k % 43 = 0 AND dt = 'packing_list' THEN NULL ELSE 'INV-' || CAST(k AS STRING) END AS invoice_number,
  CASE WHEN k % 37 = 0 AND dt = 'bill_of_lading' THEN 'PO-X' ELSE 'PO-' || CAST(k AS STRING) END AS purchase_order_number,
  CASE WHEN dt = 'commercial_invoice' AND k % 3 = 0 THEN NULL ELSE 'BL-' || CAST(k AS STRING) END AS bill_of_lading_number,
  CASE WHEN dt = 'bill_of_lading' AND k % 5 = 0 THEN NULL ELSE 'PL-' || CAST(k AS STRING) END AS packing_list_number,
  CASE WHEN k % 4 = 0 THEN NULL ELSE 'BUY-' || CAST(k % 97 AS STRING) END AS buyer_reference,
  CASE WHEN k % 6 = 0 THEN NULL ELSE 'DOC-' || CAST(k % 89 AS STRING) END AS document_reference,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 11 = 0 AND dt = 'packing_list' THEN 'BK-0' ELSE 'BK-' || CAST(k AS STRING) END AS booking_number,
  CASE WHEN k % 19 = 0 THEN CAST(CAST(d + INTERVAL 3 DAY AS DATE) AS STRING) ELSE CAST(d AS STRING) END AS issue_date,
  CASE WHEN dt = 'packing_list' THEN NULL WHEN k % 13 = 0 AND dt = 'bill_of_lading' THEN CAST(CAST(d + INTERVAL 9 DAY AS DATE) AS STRING) ELSE CAST(CAST(d + INTERVAL 7 DAY AS DATE) AS STRING) END AS shipment_date,
  CASE WHEN dt <> 'bill_of_lading' THEN NULL ELSE CAST(CAST(d + INTERVAL 8 DAY AS DATE) AS STRING) END AS on_board_date,
  CASE WHEN k % 2 = 0 THEN NULL ELSE CAST(CAST(d + INTERVAL 8 DAY AS DATE) AS STRING) END AS departure_date,
  CASE WHEN dt <> 'commercial_invoice' OR k % 23 = 0 THEN NULL WHEN k % 17 = 0 THEN CAST(amount + 100 AS STRING) ELSE CAST(amount AS STRING) END AS total_amount,
  CASE WHEN dt = 'commercial_invoice' THEN 'USD' END AS currency,
  CASE WHEN k % 53 = 0 THEN 'CUST-0' ELSE 'CUST-' || CAST(c AS STRING) END AS buyer,
  CASE WHEN k % 59 = 0 THEN 'CUST-0' ELSE 'CUST-' || CAST(c AS STRING) END AS seller,
  CASE WHEN dt = 'commercial_invoice' THEN NULL WHEN k % 61 = 0 AND dt = 'bill_of_lading' THEN '120.5' ELSE CAST(100 + k % 50 AS STRING) || '.50' END AS gross_weight,
  CASE WHEN dt = 'commercial_invoice' OR k % 67 = 0 THEN NULL WHEN k % 71 = 0 AND dt = 'bill_of_lading' THEN 'lb' ELSE 'kg' END AS gross_weight_unit,
  CASE WHEN dt = 'commercial_invoice' THEN NULL WHEN k % 73 = 0 AND dt = 'packing_list' THEN '1' ELSE CAST(90 + k % 50 AS STRING) END AS net_weight,
  CASE WHEN dt = 'commercial_invoice' THEN NULL ELSE 'kg' END AS net_weight_unit,
  CASE WHEN dt = 'commercial_invoice' THEN NULL WHEN k % 79 = 0 AND dt = 'bill_of_lading' THEN '99' ELSE CAST(1 + k % 40 AS STRING) END AS total_packages,
  CASE WHEN k % 83 = 0 AND dt = 'packing_list' THEN 'review' ELSE 'accepted' END AS extraction_status
FROM (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, CAST(o_orderdate AS DATE) AS d, dt
  FROM {orders} CROSS JOIN (VALUES ('commercial_invoice'), ('packing_list'), ('bill_of_lading')) AS kinds(dt)) AS o
WHERE NOT (dt = 'commercial_invoice' AND k % 31 = 0) AND NOT (dt = 'bill_of_lading' AND k % 29 = 0)
"""

#: Fields of a document that become cells.
DOCUMENT_FIELDS = (
    "invoice_number purchase_order_number bill_of_lading_number packing_list_number buyer_reference document_reference booking_number issue_date shipment_date on_board_date departure_date "
    "total_amount currency buyer seller gross_weight gross_weight_unit net_weight net_weight_unit total_packages"
).split()
LEDGER_FIELDS = "invoice_number purchase_order_number transaction_date posting_date amount currency counterparty counterparty_role".split()

#: Documents as they come in, before they are linked: those above, papers that name no known transaction, and papers that name two.
INCOMING = """
SELECT entity_id, document_type, invoice_number, purchase_order_number FROM ({documents}) AS d
UNION ALL SELECT 'stray-' || CAST(o_orderkey AS STRING), 'packing_list', CASE WHEN o_orderkey % 100 = 0 THEN NULL ELSE 'INV-X' || CAST(o_orderkey AS STRING) END, NULL FROM {orders} WHERE o_orderkey % 50 = 0
UNION ALL SELECT 'torn-' || CAST(o_orderkey AS STRING), 'arrival_notice', 'INV-' || CAST(o_orderkey AS STRING), 'PO-' || CAST(o_orderkey + 1 AS STRING) FROM {orders} WHERE o_orderkey % 64 = 1
UNION ALL SELECT 'notice-' || CAST(o_orderkey AS STRING) || '-' || CAST(n AS STRING), 'delivery_note', 'INV-' || CAST(o_orderkey AS STRING), NULL FROM {orders} CROSS JOIN (VALUES (1), (2)) AS t(n) WHERE o_orderkey % 60 = 0 AND (n = 1 OR o_orderkey % 120 = 0)
""".replace("{documents}", DOCUMENTS)

#: One row a document and line. The line table's key is not unique; rows of a repeated key are one line with the sums, but for some
#: that a packing list shows twice. Some lines have no product code, some lists have no table of items.
ITEMS = """
SELECT tx, 'T' || CAST(tx AS STRING) AS transaction_id, dt AS document_type, dt || '-' || CAST(tx AS STRING) AS entity_id,
  CASE WHEN (tx + part) % 37 = 0 AND dt = 'bill_of_lading' THEN NULL WHEN (tx + part) % 97 = 0 THEN NULL ELSE product_code END AS product_code,
  CASE WHEN (tx + part) % 43 = 0 AND dt = 'packing_list' THEN 'Goods' WHEN (tx + part) % 3 = 0 AND dt = 'packing_list' THEN upper(name) ELSE name END AS description,
  CASE WHEN (tx + part) % 13 = 0 AND dt = 'packing_list' THEN CAST(q + 1 AS STRING) WHEN (tx + part) % 17 = 0 AND dt = 'bill_of_lading' THEN NULL ELSE CAST(q AS STRING) END AS quantity,
  CASE WHEN (tx + part) % 19 = 0 AND dt = 'bill_of_lading' THEN 'ctn' WHEN (tx + part) % 23 = 0 THEN NULL ELSE 'pcs' END AS unit,
  CASE WHEN dt = 'commercial_invoice' THEN NULL ELSE CAST(q * 2 AS STRING) END AS gross_weight,
  CASE WHEN dt = 'commercial_invoice' THEN NULL WHEN (tx + part) % 29 = 0 AND dt = 'packing_list' THEN CAST(q * 3 AS STRING) ELSE CAST(q AS STRING) END AS net_weight,
  CASE WHEN dt = 'commercial_invoice' THEN NULL WHEN (tx + part) % 47 = 0 AND dt = 'bill_of_lading' THEN '2' ELSE '1' END AS package_count
FROM (SELECT l_orderkey AS tx, l_partkey AS part, 'P' || CAST(l_partkey AS STRING) AS product_code, 'Part ' || CAST(l_partkey AS STRING) AS name, CAST(sum(l_quantity) AS BIGINT) AS q
  FROM {lineitem} GROUP BY l_orderkey, l_partkey) AS l
  CROSS JOIN (VALUES ('commercial_invoice', 1), ('packing_list', 1), ('packing_list', 2), ('bill_of_lading', 1)) AS kinds(dt, n)
WHERE NOT (dt = 'packing_list' AND (tx + part) % 31 = 0) AND NOT (dt = 'bill_of_lading' AND tx % 33 = 0) AND (n = 1 OR (tx + part) % 101 = 0)
"""
ITEM_FIELDS = "product_code description unit quantity package_count gross_weight net_weight".split()
